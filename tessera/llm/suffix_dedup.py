"""Repeated passages: every byte covered by a string of LENGTH bytes that also starts elsewhere is removed.

Which strings may be equal is found by content: each string (window) is represented by the least hash among its grams (at
first about a third of its length), its anchor. Equal windows have equal anchors at equal offsets, so windows only meet
within the group of an anchor. Neighbouring windows with the same anchor form a segment; equal segments form a class, whose
members are counted before anything is compared. Anchors that occur once are done with, before wider rows are moved.

The segments that are left are compared in shards by the threshold-bounded expansion of intervals: a suffix array and the
Burrows-Wheeler transform of the shard's segments are built, and intervals are extended backward, breadth first, which sets
the common prefixes of neighbouring suffixes by increasing value. It stops at LENGTH: what is still unset there is at
least as long, and those suffixes are repeated.

An anchor with very many classes is not compared: its segments are anchored again by longer grams, which fewer windows
share, and so on up to grams as long as a window, where a group is one class. Only the segments of such anchors carry bytes
to the next level. Every window is compared with all equal ones, and no group grows beyond a parameter.

Passages shorter than LENGTH bytes that other documents hold, too, are found in the same way and listed, not removed: windows
are of `words` words, whatever white space is between them, and the symbols of suffix arrays and transforms are words. A class
knows the least and the greatest id of its documents, so repeats within one document don't count; rows with one doc_id are
one document, rows without are told apart by their text.

Null texts are empty. Rows with the same doc_id and text count as separate occurrences of each other; they get the same
result each, as do ties of any kind: results depend on no order. Other columns of docs, whatever their names, aren't read.
Texts shorter than LENGTH keep all bytes. Empty tables give no rows. Very long texts are read in blocks of window starts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import SPACE, forget, keyed_texts, record_batch, slices, written

#: Length of the grams at each level, as shares of a window's; a window's words are fewer than its bytes and tell more each.
GRAMS = (0.32, 0.64, 0.88, 1.0)
WORD_GRAMS = (0.16, 0.48, 0.8, 1.0)
BLOCK = 1 << 18
#: Segments that are compared at once, about: larger arrays leave the processor's cache.
BATCH = 600
#: An odd base and its inverse modulo 2^64, for hashes of grams by differences of prefix sums.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: The least bit of h says whether a segment is of words. A segment starts at byte first + ahead and has n + more bytes.
ANCHORS = pa.schema([("k", pa.int64()), ("t", pa.int64()), ("h", pa.int64()), ("sh", pa.int64()), ("first", pa.int64()), ("n", pa.int32()), ("ahead", pa.int64()), ("more", pa.int32())])
SPACES = np.isin(np.arange(256), list(SPACE.encode()))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = _powers[base] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, BLOCK) + 1, base, np.uint64)])
    return have[:n]


def sums_before(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    return sums


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    sums = sums_before(data)
    return mixed((sums[gram:] - sums[:-gram]) * powers(INVERSE, len(data) + 1)[: len(data) + 1 - gram])


def range_hashes(data: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    sums = sums_before(data)
    return mixed((sums[stop] - sums[first]) * powers(INVERSE, len(data) + 1)[first])


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(v) - width + 1
    rows = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[: len(v)] = v
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchored(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window start and number of window starts of each segment; h: hashes of the grams, of which a window has `width`."""
    low = np.uint64((1 << 20) - 1)
    least = sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), width)  # of equal hashes the leftmost
    anchor = (least & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    return anchor[first], first, np.diff(np.r_[first, len(anchor)])


def segments(data: bytes, length: int, gram: int | None = None) -> np.ndarray:
    """A row for each segment: hash of the anchor, hash of the segment, anchor, first window start, number of window starts."""
    import xxhash

    gram = gram or int(GRAMS[0] * length)
    digest, out = xxhash.xxh64_intdigest, [np.zeros((0, 5), np.int64)]
    for start in range(0, len(data) - length + 1, BLOCK):
        stop = min(start + BLOCK + length - 1, len(data))
        h = gram_hashes(np.frombuffer(data, np.uint8, stop - start, start), gram)
        a, first, n = anchored(h, length - gram + 1)
        sh = [digest(data[z : z + m], y) for y, z, m in zip((a - first).tolist(), (first + start).tolist(), (n - 1 + length).tolist(), strict=True)]
        out.append(np.stack([h[a].view(np.int64), np.array(sh, np.uint64).view(np.int64), a + start, first + start, n], 1))
    return np.concatenate(out)


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each word, and the one behind it."""
    inner = np.r_[False, ~SPACES[np.frombuffer(data, np.uint8)], False]
    edge = np.flatnonzero(inner[1:] != inner[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    import xxhash

    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + BLOCK, "right")))
        if ends[i] - at > BLOCK:
            out[i] = xxhash.xxh64_intdigest(data[at : ends[i]])
        else:
            out[i:j] = range_hashes(np.frombuffer(data, np.uint8, int(ends[j - 1]) - at, at), starts[i:j] - at, ends[i:j] - at)
        i = j
    return out


def word_segments(data: bytes, words: int, gram: int) -> np.ndarray:
    """A row for each segment of windows of `words` words: hash of the anchor, hash of the segment, its first word, number of window starts, first byte, size in bytes."""
    starts, ends = word_places(data)
    out = [np.zeros((0, 6), np.int64)]
    hashes = word_hashes(data, starts, ends) if len(starts) >= words else starts
    for start in range(0, len(hashes) - words + 1, BLOCK):
        part = hashes[start : start + BLOCK + words - 1]
        h = gram_hashes(part, gram)
        a, first, n = anchored(h, words - gram + 1)
        stop = first + n - 1 + words
        sh, cut = range_hashes(part, first, stop), starts[start + first]
        out.append(np.stack([h[a].view(np.int64), sh.view(np.int64), first + start, n, cut, ends[start + stop - 1] - cut], 1))
    return np.concatenate(out)


def suffix_order(sym: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; only suffixes that are still tied are sorted again. sym: below 2^31, no two suffixes equal."""
    n = len(sym)
    step = 4 if sym.max(initial=0) < 1 << 16 else 2  # symbols in a key
    s = np.zeros(n + step - 1, np.uint64)
    s[:n] = sym
    key = s[:n]
    for i in range(1, step):
        key = key << np.uint64(64 // step) | s[i : n + i]
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    first = np.r_[True, key[1:] != key[:-1]]
    del key, s
    rank = np.zeros(n + 1, np.int64)  # 0 is behind the end; a suffix's rank is the place of its first equal, from 1
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(1, n + 1, dtype=np.int32), 0))
    slots = np.flatnonzero(~(first & np.r_[first[1:], True])).astype(np.int32)
    bits = n.bit_length()
    while len(slots):
        at = order[slots]
        k = rank[at] << bits | rank[np.minimum(at + step, n)]
        if 3 * bits <= 63:  # the suffix itself has room in the key: a plain sort is enough
            k = np.sort(k << bits | at)
            at = (k & ((1 << bits) - 1)).astype(np.int32)
            k >>= bits
        else:
            by = np.argsort(k)
            at, k = at[by], k[by]
        order[slots] = at
        new = np.r_[True, k[1:] != k[:-1]]
        rank[at] = np.maximum.accumulate(np.where(new, slots + 1, 0))
        slots = slots[~(new & np.r_[new[1:], True])]
        step *= 2
    return order


def long_prefixes(sym: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in the suffix array, whether it has `length` symbols in common with the one before.

    Intervals are those of the suffixes with a common start of `depth` symbols. One symbol more in front maps an interval to
    others, each a run of last-to-first positions; the end of each, if still unset, has a common prefix of `depth`.
    """
    n = len(sym)
    narrow = np.uint16 if sym.max(initial=0) < 1 << 16 else np.uint32
    before = sym[order - 1].astype(narrow)  # the Burrows-Wheeler transform
    lf = np.empty(n, np.int32)
    lf[np.argsort(before, kind="stable")] = np.arange(n, dtype=np.int32)
    front = sym[order].astype(narrow)
    left = np.flatnonzero(np.r_[True, front[1:] != front[:-1]]).astype(np.int32)  # depth 0: one interval per symbol
    right = np.r_[left[1:], n].astype(np.int32)
    unset = np.ones(n + 1, bool)
    unset[left] = unset[n] = False
    for _ in range(1, length):
        wide = right - left
        if not len(left):
            break
        ends = np.cumsum(wide)
        places = np.repeat(left - (ends - wide), wide) + np.arange(int(ends[-1]), dtype=np.int32)
        k = np.sort(lf[places].astype(np.int64) << 32 | np.repeat(np.arange(len(left), dtype=np.int32), wide))
        to, owner = (k >> 32).astype(np.int32), k.astype(np.int32)
        cut = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (to[1:] != to[:-1] + 1) | (front[to[1:]] != front[to[:-1]])])
        left, right = to[cut], to[np.r_[cut[1:], len(to)] - 1] + np.int32(1)
        fresh = unset[right]
        left, right = left[fresh], right[fresh]
        unset[right] = False
    return unset


def _ordered(symbols: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of strings of these sizes, for each place in it whether the suffix has `length` symbols in common with the one before, and where strings start."""
    starts = np.cumsum(np.r_[0, sizes[:-1] + 1])
    sym = np.zeros(int((sizes + 1).sum()), np.int64)
    m = len(sizes)
    sym[starts + sizes] = np.arange(m)  # ends differ, so no common prefix runs over one
    inner = np.ones(len(sym), bool)
    inner[starts + sizes] = False
    sym[inner] = symbols.astype(np.int64) + m
    order = suffix_order(sym)
    return order, long_prefixes(sym, order, length), starts


def repeated_starts(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each of the strings, whether the `length` bytes from each start (that has so many) also start elsewhere."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    order, deep, starts = _ordered(np.frombuffer(b"".join(parts), np.uint8), sizes, length)
    found = np.zeros(len(order), bool)
    found[order] = deep[:-1] | deep[1:]
    return [found[s : s + k - length + 1] for s, k in zip(starts.tolist(), sizes.tolist(), strict=True)]


def shared_starts(parts: list[list[bytes]], k0: np.ndarray, k1: np.ndarray, words: int) -> list[np.ndarray]:
    """For each of the lists, whether the `words` words from each start are in lists of several documents; k0, k1: the least and greatest id of a list's documents."""
    number: dict[bytes, int] = {}
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    order, deep, starts = _ordered(np.array([number.setdefault(w, len(number)) for p in parts for w in p], np.int64), sizes, words)
    part = np.repeat(np.arange(len(parts)), sizes + 1)[order]
    first = np.flatnonzero(~deep[:-1])  # of the suffixes that start alike
    shared = np.minimum.reduceat(k0[part], first) != np.maximum.reduceat(k1[part], first)
    found = np.zeros(len(order), bool)
    found[order] = np.repeat(shared, np.diff(np.r_[first, len(order)]))
    return [found[s : s + k - words + 1] for s, k in zip(starts.tolist(), sizes.tolist(), strict=True)]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


def _anchors(rows: DataFrame, length: int, words: int | None, level: int) -> DataFrame:
    """Segments of bytes and of words of each row; below the first level a row is a segment of the kind that the least bit of k says."""

    def some(k, data):
        if not level or not k & 1:
            h, sh, _, first, n = segments(data, length, max(1, int(GRAMS[level] * length))).T
            yield np.stack([h & ~1, sh, first, n, np.zeros_like(n), np.full_like(n, length - 1)])
        if words and (not level or k & 1):
            h, sh, first, n, cut, size = word_segments(data, words, max(1, int(WORD_GRAMS[level] * words))).T
            yield np.stack([h | 1, sh, first, n, cut - first, size - n])

    def find(batches):
        for b in slices(batches):
            found = [np.concatenate([np.zeros((6, 0), np.int64), *some(k, x)], 1) for k, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            keys = [np.repeat(b.column(i).to_numpy(), [f.shape[1] for f in found]) for i in range(2)]
            yield record_batch(ANCHORS, [*keys, *(np.concatenate(found, 1) if found else np.zeros((6, 0), np.int64))])

    return rows.select("k", "t", "data").mapInArrow(find, "k long, t long, h long, sh long, first long, n int, ahead long, more int")


def _cut(classes: DataFrame, rows: DataFrame) -> DataFrame:
    """h, sh, k0, k1, seg: the bytes of each class's representative. Lists are of one row's segments; repeated rows are read once."""
    wanted = classes.groupBy("r.k", "r.t").agg(F.collect_list(F.struct("h", "sh", "k0", "k1", (F.col("r.first") + F.col("r.ahead")).alias("at"), (F.col("r.n") + F.col("r.more")).alias("size"))).alias("w"))
    held = wanted.join(rows.groupBy("k", "t").agg(F.first("data").alias("data")), ["k", "t"])
    cut = F.transform("w", lambda x: F.struct(x["h"].alias("h"), x["sh"].alias("sh"), x["k0"].alias("k0"), x["k1"].alias("k1"), F.substring(F.col("data"), (x["at"] + 1).cast("int"), x["size"]).alias("seg")))
    return held.select(F.inline(cut))


def _compare(length: int, words: int | None, batch: int):
    """Ranges of repeated window starts of the classes in a shard. Groups are independent, so they are compared in batches of about `batch` segments."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for by_words, some in rows.groupby(rows["h"] & 1, sort=True):
            some = some.sort_values("g", ignore_index=True)
            sizes = some.groupby("g", sort=True).size().to_numpy()
            number = np.repeat((np.cumsum(sizes) - sizes) // batch, sizes)
            for _, part in some.groupby(number, sort=False):
                if by_words:
                    found = shared_starts([x.split() for x in part["seg"]], part["k0"].to_numpy(np.int64), part["k1"].to_numpy(np.int64), words)
                else:
                    found = repeated_starts(part["seg"].tolist(), length)
                for h, sh, flags in zip(part["h"], part["sh"], found, strict=True):
                    out += [(h, sh, x, y) for x, y in runs(flags)]
        return pd.DataFrame(out, columns=["h", "sh", "a", "b"])

    return compare


def _repeated(rows: DataFrame, length: int, words: int | None, most: int, shard_rows: int, level: int = 0, owners: DataFrame | None = None) -> DataFrame:
    """k, t, by_words, a, b: ranges of starts (both ends included) of repeated windows in the rows (k, t, data); rows with equal k and t hold equal data.

    owners: k, t, k0, k1, the ids of the documents of rows below the first level, where a row is a class.
    """
    by_words = F.col("h").bitwiseAND(F.lit(1)) == 1
    anchored_rows = _anchors(rows, length, words, level)
    found = written(anchored_rows if owners is None else anchored_rows.join(owners, ["k", "t"]))
    owned = lambda df: df if owners is not None else df.withColumns({x: F.when(by_words, F.col("k")).otherwise(0) for x in ("k0", "k1")})
    ids = [F.count("*").alias("c"), F.min("k0").alias("k0"), F.max("k1").alias("k1")]
    again = F.when(by_words, F.col("k0") != F.col("k1")).otherwise(F.col("c") > 1)
    often = written(owned(found).groupBy("h").agg(*ids).filter(again).select("h"))  # a table, so that the join can split a hot anchor
    anchors = written(found.join(often, "h", "left_semi"))
    forget(found)
    classes = written(owned(anchors).groupBy("h", "sh").agg(*ids, F.min(F.struct("k", "t", "first", "n", "ahead", "more")).alias("r")))
    ranges = classes.filter(again).select("h", "sh", F.lit(0).alias("a"), (F.col("r.n") - 1).alias("b"))
    if level + 1 < len(GRAMS):  # at the last level a group is one class
        sized = written(classes.groupBy("h").agg(F.count("*").alias("m"), F.count_if(~again).alias("open")).filter("m > 1 and open > 0"))
        light, heavy = sized.filter(F.col("m") <= most), sized.filter(F.col("m") > most)
        shards = max(1, -(-(light.agg(F.sum("m")).first()[0] or 0) // shard_rows))
        segs = _cut(classes.join(light, "h", "left_semi"), rows).withColumn("g", F.xxhash64("h"))
        ranges = ranges.unionAll(segs.withColumn("shard", F.pmod("g", F.lit(shards))).groupBy("shard").applyInPandas(_compare(length, words, min(BATCH, shard_rows)), "h long, sh long, a int, b int"))
        if not heavy.isEmpty():
            held = written(_cut(classes.join(heavy, "h", "left_semi"), rows).select(F.col("h").alias("k"), F.col("sh").alias("t"), F.col("seg").alias("data"), "k0", "k1"))
            below = _repeated(held.drop("k0", "k1"), length, words, most, shard_rows, level + 1, held.drop("data"))
            ranges = ranges.unionAll(below.select(F.col("k").alias("h"), F.col("t").alias("sh"), F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")))
    return anchors.select("k", "t", "h", "sh", "first").join(ranges, ["h", "sh"]).select("k", "t", by_words.alias("by_words"), (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))


def without_repeats(docs: DataFrame, length: int = 400, most: int = 1000, shard_rows: int = 2500, words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, spans, kept, passages for each row of docs: the maximal runs of removed bytes (start, end exclusive), the bytes
    that are left, and, if `words` is given, the maximal runs of words (numbers of the first and behind the last) whose windows of so
    many words other documents hold, too.

    most: classes of an anchor that are compared without anchoring them again; shard_rows: segments in a shard, about.
    """
    texts = keyed_texts(docs).select("doc_id", F.coalesce("doc_id", F.xxhash64(F.lit(1), "text")).alias("k"), F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("data"))
    of = lambda which, name: F.collect_set(F.when(which, F.struct("a", "b"))).alias(name)  # noqa: E731  repeated rows give a range again
    gone = _repeated(texts.select("k", "t", "data"), length, words, most, shard_rows).groupBy("k", "t").agg(of(~F.col("by_words"), "gone"), of(F.col("by_words"), "held"))
    return _without(texts.join(gone.withColumn("some", F.lit(True)), ["k", "t"], "left"), length, words)


def figures() -> list[Column]:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of rows of without_repeats()."""
    removed = (F.col("n_bytes") - F.octet_length("kept")).cast("long")
    return [F.col("doc_id"), F.col("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]


def passage_figures() -> list[Column]:
    """n_passages and n_passage_words of rows of without_repeats()."""
    long = F.aggregate("passages", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return [F.size("passages").cast("long").alias("n_passages"), long.alias("n_passage_words")]


def clean_text() -> Column:
    """The kept bytes as text; a character of which only some bytes are left is U+FFFD."""
    return F.make_valid_utf8(F.col("kept").cast("string")).alias("clean_text")


def repeats(docs: DataFrame, length: int = 400, most: int = 1000, shard_rows: int = 2500) -> DataFrame:
    """The figures of without_repeats() for each row of docs."""
    return without_repeats(docs, length, most, shard_rows).select(figures())


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
REPORT = pa.struct([("spans", SPANS), ("kept", pa.binary()), ("passages", SPANS)])


def spans(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes (or words) covered by windows from ranges of starts (both ends included)."""
    out: list[list[int]] = []
    for a, b in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def kept_bytes(data: bytes, removed: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in removed for x in s), len(data)]
    return b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))


def _without(rows: DataFrame, length: int, words: int | None) -> DataFrame:
    """Only the texts in which something was found are sent to Python."""
    kind = "array<struct<start: long, end: long>>"

    @F.arrow_udf(f"spans {kind}, kept binary, passages {kind}")
    def report(data: pa.Array, gone: pa.Array, held: pa.Array) -> pa.Array:
        out: list[dict | None] = []
        for i in range(len(data)):
            if (text := data[i].as_py()) is None:
                out.append(None)
                continue
            removed = spans([(x["a"], x["b"]) for x in gone[i].as_py()], length)
            passages = spans([(x["a"], x["b"]) for x in held[i].as_py()], words)
            named = [[{"start": a, "end": b} for a, b in x] for x in (removed, passages)]
            out.append({"spans": named[0], "kept": kept_bytes(text, removed) if removed else text, "passages": named[1]})
        return pa.array(out, REPORT)

    told = rows.withColumn("r", report(F.when(F.col("some"), F.col("data")), "gone", "held"))
    kept, none = F.when(F.col("some"), F.col("r.kept")).otherwise(F.col("data")), F.array().cast(kind)
    return told.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), F.coalesce("r.spans", none).alias("spans"), kept.alias("kept"), F.coalesce("r.passages", none).alias("passages"))
