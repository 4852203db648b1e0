"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are computed per document; equal ones form a class. Classes meet in buckets: two fingerprints that differ in
at most `RADIUS` bits agree in two of any four groups of bits, so each goes to six buckets. A bucket with too many members
is dealt again by four groups of the bits it left free, and so on until few bits are free; every pair still meets. Within
a bucket the fingerprints lie as vertical bit planes: 64 distances are updated at once by carry-save counters, and a block
of 64 is abandoned as soon as all of it is beyond the radius. Only a spanning forest of the links leaves a task.

Null texts are empty: fingerprint zero, linked like any other. Repeated rows fall into one class. Rows without doc_id get
their component's least doc_id, or null if it has none. A bit that is set in just half of the hashes is 0. Empty tables give
no rows. Texts are read whole; other columns of docs, whatever their names, aren't read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import keyed_texts, record_batch, slices, written
from tessera.llm.components import components

ARROW = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
RADIUS = 2
ALL = np.uint64(2**64 - 1)


def shingles(text: str, size: int) -> list[bytes]:
    words = text.encode().lower().split()
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def fingerprint(text: str, size: int = 3, seed: int = 42) -> int:
    import xxhash

    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles(text, size)], "<u8")
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded also for very long texts
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def of(batches):
        for b in slices(batches):
            fps = np.array([fingerprint(t, size, seed) for t in b.column(1).to_pylist()], np.uint64)
            yield record_batch(ARROW, [b.column(0), fps.view(np.int64)])

    return keyed_texts(docs).mapInArrow(of, "doc_id long, fp long")


def near_pairs(values: np.ndarray, ends: np.ndarray, radius: int = RADIUS, chunk: int = 1 << 15):
    """Pairs (i, j), i < j < ends[i], whose values differ in at most `radius` bits, chunk by chunk.

    values: uint64, or rows of several, a bucket's side by side. The counter of 64 distances is a word for each of its bits;
    what is carried out of the highest one, or is over the radius after some planes, is over for good.
    """
    n = len(values)
    if not n:
        return
    values = values.reshape(n, -1)
    width = 64 * values.shape[1]
    bits = np.unpackbits(np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(n, -1), axis=1, bitorder="little").T
    padded = np.zeros((width, -(-n // 64) * 64), np.uint8)
    padded[:, :n] = bits
    planes = np.packbits(padded, axis=1, bitorder="little").view("<u8")  # plane p, word w: bit p of 64 values
    low, high = (np.arange(n) + 1) // 64, (ends - 1) // 64
    blocks = np.where(ends - 1 > np.arange(n), high - low + 1, 0)
    upto = np.cumsum(blocks)
    for first in range(0, int(upto[-1]), chunk):
        task = np.arange(first, min(first + chunk, int(upto[-1])))
        i = np.searchsorted(upto, task, "right")
        w = low[i] + task - (upto[i] - blocks[i])
        over = np.zeros(len(i), np.uint64)
        counters = [over.copy() for _ in range(radius.bit_length())]
        for p in range(width):
            carry = planes[p][w] ^ (np.uint64(0) - (values[i, p // 64] >> np.uint64(p % 64) & np.uint64(1)))
            for k, c in enumerate(counters):
                counters[k], carry = c ^ carry, c & carry
            over |= carry
            if p % 8 == 7:
                more, equal = np.zeros(len(i), np.uint64), np.full(len(i), ALL)
                for k in reversed(range(len(counters))):  # counter > radius, from the highest bit down
                    if radius >> k & 1:
                        equal &= counters[k]
                    else:
                        more |= equal & counters[k]
                        equal &= ~counters[k]
                over |= more
                if not (alive := over != ALL).all():
                    i, w, over, counters = i[alive], w[alive], over[alive], [c[alive] for c in counters]
                    if not len(i):
                        break
        hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        t, lane = np.nonzero(hit)
        a, b = i[t], w[t] * 64 + lane
        right = (b > a) & (b < ends[a])
        yield a[right], b[right]


def forest(values: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest (value, least value of its tree) over the near pairs within buckets."""
    order = np.argsort(buckets, kind="stable")
    values, buckets = values[order], buckets[order]
    new = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    sizes = np.diff(np.r_[new, len(values)])
    keep = np.repeat(sizes > 1, sizes)
    values = values[keep]
    ends = np.repeat(np.cumsum(sizes[sizes > 1]), sizes[sizes > 1])
    nodes, at = np.unique(values, return_inverse=True)
    label = np.arange(len(nodes))
    for a, b in near_pairs(values, ends):
        a, b = at[a], at[b]
        while len(a):
            la, lb = label[a], label[b]
            least = np.minimum(la, lb)
            np.minimum.at(label, la, least)
            np.minimum.at(label, lb, least)
            while not np.array_equal(up := label[label], label):
                label = up
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
    hung = label != np.arange(len(nodes))
    return nodes[hung], nodes[label[hung]]


def split_bits(bits: list[int]) -> list[list[int]]:
    """The bits that each of the six buckets fixes: two of four groups."""
    groups = [bits[k * len(bits) // 4 : (k + 1) * len(bits) // 4] for k in range(4)]
    return [a + b for a, b in combinations(groups, 2)]


def _as_long(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - 2**64 if value >= 2**63 else value


def bucket_masks(levels: int = 4) -> list[list[tuple[int, int]]]:
    """For each level the pairs (mask of the level above, mask): 6, then 36, 216, 1296 of them."""
    out, above = [], [[]]
    for _ in range(levels):
        pairs = [(fixed, fixed + more) for fixed in above for more in split_bits([b for b in range(64) if b not in set(fixed)])]
        out.append([(_as_long(a), _as_long(b)) for a, b in pairs])
        above = [b for _, b in pairs]
    return out


def links(classes: DataFrame, most: int = 4096, shard_rows: int = 20_000) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that join all near ones. most: members of a bucket that are compared directly."""
    spark = classes.sparkSession
    shards = max(1, -(-6 * classes.count() // shard_rows))
    out, left = None, None
    for level, masks in enumerate(bucket_masks()):
        table = F.array(*(F.struct(F.lit(a).alias("above"), F.lit(m).alias("mask")) for a, m in masks)) if level == 0 else None
        if level == 0:
            rows = classes.select("fp", F.explode(table).alias("x")).select("fp", F.col("x.mask").alias("mask"))
        else:  # at most 1296 rows
            rows = left.join(F.broadcast(spark.createDataFrame(masks, "mask long, next long")), "mask").select("fp", F.col("next").alias("mask"))
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        heavy = None
        if level < 3:  # the last level leaves four bits free, so at most 16 fingerprints share a bucket
            heavy = written(rows.groupBy("mask", "value").count().filter(F.col("count") > most).select("mask", "value"))
            heavy = None if heavy.isEmpty() else heavy
        light = rows if heavy is None else rows.join(heavy, ["mask", "value"], "left_anti")
        found = light.select("fp", "mask", "value", F.pmod(F.xxhash64("mask", "value"), F.lit(shards)).alias("shard")).groupBy("shard").applyInPandas(_compare, "a long, b long")
        out = found if out is None else out.unionAll(found)
        if heavy is None:
            return out
        left = rows.join(heavy, ["mask", "value"], "left_semi").select("fp", "mask").distinct()
    return out


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    buckets = rows.groupby(["mask", "value"], sort=False).ngroup().to_numpy()
    a, b = forest(rows["fp"].to_numpy().view(np.uint64), buckets)
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def near_duplicates(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable over links of 2 or fewer differing bits)."""
    fps = written(fingerprints(docs, size, seed))
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    trees = components(links(classes)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = classes.join(trees, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
