"""Near-duplicates by SimHash with bit-sliced comparison, every link checked by the exact Jaccard similarity of word shingles.

Equal sets of shingles form a class. Each class draws 130 minima of hashed shingles, in 26 signatures of five; classes that
share a signature are candidates and get a SimHash of 1024 bits. A pair at 0.8 shares no signature with a probability of
0.672 ** 26, about 3e-5, and its SimHashes differ in 155 of 1024 bits on average (deviation 11.5), so a radius of 206 loses
one in 100,000; closer pairs are lost more rarely. A candidate pair is linked only if its two sets are similar enough. Sets
and SimHashes are computed for the classes that share a signature only, so that those of all others need no disk.

The classes of a signature are first compared with one of them only, round by round, and each round's links join classes to
components; pairs within a component need no comparison. Once such a round links few of its pairs, all pairs whose
SimHashes differ by no more than is usual at 0.8 are compared, and joined to components again. What is left then, or
earlier if it is little, is compared in full: the SimHashes of a signature with up to `most` classes lie as vertical bit planes, whose distances
are counted by carry-save counters; classes of larger signatures are joined by their rarest shingles instead (two sets
at 0.8 share one of the rarest fifth of either), which is exact and which common passages don't crowd. So no pair of a
signature goes unseen, however many classes share it.

Null texts are empty and alike. A text with fewer words than a shingle is one shingle. Sets are of 64-bit hashes. Empty
tables give no rows. Texts are read whole; other columns aren't read; repeated rows get the same component each.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import forget, keyed_texts, record_batch, slices, written
from tessera.llm.components import components
from tessera.llm.simhash import near_pairs, shingles

ARROW = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("signatures", pa.list_(pa.int64()))])
KNOWN = pa.schema([("c", pa.int64()), ("prints", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64()))])
SIGNATURES, MINIMA = 26, 5
PRINTS, RADIUS = 16, 206
#: As many bits differ on average at 0.8.
NEAR = 156
_RNG = np.random.default_rng(2023)
_XOR = _RNG.integers(0, 2**64, SIGNATURES * MINIMA, np.uint64)
_TIMES = _RNG.integers(0, 2**64, SIGNATURES * MINIMA, np.uint64) | np.uint64(1)
_MIX = _RNG.integers(0, 2**64, PRINTS, np.uint64) | np.uint64(1)


def hashed(text: str, size: int, seed: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted."""
    import xxhash

    return np.unique(np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles(text, size)], np.uint64))


def signatures(hashes: np.ndarray, chunk: int = 1024) -> np.ndarray:
    """SIGNATURES hashes, each of MINIMA minima; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(len(_XOR), 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), chunk):
        np.minimum(least, ((hashes[i : i + chunk, None] ^ _XOR) * _TIMES).min(0), out=least)
    out = np.arange(1, SIGNATURES + 1, dtype=np.uint64)  # the same minima in another place are another signature
    for m in least.reshape(SIGNATURES, MINIMA).T:
        out = (out ^ m) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def prints(hashes: np.ndarray, chunk: int = 1 << 12) -> np.ndarray:
    """The SimHash of a set, 64 bits to a long."""
    ones = np.zeros((PRINTS, 64), np.int64)
    for i in range(0, len(hashes), chunk):
        x = hashes[i : i + chunk] * _MIX[:, None]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.astype("<u8").view(np.uint8).reshape(PRINTS, -1, 8), axis=2, bitorder="little").sum(1, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def sets(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """doc_id, t (hash of the text), c (class), n (shingles) and signatures of each row."""

    def of(batches):
        import xxhash

        for b in slices(batches):
            found = [hashed(t, size, seed) for t in b.column(1).to_pylist()]
            names = np.array([xxhash.xxh64_intdigest(h.tobytes(), seed) for h in found], np.uint64).view(np.int64)
            yield record_batch(ARROW, [b.column(0), b.column(2), names, [len(h) for h in found], [signatures(h).view(np.int64) for h in found]])

    return keyed_texts(docs, F.xxhash64("text").alias("t")).mapInArrow(of, "doc_id long, t long, c long, n int, signatures array<long>")


def _hashes(docs: DataFrame, classes: DataFrame, size: int, seed: int) -> DataFrame:
    """c, prints and hashes of classes (t, c), one row each, from the text with the hash t."""

    def of(batches):
        for b in slices(batches):
            found = [hashed(t, size, seed) for t in b.column(1).to_pylist()]
            yield record_batch(KNOWN, [b.column(0), [prints(h).view(np.int64) for h in found], [h.view(np.int64) for h in found]])

    texts = keyed_texts(docs, F.xxhash64("text").alias("t")).groupBy("t").agg(F.first("text").alias("text"))
    return texts.join(classes, "t").select("c", "text").mapInArrow(of, "c long, prints array<long>, hashes array<long>")


def _sizes_allow(n: Column, m: Column, similarity: float) -> Column:
    return F.least(n, m) + 1e-9 >= similarity * F.greatest(n, m)


def _alike(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of classes those whose sets are similar enough."""
    both = pairs.join(known.select(F.col("c").alias("a"), F.col("hashes").alias("_a")), "a").join(known.select(F.col("c").alias("b"), F.col("hashes").alias("_b")), "b")
    common = F.size(F.array_intersect("_a", "_b"))
    return both.filter(common + 1e-9 >= similarity * (F.size("_a") + F.size("_b") - common)).select("a", "b")


def _pivot_pairs(left: DataFrame, similarity: float, round_: int) -> DataFrame:
    """Each class with one other: of the pivots of its signatures, one a signature, that with which it shares the most."""
    drawn = F.min(F.struct(F.xxhash64(F.lit(round_), "c").alias("h"), F.col("c").alias("d"), F.col("n").alias("m"), F.col("root").alias("other")))
    chosen = left.groupBy("s").agg(drawn.alias("p")).select("s", "p.d", "p.m", "p.other")
    met = left.join(chosen, "s").filter((F.col("root") != F.col("other")) & _sizes_allow(F.col("n"), F.col("m"), similarity))
    return met.groupBy("c", "d").count().groupBy("c").agg(F.max_by("d", F.struct("count", "d")).alias("d"))


def _near_prints(similarity: float, radius: int):
    """Pairs within the signatures of a shard: different components, SimHashes within the radius, sizes that allow the similarity."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("s", ignore_index=True)
        sizes = rows.groupby("s", sort=True).size().to_numpy()
        c, n, root = (rows[x].to_numpy() for x in ("c", "n", "root"))
        found = [np.zeros((0, 2), np.int64)]
        for i, j in near_pairs(np.stack(rows["prints"].to_list()).view(np.uint64), np.repeat(np.cumsum(sizes), sizes), radius):
            ok = (root[i] != root[j]) & (np.minimum(n[i], n[j]) + 1e-9 >= similarity * np.maximum(n[i], n[j]))
            found.append(np.unique(np.stack([c[i[ok]], c[j[ok]]], 1), axis=0))
        return pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["c", "d"])

    return compare


def _rarest_pairs(classes: DataFrame, known: DataFrame, similarity: float, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (c, n, root) of different components that may be similar enough: all that share one of their rarest shingles. Second, the table they are read from.

    Shingles are ordered by how many of these classes hold them. Of two sets that are similar enough, the first common shingle
    in this order has as many after it in both sets as the overlap needs. A radius under RADIUS leaves those with SimHashes within it.
    """
    tokens = known.select("c", "hashes").join(classes, "c").select("c", "n", "root", F.explode("hashes").alias("w"))
    often = tokens.groupBy("w").count()
    ranked = tokens.join(often, "w").groupBy("c", "n", "root").agg(F.sort_array(F.collect_list(F.struct("count", "w"))).alias("o"))  # one text's shingles
    first = F.slice("o", F.lit(1), F.col("n") - F.ceil(similarity * F.col("n") - 1e-9).cast("int") + 1)
    some = written(ranked.select("c", "n", "root", F.posexplode(first).alias("at", "x")).filter("x.count > 1").select("x.w", "at", "c", "n", "root").join(known.select("c", "prints"), "c"))
    other = some.select("w", F.col("at").alias("bt"), F.col("c").alias("d"), F.col("n").alias("m"), F.col("root").alias("other"), F.col("prints").alias("others"))
    enough = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("bt")) + 1e-9 >= similarity / (1 + similarity) * (F.col("n") + F.col("m"))
    met = (F.col("root") < F.col("other")) & enough & _sizes_allow(F.col("n"), F.col("m"), similarity)
    if radius < RADIUS:
        met &= sum((F.bit_count(F.col("prints")[k].bitwiseXOR(F.col("others")[k])) for k in range(PRINTS)), F.lit(0)) <= radius
    return some.join(other, "w").filter(met).select("c", "d"), some


def links(docs: DataFrame, rows: DataFrame, similarity: float, size: int, seed: int, most_pairs: float = 4.0, least_gain: float = 0.05, most: int = 256, shard_rows: int = 20_000, trees_of: Callable[[DataFrame], DataFrame] = components) -> DataFrame:
    """(a, b) for each class a that isn't the least of its component, b being the least. rows: the written sets of docs.

    most_pairs: pairs left for each member of a signature at which the rest is compared in full; least_gain: share of a round's
    pairs it must link for another such round; most: classes of a signature that are compared by their SimHashes; trees_of:
    what becomes of links (a, b), of which some may be its earlier results: classes with the same b aren't compared. A round's
    tables are deleted as soon as the next one has been made from them.
    """
    spread = rows.select("c", "n", F.explode("signatures").alias("s"))
    shared = spread.groupBy("s").agg(F.min("c").alias("least"), F.max("c").alias("greatest")).filter("least < greatest").select("s")
    members = written(spread.join(shared, "s").distinct())
    classes = rows.join(members.select("c").distinct(), "c", "left_semi").groupBy("c").agg(F.min("t").alias("t"))
    known = written(_hashes(docs, classes, size, seed))
    trees, gain, round_, radius = None, 1.0, 0, 0
    past = [members]
    while radius < RADIUS:
        named = members.withColumn("root", F.col("c")) if trees is None else members.join(trees.withColumnRenamed("a", "c"), "c", "left").withColumn("root", F.coalesce("b", "c")).drop("b")
        named = written(named)  # once a round; all below reads it
        for table in past:
            forget(table)
        sums = named.groupBy("s", "root").agg(F.count("*").alias("k")).groupBy("s").agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("same"), F.count("*").alias("roots"))
        open_ = written(sums.filter("roots > 1").select("s", "all", ((F.col("all") * F.col("all") - F.col("same")) / 2).alias("pairs")))
        past, read = [named, open_], []
        size = open_.agg(F.sum("pairs"), F.sum("all"), F.max("all")).first()
        if not size[0]:
            break
        if radius or size[0] <= most_pairs * size[1]:
            radius = RADIUS
        elif gain < least_gain:
            radius = NEAR
        if radius:
            few = named.join(open_.filter(F.col("all") <= most).select("s"), "s").join(known.select("c", "prints"), "c")
            shards = max(1, -(-size[1] // shard_rows))
            pairs = few.withColumn("shard", F.pmod(F.xxhash64("s"), F.lit(shards))).groupBy("shard").applyInPandas(_near_prints(similarity, radius), "c long, d long")
            if size[2] > most:
                crowded = written(named.join(open_.filter(F.col("all") > most).select("s"), "s").select("c", "n", "root").distinct())
                rarest, some = _rarest_pairs(crowded, known, similarity, radius)
                pairs, read = pairs.unionAll(rarest), [crowded, some]
        else:
            pairs = _pivot_pairs(named.join(open_.select("s"), "s"), similarity, round_)
        pairs = written(pairs.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct())
        new = written(_alike(pairs, known, similarity))
        linked, round_ = new.count(), round_ + 1
        gain = linked / max(pairs.count(), 1)
        # a signature whose members are of one component stays so
        members = named.drop("root").join(open_.select("s"), "s", "left_semi")
        if linked:  # the trees so far stand for their links, so that rounds don't add up
            before, trees = trees, trees_of(new if trees is None else trees.unionAll(new))
            read += [before] if before is not None else []
        for table in (pairs, new, *read):
            forget(table)
    for table in (*past, known):
        forget(table)
    return trees if trees is not None else trees_of(rows.sparkSession.createDataFrame([], "a long, b long"))


def near_texts(docs: DataFrame, size: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """doc_id, t (xxhash64 of the text) and component (of texts linked by a similarity of shingle sets) of each row."""
    rows = written(sets(docs, size, seed))
    trees = links(docs, rows, similarity, size, seed)
    return rows.select("doc_id", "t", "c").join(trees.select(F.col("a").alias("c"), "b"), "c", "left").select("doc_id", "t", F.coalesce("b", "c").alias("component"))


def _linked(edges: DataFrame) -> DataFrame:
    """All classes with a link as one tree: what has a link needs no other one."""
    root = F.lit(-(1 << 63))
    return written(edges.select(F.explode(F.array("a", "b")).alias("a")).filter(F.col("a") != root).distinct().withColumn("b", root))


def copies(docs: DataFrame, size: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """The distinct doc_id and t of the rows whose text is linked with another row's or equals it."""
    rows = written(sets(docs, size, seed))
    linked = links(docs, rows, similarity, size, seed, trees_of=_linked).select(F.col("a").alias("c"))
    equal = rows.groupBy("c").count().filter("count > 1").select("c")
    return rows.select("doc_id", "t", "c").join(linked.unionAll(equal).distinct(), "c", "left_semi").select("doc_id", "t").distinct()
