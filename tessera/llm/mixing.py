"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

The mean repetition rate of a source is target size / actual size. A document's count is the Poisson distribution with
that mean, inverted at a uniform number hashed from the document and the seed, so it is the same in every run and on every
retry. Documents are exploded by their counts and shuffled globally by a hash of document and copy.

Sizes are code points. A null source is a source like any other, a null text has size 0; a source of size 0 gets rate 0
unless its documents' weight is all there is. Repeated rows of one doc_id get the same count; rows without an id draw by
their text. Empty tables give no rows, very long texts only add their size. Columns of docs that carry the names of the
results (n_copies, copy, shuffle_key) are replaced, all others kept as they are; rows with equal keys lie in any order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import inside, outside, written

#: Fixed by the construction of uniform numbers: 52 bits of a SHA-256.
UNIFORM_BITS = 52


def uniform(seed: int, *key: Column | str) -> Column:
    """A number in (0, 1) hashed from the key."""
    text = F.concat_ws("\x1f", F.lit(str(seed)), *(F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("null")) for k in key))
    return (F.conv(F.substring(F.sha2(text, 256), 1, UNIFORM_BITS // 4), 16, 10).cast("double") + 0.5) / float(1 << UNIFORM_BITS)


def rates(docs: DataFrame, temperature: float, weights: dict[str, float] | None, epochs: float) -> DataFrame:
    """source, rate: one row per source of docs (in_source, in_text). Shares are the given weights, or size ** temperature where none are given."""
    sizes = docs.groupBy(F.col("in_source").alias("source")).agg(F.sum(F.coalesce(F.length("in_text"), F.lit(0)).cast("long")).alias("size"))
    if weights is None:
        share = F.pow(F.col("size").cast("double"), F.lit(temperature))
    else:  # a list the caller wrote
        share = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.coalesce("source", F.lit("null"))), F.lit(0.0))
    shared = sizes.withColumn("share", share)
    total = shared.agg(F.sum("size").alias("all_size"), F.sum(F.when(F.col("size") > 0, F.col("share"))).alias("all_share"))
    both = shared.crossJoin(F.broadcast(total))  # one row
    return both.select("source", F.when((F.col("size") > 0) & (F.col("all_share") > 0), F.lit(epochs) * F.col("all_size") * F.col("share") / F.col("all_share") / F.col("size")).otherwise(0.0).alias("rate"))


def poisson_steps(rate: float) -> int:
    """Counts beyond this have a probability below 2 ** -53."""
    return math.ceil(rate + 12 * math.sqrt(rate) + 40)


#: exp(-rate) is a normal number up to here; beyond, distributions are built around their mode.
MOST_PLAIN = 700.0


def cumulative(rate: Column) -> Column:
    """P(count <= k) for k = first_count(rate) and on as an array that ends where a 52-bit uniform number can't reach."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("all"))
    step = lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), F.concat(acc["all"], F.array(F.element_at(acc["all"], -1) + acc["p"] * rate / k)).alias("all"))
    plain = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])
    # probabilities in units of the mode's, then their sums divided by the whole sum
    high = F.greatest(rate, F.lit(MOST_PLAIN))
    mode = F.floor(high).cast("int")
    none = F.struct(F.lit(1.0).alias("p"), F.array().cast("array<double>").alias("all"))
    below = F.aggregate(F.sequence(mode, first_count(high, 0.0) + 1, F.lit(-1)), none, lambda acc, k: F.struct((acc["p"] * k / high).alias("p"), F.concat(F.array(acc["p"] * k / high), acc["all"]).alias("all")), lambda acc: acc["all"])
    above = F.aggregate(F.sequence(mode + 1, F.ceil(high + 12 * F.sqrt(high) + 40).cast("int")), none, lambda acc, k: F.struct((acc["p"] * high / k).alias("p"), F.concat(acc["all"], F.array(acc["p"] * high / k)).alias("all")), lambda acc: acc["all"])
    sums = F.aggregate(F.concat(below, F.array(F.lit(1.0)), above), F.array().cast("array<double>"), lambda acc, p: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)) + p)), lambda acc: F.transform(acc, lambda x: x / F.element_at(acc, -1)))
    return F.when(rate <= MOST_PLAIN, plain).otherwise(sums)


def first_count(rate: Column, most_plain: float = MOST_PLAIN) -> Column:
    """The count that cumulative() starts at; lesser ones have a probability below 2 ** -53."""
    return F.when(rate <= most_plain, 0).otherwise(F.greatest(F.floor(rate - 12 * F.sqrt(rate) - 40), F.lit(0)).cast("int"))


def _identity() -> Column:
    return F.coalesce(F.col("in_doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("in_text").cast("string")))


def _counted(own: DataFrame, temperature: float, weights: dict[str, float] | None, epochs: float, seed: int, most_steps: int) -> DataFrame:
    table = written(rates(own, temperature, weights, epochs).select("source", cumulative(F.col("rate")).alias("cdf"), first_count(F.col("rate")).alias("least")))
    steps = table.agg(F.sum(F.size("cdf"))).first()[0] or 0
    joined = own.join(F.broadcast(table) if steps <= most_steps else table, F.col("in_source").eqNullSafe(F.col("source")))
    drawn = joined.withColumn("u", uniform(seed, _identity()))
    return drawn.withColumn("n_copies", F.col("least") + F.size(F.filter("cdf", lambda c: c < F.col("u")))).select(*own.columns, "n_copies")


def with_counts(docs: DataFrame, temperature: float = 0.5, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 11, most_steps: int = 1_000_000) -> DataFrame:
    """docs with n_copies. The written table of sources is broadcast if its distributions have at most most_steps numbers in
    all; beyond that Spark joins it by shuffles and splits a hot source."""
    own = inside(docs, "n_copies")
    return _counted(own, temperature, weights, epochs, seed, most_steps).select(*outside(own), "n_copies")


def mix(docs: DataFrame, temperature: float = 0.5, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 11, most_steps: int = 1_000_000) -> DataFrame:
    """The columns of docs, then n_copies, copy (from 0) and shuffle_key; rows lie in the order of a global shuffle.

    Rows are dealt to partitions by a hash of the key and sorted there: one shuffle, and no part of the order depends on the
    source, so a hot one spreads over all partitions.
    """
    own = inside(docs, "n_copies", "copy", "shuffle_key")
    counted = _counted(own, temperature, weights, epochs, seed, most_steps).filter("n_copies > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    keyed = copies.withColumn("shuffle_key", F.substring(F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), _identity(), "copy"), 256), 14, 16))
    return keyed.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key").select(*outside(own), "n_copies", "copy", "shuffle_key")


MIX_ORACLE = """
WITH sizes AS (SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS size FROM documents GROUP BY source),
total AS (SELECT sum(size) AS all_size, sum(pow(size, 0.5)) FILTER (size > 0) AS all_share FROM sizes),
rates AS (SELECT source, CASE WHEN size > 0 THEN all_size * pow(size, 0.5) / all_share / size ELSE 0 END AS rate FROM sizes, total),
terms AS (SELECT source, rate, k, exp(-rate + CASE WHEN k > 0 THEN k * ln(rate) ELSE 0 END - lgamma(k + 1)) AS p
  FROM rates, (SELECT unnest(range(0, 120)) AS k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
seeds AS (SELECT doc_id, source, n_chars,
  (('0x' || substr(sha256('11' || chr(31) || doc_id::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM documents),
counted AS (SELECT s.doc_id, s.source, (SELECT count(*) FROM cdf c WHERE c.source = s.source AND c.c < s.u) AS n_copies FROM seeds s)
SELECT doc_id, source, n_copies::BIGINT AS n_copies, copy::BIGINT AS copy,
  substr(sha256('11' || chr(31) || doc_id::VARCHAR || chr(31) || copy::VARCHAR), 14, 16) AS shuffle_key
FROM counted, LATERAL (SELECT unnest(range(0, n_copies)) AS copy)
"""
