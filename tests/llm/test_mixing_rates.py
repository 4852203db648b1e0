import math

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing


@pytest.mark.parametrize("rate", [650.0, 800.0, 2500.5, 50_000.0])
def test_counts_at_high_rates(spark, rate):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("s").alias("source"))
    got = mixing.with_counts(docs, epochs=rate).withColumn("u", mixing.uniform(11, "doc_id")).select("u", "n_copies").collect()
    sums, total = [], 0.0
    for k in range(mixing.poisson_steps(rate) + 1):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        sums.append(total)
    assert all(abs(r.n_copies - sum(c < r.u for c in sums)) <= (min(abs(c - r.u) for c in sums) < 1e-9) for r in got)
    assert abs(sum(r.n_copies for r in got) / 300 - rate) < 5 * math.sqrt(rate / 300)


def test_rows_without_an_id_draw_each_for_itself(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("s").alias("source"), F.lit(1).alias("u"), F.lit(2).alias("cdf"))
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "text", "source", "u", "cdf", "n_copies", "copy", "shuffle_key"]
    assert abs(out.count() - 3000) < 5 * math.sqrt(3000)
    assert out.select("shuffle_key").distinct().count() == out.count()
