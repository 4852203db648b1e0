"""Steps whose work must grow with their input: what copies and common words cost."""

import math

from pyspark.sql import functions as F

from tessera.functions import hooks
from tessera.operators import code, cpp, identity, search


def test_embedding_counts_once(spark):
    """Before, each of the numbers counted all words again, within each other number's length."""
    rows = spark.createDataFrame([(1, "b a a"), (2, None), (3, "  "), (4, " ".join(f"w{i}" for i in range(20_000)))], "id long, text string")
    got = {r.id: r.e for r in rows.select("id", hooks.embed(F.col("text"), 64).alias("e")).collect()}
    assert all(len(v) == 64 for v in got.values()) and set(got[2]) == set(got[3]) == {None}
    a, b = (spark.range(1).select(F.pmod(F.xxhash64(F.lit(w)), F.lit(64)).alias("p")).first().p for w in "ab")
    assert math.isclose(got[1][a], 2 / 5**0.5, rel_tol=1e-6) and math.isclose(got[1][b], 1 / 5**0.5, rel_tol=1e-6)
    assert math.isclose(sum(x * x for x in got[4]), 1, rel_tol=1e-5)


def test_containment_meets_one_key_a_window(spark):
    """Before, 4,000 stems with one start met 4,000 keys each."""
    start = "the same start of many a text, "
    texts = spark.range(4000).select("id", F.concat(F.lit(start), F.lpad(F.col("id").cast("string"), 30, "x")).alias("text"))
    stems, keys = texts.select(F.col("text").alias("stem")), texts.select((F.col("id") + 7).alias("ordinal"), F.substring("text", 1, 45).alias("key"))
    found = identity.by_containment(stems, keys)
    assert found.count() == 4000 and {r.match for r in found.select("match").distinct().collect()} == {(start + "x" * 30)[:45]}


def test_postings_are_made_without_a_shuffle(spark):
    units = spark.createDataFrame([(1, 5, "The cat, the Hat"), (2, 5, None), (3, 6, "hat")], "unit_id long, paper_id long, content string")
    found = search.postings(units)
    got = {(r.term, r.unit_id, r.paper_id, r.size, tuple(r.positions)) for r in found.collect()}
    assert got == {("the", 1, 5, 4, (0, 2)), ("cat", 1, 5, 4, (1,)), ("hat", 1, 5, 4, (3,)), ("hat", 3, 6, 1, (0,))}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_edit_distance_compares_different_titles_once(spark):
    """Before, each copy of a title was compared with each copy of another."""
    rows = spark.createDataFrame([(1, "b", "spin"), (2, "b", "spin"), (3, "b", "spun"), (4, "c", "spin"), (5, "b", None), (6, "b", "glass")], "id long, block string, title string")
    found = identity.edit_matches(rows.withColumnRenamed("id", "probe_id"), rows.withColumnRenamed("id", "paper_id"), "block", 1)
    got = {(r.probe_id, r.paper_id, r.distance) for r in found.collect()}
    assert got == {(a, b, int(3 in (a, b) and a != b)) for a in (1, 2, 3) for b in (1, 2, 3)} | {(4, 4, 0), (6, 6, 0)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [block") == 2


def _evenly_parsed(found, rows):
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    return sum(r["count"] for r in tasks) == rows and len(tasks) > 1 and max(r["count"] for r in tasks) < rows


def test_cpp_files_are_parsed_by_all_tasks(spark):
    """Before, one task parsed all files of a table that lies in one small file."""
    files = spark.range(0, 2000, 1, 1).select(F.concat(F.lit("f"), "id").alias("path"), F.lit("class A { int x; };").alias("code"))
    assert _evenly_parsed(cpp.cpp_constructs(files), 4000)


def test_python_files_are_parsed_by_all_tasks(spark):
    """Before, one task parsed all files of a table that lies in one small file."""
    files = spark.range(0, 2000, 1, 1).select(F.concat(F.lit("f"), "id").alias("path"), F.lit("import os").alias("code"))
    assert _evenly_parsed(code.python_symbols(files), 2000)
