"""The segmented index against an index built anew, and the best units against the full ranking."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.commits import Conflict
from tessera.operators import search, segments
from tessera.storage import new_path

UNIT = "unit_id long, paper_id long, content string"
WORDS = ["spin", "wave", "the", "of", "lattice", "gap", "rare", *(f"w{i}" for i in range(40))]


def text(rng):
    return " ".join(rng.choices(WORDS, [4, 4, 40, 40, 2, 2, 0.2, *[1] * 40], k=rng.randrange(1, 40)))


def rows(df):
    return sorted((r.unit_id, r.paper_id, round(r.rank, 9)) for r in df.collect())


def written(root):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(root.removeprefix("file:")) for f in names)


def test_refreshes_equal_a_rebuild(spark, monkeypatch):
    """Nine refreshes with new, changed and deleted units; ranks as of an index built anew, after each fourth."""
    monkeypatch.setattr(segments, "RANGE", 16)
    monkeypatch.setattr(segments.Segments, "FAN", 3)
    monkeypatch.setattr(segments.Segments, "FOLDERS", 2)
    rng = random.Random(1)
    index, units = segments.Segments(spark, new_path(spark)), {}
    for i in range(9):
        changed = {rng.randrange(80): text(rng) if rng.random() < 0.9 else None for _ in range(12)}
        gone = [u for u in range(80) if rng.random() < 0.05]
        gone = [u for u in gone if u not in changed]
        units = {u: t for u, t in (units | changed).items() if u not in gone}
        index.refresh(spark.createDataFrame([(u, u // 5, t) for u, t in changed.items()], UNIT), spark.createDataFrame([(u,) for u in gone], "unit_id long"))
        if i % 4 == 0 and i:
            whole = spark.createDataFrame([(u, u // 5, t) for u, t in units.items()], UNIT)
            for phrases in ([["spin"]], [["the"], ["gap"]], [["spin", "wave"]]):
                assert rows(index.bm25(phrases)) == rows(search.bm25(whole, phrases))
    assert len(index.manifest()["segments"]) < 8
    before = rows(index.bm25([["the"]]))
    index.vacuum()
    assert rows(index.bm25([["the"]])) == before


def test_a_refresh_writes_what_changed(spark):
    rng = random.Random(2)
    root = new_path(spark)
    index = segments.Segments(spark, root)
    index.refresh(spark.createDataFrame([(u, u, text(rng) + f" {rng.random()} {rng.random()}") for u in range(4000)], UNIT))
    before = written(root)
    index.refresh(spark.createDataFrame([(7, 7, "spin wave")], UNIT), spark.createDataFrame([(9,)], "unit_id long"))
    assert written(root) - before < before / 20
    assert index.figures()[0] == 3999


def test_best_units_are_the_full_rankings_first(spark, monkeypatch):
    """Two segments with deletions; the mean size grows beyond what the blocks' bounds are kept for, and they still hold."""
    monkeypatch.setattr(segments, "RANGE", 32)
    rng = random.Random(3)
    index = segments.Segments(spark, new_path(spark))
    units = [(u, u // 5, text(rng) + " spin wave" * rng.randrange(1, 5) * (u // 200 % 5 == 3)) for u in range(3000)]
    index.refresh(spark.createDataFrame(units[:2500], UNIT))
    index.refresh(spark.createDataFrame(units[2400:], UNIT), spark.range(0, 3000, 17).select(F.col("id").alias("unit_id")))
    share = []
    for words in (["the"], ["spin", "wave"], ["rare", "the"], ["the", "missing"]):
        full = index.bm25([[w] for w in sorted(words)]).orderBy("rank", "unit_id").limit(10)
        best, read = index.best(words, 10)
        assert [tuple(r) for r in best.collect()] == [tuple(r) for r in full.collect()]
        share.append(read["opened"] / read["postings"])
    assert share[1] < 0.6
    index.refresh(spark.createDataFrame([(u, u, text(rng) + " of" * 60) for u in range(5000, 6500)], UNIT))
    full = index.bm25([["spin"], ["wave"]]).orderBy("rank", "unit_id").limit(10)
    assert [tuple(r) for r in index.best(["spin", "wave"], 10)[0].collect()] == [tuple(r) for r in full.collect()]


def test_ranges_hold_neighbours_however_many(spark, monkeypatch):
    """Before, units of more than 256 ranges were dealt by a hash, and a range had units from all over its part of the ids."""
    monkeypatch.setattr(segments, "RANGE", 4)
    index = segments.Segments(spark, new_path(spark))
    index.refresh(spark.range(4000).select((F.col("id") * 7).alias("unit_id"), F.col("id").alias("paper_id"), F.lit("spin wave").alias("content")))
    spans = index.blocks(["spin"]).select("range", F.explode("unit_ids").alias("u")).groupBy("range").agg(F.min("u").alias("a"), F.max("u").alias("b"), F.count("*").alias("n")).orderBy("a").collect()
    assert sum(r.n for r in spans) == 4000 and len(spans) >= 1000
    assert all(x.b < y.a for x, y in zip(spans, spans[1:]))


def shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    context, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_postings_are_not_shuffled(spark):
    """Before, a refresh shuffled each posting, here 30 of a unit; now the units' texts alone."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("w"), F.col("id") % 50 * i)), " ")
    index, before = segments.Segments(spark, new_path(spark)), shuffled(spark)
    index.refresh(spark.range(2000).select(F.col("id").alias("unit_id"), F.col("id").alias("paper_id"), words.alias("content")))
    assert shuffled(spark) - before < 2 * 2000
    assert index.figures() == (2000, 30.0)


def test_bounds_are_met_at_any_mean_size(spark, monkeypatch):
    """Before, once the mean had grown, a block was bounded as if its most occurrences were in its shortest unit, and all were opened."""
    monkeypatch.setattr(segments, "RANGE", 16)
    index = segments.Segments(spark, new_path(spark))
    index.refresh(spark.createDataFrame([(u, u, "spin " * 3 if u < 64 else "spin " * 5 + "of " * 200 if u % 2 else "spin") for u in range(400)], UNIT))
    index.refresh(spark.createDataFrame([(u, u, "of " * 200) for u in range(400, 1900)], UNIT))
    best, read = index.best(["spin"], 10)
    assert [r.unit_id for r in best.collect()] == list(range(10))
    assert read["postings"] == 400 and read["opened"] < 120


def test_a_long_unit_is_a_range_of_its_own(spark):
    """Ranges are bounded by their tokens, too; bounds and ranks hold."""
    index = segments.Segments(spark, new_path(spark))
    whole = spark.createDataFrame([(1, 1, "spin"), (2, 1, "spin " * (segments.TOKENS + 1)), (3, 1, None), (4, 2, "spin spin wave"), (4, 2, "spin spin wave")], UNIT)
    index.refresh(whole)
    held = sorted(r.unit_ids for r in index.blocks(None).filter("term IS NULL").collect())
    assert [2] in held and sorted(u for x in held for u in x) == [1, 2, 3, 4]
    assert rows(index.bm25([["spin"]])) == rows(search.bm25(whole.distinct(), [["spin"]]))
    assert [r.unit_id for r in index.best(["spin"], 2)[0].collect()] == [r.unit_id for r in index.bm25([["spin"]]).orderBy("rank", "unit_id").limit(2).collect()]


def test_hard_units(spark):
    """Nulls, empty contents, repeated ids, and an index without units."""
    index = segments.Segments(spark, new_path(spark))
    assert rows(index.bm25([["spin"]])) == [] and index.best(["spin"], 3)[0].count() == 0
    index.refresh(spark.createDataFrame([], UNIT))
    index.refresh(spark.createDataFrame([(1, 1, None), (2, 1, ""), (3, 2, "spin"), (None, 2, "spin")], UNIT))
    whole = spark.createDataFrame([(1, 1, None), (2, 1, ""), (3, 2, "spin")], UNIT)
    assert rows(index.bm25([["spin"]])) == rows(search.bm25(whole, [["spin"]])) and index.figures() == (3, pytest.approx(1 / 3))
    index.refresh(spark.createDataFrame([], UNIT), whole.select("unit_id"))
    assert rows(index.bm25([["spin"]])) == [] and index.figures()[0] == 0


def test_writers_that_cross_are_told(spark):
    root = new_path(spark)
    a, b = segments.Segments(spark, root), segments.Segments(spark, root)
    old = b.log.state()
    a.refresh(spark.createDataFrame([(1, 1, "spin")], UNIT))
    with pytest.raises(Conflict):
        b._save(old, b.manifest())
