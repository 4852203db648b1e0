"""All-pairs and cut-off sums against plain loops."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import vectors

POINT = "id long, x double, y double, z double, q double"


def cloud(n, seed=1, side=10.0):
    rng = random.Random(seed)
    return [(i, *(rng.random() * side for _ in range(3)), rng.random()) for i in range(n)]


def energies(df):
    return {r.id: (r.n, pytest.approx(r.e)) for r in df.collect()}


KERNEL = lambda dx, dy, dz: {"e": F.col("q") / (1 + dx * dx + dy * dy + dz * dz), "n": F.lit(1)}


@pytest.mark.parametrize("skip_self", [True, False])
def test_tiles_equal_the_broadcast(spark, skip_self):
    rows = cloud(300)
    targets, sources = spark.createDataFrame(rows[:40] + rows[:3], POINT), spark.createDataFrame(rows + rows[:2] * 20, POINT)
    sent = vectors.pairwise_sums(targets, sources, KERNEL, skip_self)
    tiled = vectors.pairwise_sums(targets, sources, KERNEL, skip_self, most_sources=10, tile=16)
    assert {r.id: r.n for r in sent.collect()} == {r.id: r.n for r in tiled.collect()} and energies(sent) == energies(tiled)
    assert "Broadcast" not in tiled._jdf.queryExecution().executedPlan().toString()


def test_many_sources_have_an_answer(spark):
    sources = spark.range(200_000).select("id", (F.col("id") % 1000 / 7).alias("x"), (F.col("id") % 97 / 3).alias("y"), F.lit(1.0).alias("z"), F.lit(1.0).alias("q"))
    targets = sources.filter("id % 4000 = 0")
    assert energies(vectors.pairwise_sums(targets, sources, KERNEL)) == energies(vectors.pairwise_sums(targets, sources, KERNEL, most_sources=200_000))


def plain_pairs(rows, cutoff, box):
    images = [range(-math.ceil((cutoff + 30) / b), math.ceil((cutoff + 30) / b) + 1) if box else [0] for b in box or (1, 1, 1)]
    out = []
    for a, b in itertools.product(rows, rows):
        for shift in itertools.product(*images):
            d = [b[i + 1] - a[i + 1] + (shift[i] * box[i] if box else 0) for i in range(3)]
            if sum(x * x for x in d) <= cutoff * cutoff and (a[0] != b[0] or any(d)):
                out.append((a[0], b[0], *(round(x, 4) + 0.0 for x in d)))
    return sorted(out)


@pytest.mark.parametrize("cutoff,box", [(2.0, None), (2.0, (10.0, 10.0, 10.0)), (2.5, (10.0, 7.0, 4.0)), (4.0, (10.0, 5.0, 3.0)), (0.5, (10.0, 10.0, 10.0)), (30.0, None)])
def test_neighbours_are_all_pairs_within_the_cutoff(spark, cutoff, box):
    rows = [(i, *(x - 15 if i % 3 else x for x in p), q) for i, *p, q in cloud(40)]  # also outside the box
    df = spark.createDataFrame(rows, POINT)
    got = vectors.neighbours(df, df, cutoff, box)
    assert sorted((r.id, r.s_id, *(round(r[c], 4) + 0.0 for c in ("dx", "dy", "dz"))) for r in got.collect()) == plain_pairs(rows, cutoff, box)


def test_points_on_borders(spark):
    rows = [(i, x, 0.0, 0.0, 1.0) for i, x in enumerate([0.0, 10.0, -1e-18, 9.999999999999998, 5.0, 20.0])]
    got = vectors.neighbours(spark.createDataFrame(rows, POINT), spark.createDataFrame(rows, POINT), 1.0, (10.0, 10.0, 10.0))
    assert {(r.id, r.s_id) for r in got.collect()} == {(a, b) for a in (0, 1, 2, 3, 5) for b in (0, 1, 2, 3, 5) if a != b}


def test_rows_of_the_grid_grow_with_the_points(spark):
    """At a constant density, candidates per point stay the same."""
    found = []
    for n in (1000, 8000):
        df = spark.createDataFrame(cloud(n, 2, side=n ** (1 / 3)), POINT)
        side = n ** (1 / 3)
        found.append(vectors.neighbours(df, df, 1.0, (side,) * 3).count() / n)
    assert found[1] == pytest.approx(found[0], rel=0.15)


def test_missing_coordinates_and_bad_cutoffs(spark):
    df = spark.createDataFrame([(1, None, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 0.0, 1.0), (3, 0.0, 0.0, 0.5, 1.0)], POINT)
    assert {(r.id, r.s_id) for r in vectors.neighbours(df, df, 1.0).collect()} == {(2, 3), (3, 2)}
    with pytest.raises(ValueError, match="cut-off"):
        vectors.neighbours(df, df, 0.0)


def test_nearest_in_blocks(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, [rng.random() for _ in range(8)]) for i in range(200)], "vec_id long, embedding array<double>")
    queries = df.withColumnRenamed("vec_id", "query_id").filter("query_id % 3 = 0")
    whole = sorted(map(tuple, vectors.nearest(df, queries, 4).collect()))
    assert whole == sorted(map(tuple, vectors.nearest(df, queries, 4, most_numbers=100).collect())) and len(whole) == 67 * 4


def by_loops(rows, cutoff=math.inf):
    out = {}
    for a, b in itertools.product(rows, rows):
        d = math.dist(a[1:4], b[1:4])
        if a[0] != b[0] and d <= cutoff:
            n, e = out.get(a[0], (0, 0.0))
            out[a[0]] = n + 1, e + (b[4] / d if d else math.inf)
    return {k: (n, pytest.approx(e)) for k, (n, e) in out.items()}


CHARGES = lambda dx, dy, dz: {"e": vectors.over(F.col("q"), F.sqrt(dx * dx + dy * dy + dz * dz)), "n": F.lit(1)}


def test_points_at_one_place_have_infinite_terms_and_are_asked_once(spark):
    """Failed before: a division by zero; and each copy met each copy."""
    rows = [(i, *p, q) for i, *p, q in cloud(30)] + [(100 + i, *p, q) for i, *p, q in cloud(10)] + [(200, 50.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, POINT)
    assert energies(vectors.cutoff_sums(df, df, CHARGES, 4.0)) == by_loops(rows, 4.0)
    assert energies(vectors.cutoff_sums(df, df, CHARGES, 4.0, (1000.0,) * 3)) == by_loops(rows, 4.0)
    assert energies(vectors.pairwise_sums(df, df, CHARGES)) == by_loops(rows) == energies(vectors.pairwise_sums(df, df, CHARGES, most_sources=3, tile=5))
    many = spark.range(20_000).selectExpr("id", "cast(id % 10 AS double) AS x", "0D AS y", "0D AS z", "1D AS q")
    got = {(r.n, r.e) for r in vectors.cutoff_sums(many, many, CHARGES, 1.5).collect()}
    assert got == {(3999, math.inf), (5999, math.inf)}
    far = vectors.pairwise_sums(many, many, KERNEL, most_sources=0, tile=4, axes="x").agg(F.min("n"), F.max("n")).first()
    assert tuple(far) == (19_999, 19_999)


def test_blocks_equal_the_joins(spark):
    """Arrays in tiles; didn't exist before: a pair was a row of a join."""
    rows = [*cloud(150), (200, 1.0, 1.0, 1.0, None), (201, None, 1.0, 1.0, 2.0)]
    targets, sources = spark.createDataFrame(rows[:40] + rows[:3] + rows[-1:], POINT), spark.createDataFrame(rows + rows[:2] * 20, POINT)
    kernel = lambda dx, dy, dz, s: {"e": s["q"] / (1 + dx * dx + dy * dy + dz * dz)}
    for skip_self in (True, False):
        got = vectors.block_sums(targets, sources, kernel, ["e"], skip_self, tile=16, block=64)
        want = vectors.pairwise_sums(targets, sources, KERNEL, skip_self)
        assert {r.id: r.e and pytest.approx(r.e) for r in got.collect()} == {r.id: r.e for r in want.collect()}
    one, two = spark.createDataFrame(rows[:1], POINT), spark.createDataFrame(rows[:1] + rows[150:151], POINT)
    assert vectors.block_sums(one, one, kernel, ["e"]).count() == 0 == vectors.block_sums(one.limit(0), one, kernel, ["e"]).count()
    assert {r.id: r.e for r in vectors.block_sums(two, two, kernel, ["e"]).collect()} == {0: None, 200: pytest.approx(rows[0][4] / (1 + sum((x - 1) ** 2 for x in rows[0][1:4])))}


def test_nearest_of_copies_and_odd_vectors(spark):
    """Equal vectors tie exactly, whatever their place in a tile; vectors without a score come last. As rows of a join would give."""
    rng = random.Random(5)
    some = [[rng.random() - 0.5 for _ in range(7)] for _ in range(6)]
    odd = [None, [0.0] * 7, [1.0, None, *[0.0] * 5], [1.0, 2.0], []]
    rows = [(i, some[i * i % 6]) for i in range(150)] + [(200 + i, v) for i, v in enumerate(odd)] + [(300, [math.nan, *[1.0] * 6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.withColumnRenamed("vec_id", "query_id").filter("query_id % 30 = 0 OR query_id >= 200")
    scored = df.crossJoin(queries.withColumnRenamed("embedding", "q")).withColumn("score", F.when((F.col("vec_id") != 201) & (F.col("query_id") != 201), vectors.cosine("embedding", "q")))

    def ranked(hits):
        out = {}
        for r in hits.collect():
            out.setdefault(r.query_id, []).append((r.score is None, -math.inf if r.score is None or math.isnan(r.score) else -r.score, r.vec_id))
        return {q: sorted(x) for q, x in out.items()}

    want = ranked(scored)
    for k, numbers in ((8, 2_000_000), (8, 90), (153, 500)):
        assert ranked(vectors.nearest(df, queries, k, most_numbers=numbers)) == {q: v[:k] for q, v in want.items()}
