"""Clustering by kd-trees against plain rounds over all vectors."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import kd_clusters, queries
from tests.conftest import DATA

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k=8, rounds=10, dims=64):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(1024 * x))) for x in v]) for i, v in kept]
    mark = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), z) for z, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for z in range(len(centroids)):
            if own := [v for (_, v), o in zip(kept, of, strict=True) if o == z]:
                centroids[z] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = lambda z: sum(d for _, c, d in found if z in (c, None))
    digest = lambda z: hashlib.sha256(",".join(map(str, centroids[z])).encode()).hexdigest()
    return sorted(((i, z, d, inertia(z), inertia(None), digest(z)) for i, z, d in found), key=repr)


def got(df, **more):
    return sorted((tuple(r) for r in kd_clusters.cluster(df, **more).collect()), key=repr)


def test_smoke_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted((tuple(r) for r in queries.op13_kd_clusters(spark, DATA).collect()), key=repr) == plain(rows)


def test_hard_rows(spark):
    rng = random.Random(2)
    vector = lambda: [rng.choice([-2, -1, 0, 1, 2]) / 1024 + rng.random() / 5000 for _ in range(64)]
    rows = [(i, vector()) for i in range(90)]
    rows += [(1000 + i, rows[0][1]) for i in range(70)] + [rows[1]] * 5 + [(None, vector()), (None, vector())]
    rows += [(2000, None), (2001, []), (2002, vector()[:63]), (2003, [*vector(), 1.0]), (2004, [None, *vector()[1:]]), (2005, [math.nan, *vector()[1:]]), (2006, [-math.inf, *vector()[1:]]), (2007, [1e300, *vector()[1:]]), (2008, [-1e12, *vector()[1:]])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("v", "x", "ids", "cluster", "_mark")})
    assert got(df) == plain(rows)


def test_ties_go_to_the_smaller_number(spark):
    """Vectors on a grid of two numbers, of which many have equal distances."""
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(2)) for _ in range(4)]) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df, dims=4, rounds=3) == plain(rows, dims=4, rounds=3)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, n):
    rows = [(i, [float(i)] * 64) for i in range(n)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_whole_nodes_are_assigned():
    """Well-separated groups: most vectors are never compared one by one."""
    rng = np.random.default_rng(1)
    middles = rng.integers(-100_000, 100_000, (8, 64))
    points = (middles[rng.integers(0, 8, 8192)] + rng.integers(-50, 50, (8192, 64))).astype(np.int32)
    order, nodes, sums, boxes = kd_clusters.build(points)
    tree = kd_clusters.Tree({"ids": order, "points": points[order].tobytes(), "nodes": nodes.tobytes(), "sums": sums.tobytes(), "boxes": boxes.tobytes()}, 64)
    (whole, _), (places, _, _) = tree.assigned(middles)
    assert (sums[0] == points.sum(0, dtype=np.int64)).all() and len(places) < 1000
    assert (nodes[whole, 1] - nodes[whole, 0]).sum() + len(places) == 8192
