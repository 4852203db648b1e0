"""Strong components and call trees against plain searches."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import graphs


def reach(edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    found = {}
    for n in {x for e in edges for x in e}:
        seen, todo = set(), [n]
        while todo:
            for m in out[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        found[n] = seen
    return found


def plain_components(edges):
    r = reach(edges)
    return {n: (min({n, *(m for m in r[n] if n in r[m])}), n in r[n]) for n in r}


def plain_tree(edges):
    parts = plain_components(edges)
    between = {(parts[a][0], parts[b][0]) for a, b in edges} - {(c, c) for c, _ in parts.values()}
    level = {c: (0, None) for c, _ in parts.values() if not any(b == c for _, b in between)}
    depth = 0
    while True:
        depth += 1
        new = {}
        for a, b in sorted(between):
            if level.get(a, (None,))[0] == depth - 1 and b not in level and b not in new:
                new[b] = (depth, a)
        if not new:
            return {n: (c, circular, *level[c]) for n, (c, circular) in parts.items()}
        level |= new


CASES = {
    "random": [(random.Random(1).randrange(40) * 0 + a, b) for a, b in {(r.randrange(60), r.randrange(60)) for r in [random.Random(2)] for _ in range(75)}],
    "shapes": [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (6, 6), (7, 8), (8, 9), (9, 10), (10, 8), (9, 11), (12, 13)],
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_against_plain_searches(spark, case):
    edges = CASES[case]
    df = spark.createDataFrame([*edges, *edges[:3], (None, 1), (2, None)], "src long, dst long")
    assert {r.node: (r.component, r.circular, r.depth, r.parent) for r in graphs.call_tree(df).collect()} == plain_tree(edges)


def test_names_and_empty_graphs(spark):
    df = spark.createDataFrame([("main", "f"), ("f", "g"), ("g", "f"), ("g", "h")], "src string, dst string")
    got = {r.node: (r.component, r.circular, r.depth, r.parent) for r in graphs.call_tree(df, spark.createDataFrame([("f",)], "node string")).collect()}
    assert got == {"f": ("f", True, 0, None), "g": ("f", True, 0, None), "h": ("h", False, 1, "f")}
    assert graphs.call_tree(df.limit(0)).count() == 0


def test_many_paths_take_few_rows(spark):
    """Layers of 300 nodes, each calling ten of the next: some 10^20 paths, and a cycle over all layers for a third of them."""
    n, layers = 300, 20
    edges = spark.range(n * layers).crossJoin(spark.range(10).withColumnRenamed("id", "j")).select(F.col("id").alias("src"), ((F.floor(F.col("id") / n) + 1) * n + (F.col("id") * 7 + F.col("j") * 31) % n).alias("dst"))
    back = spark.range(100).select((F.col("id") + n * layers).alias("src"), F.col("id").alias("dst"))
    got = graphs.strong_components(edges.unionByName(back)).groupBy("circular").count().collect()
    assert sum(r["count"] for r in got) == n * (layers + 1)
