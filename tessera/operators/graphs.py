"""Cycles and trees of directed graphs without listing paths (GRF02): strongly connected components, and a call tree over them.

Components are found by trimming, colouring and backward closure: nodes without an edge in or out are components of their own;
among the rest each node takes the greatest node that reaches it as its colour, and the nodes of a colour that reach the node it is
named after are one component. Each round is a join with the nodes that changed and an aggregation, combined before the shuffle, and
is cut off from those before by a table in the shared folder. The rounds follow the longest way through the graph, not the
number of paths. Edges with a null end are left out; an empty graph has no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import forget, written


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges that are left when nodes without an edge in or out go, again and again."""
    n = edges.count()
    while n:
        both = edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
        inner = edges.join(both.withColumnRenamed("node", "src"), "src", "left_semi").join(both.withColumnRenamed("node", "dst"), "dst", "left_semi")
        later = written(inner.select("src", "dst"))
        forget(edges)
        edges, before = later, n
        n = later.count()
        if n == before:
            break
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """node, color: the greatest node that reaches it, or itself."""
    colors = written(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("color", F.col("node")).withColumn("new", F.lit(True)))
    while True:
        sent = edges.join(colors.filter("new").select(F.col("node").alias("src"), "color"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("color").alias("_c"))
        got = colors.join(sent, "node", "left")
        more = F.coalesce(F.col("_c") > F.col("color"), F.lit(False))
        later = written(got.select("node", F.when(more, F.col("_c")).otherwise(F.col("color")).alias("color"), more.alias("new")))
        forget(colors)
        colors = later
        if colors.filter("new").isEmpty():
            return colors.select("node", "color")


def strong_components(edges: DataFrame) -> DataFrame:
    """GRF02: node, component (its least node), circular: whether a node can come back to itself. edges: src, dst."""
    plain = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    kept = written(plain)
    nodes = kept.select(F.col("src").alias("node")).union(kept.select("dst")).distinct()
    loops = kept.filter("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loop"))
    left, parts = written(kept.filter("src <> dst")), []
    while True:
        left = _trimmed(left)
        if left.isEmpty():
            break
        colors = written(_coloured(left))
        ends = left.join(colors.select(F.col("node").alias("src"), F.col("color").alias("a")), "src").join(colors.select(F.col("node").alias("dst"), F.col("color").alias("b")), "dst")
        inner = written(ends.filter("a = b").select("src", "dst", F.col("a").alias("color")))
        new = found = written(colors.filter("node = color"))
        while True:
            new = written(inner.join(new.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "color").distinct().join(found.select("node"), "node", "left_anti"))
            if new.isEmpty():
                break
            found = found.unionByName(new)
        found = written(found)
        parts.append(found)
        gone = found.select("node")
        later = written(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
        forget(left)
        left = later
    out = nodes.withColumn("component", F.col("node")).withColumn("many", F.lit(False))
    if parts:
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        least = found.groupBy("color").agg(F.min("node").alias("_least"), (F.count("*") > 1).alias("_many"))
        out = nodes.join(found.join(least, "color").select("node", "_least", "_many"), "node", "left").select("node", F.coalesce("_least", "node").alias("component"), F.coalesce("_many", F.lit(False)).alias("many"))
    return out.join(loops, "node", "left").select("node", "component", (F.col("many") | F.coalesce("loop", F.lit(False))).alias("circular"))


def call_tree(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """GRF02: node, component, circular, depth, parent: each node that the roots reach, once, in the tree of least depths.

    The tree is of components, so a cycle is one node of it, marked circular; parent is the least of the components one level up that
    call into this one, null for roots. Without given roots (node) these are the components that no other calls.
    """
    parts = written(strong_components(edges))
    ends = edges.join(parts.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(parts.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
    between = written(ends.filter("a <> b").select("a", "b").distinct())
    if roots is None:
        first = parts.select("component").distinct().join(between.select(F.col("b").alias("component")), "component", "left_anti")
    else:
        first = roots.join(parts, "node").select("component").distinct()
    new = seen = written(first.withColumn("depth", F.lit(0)).withColumn("parent", F.lit(None).cast(parts.schema["component"].dataType)))
    depth = 0
    while True:
        depth += 1
        step = between.join(new.select(F.col("component").alias("a")), "a").groupBy(F.col("b").alias("component")).agg(F.min("a").alias("parent"))
        new = written(step.join(seen.select("component"), "component", "left_anti").select("component", F.lit(depth).alias("depth"), "parent"))
        if new.isEmpty():
            break
        # one table every few levels, so that the plan of what was seen stays short
        seen = written(seen.unionByName(new)) if depth % 8 == 0 else seen.unionByName(new)
    return parts.join(seen, "component").select("node", "component", "circular", "depth", "parent")
