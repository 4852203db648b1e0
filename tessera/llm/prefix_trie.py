"""The trie of all conversations' prefixes, summed up by leaf-peeling message passing.

A node is a distinct sequence of turns; its key is the XOR of 128-bit hashes of each turn with its place. Members, ends and
children are counted by aggregation, combined before the shuffle, as the root holds all conversations. Subtree totals then go up
by messages: a node holds a counter of children that aren't finished, and a node whose counter is 0 sends its totals to its
parent, until only the root's is left. A plain trie would need as many rounds as the longest conversation has turns. So the
nodes are first laid out in paths: a node belongs to the member with the least hash, and all nodes of one member follow each
other down. A path is finished as a whole when nothing that hangs from it is open; within it, totals are running sums. On the
way up from a node the path changes only where a larger set of members brings a smaller hash, which for N members happens
about ln N times; so a few rounds do, also for a conversation with a branch at every turn.

Turns are numbered without one task per conversation: the sorted table is cut into ranges, and what lies before a range is
added to it. Running sums go by blocks of turns in the same way. A conversation or a node with any share of the rows is spread.
Only a node's digest needs one task, as SHA-256 does; the numbers are sorted and joined in chunks beforehand, and the
task streams over them.

Null roles and texts are empty. Rows of one conversation and turn (also null turns, which come first) go by role, then text;
repeated rows are turns of their own. Rows with a null conv_id belong to no conversation and are left out. A turn's number
doesn't matter beyond its order. Texts count by code points, whole. An empty table has no conversations and gives no nodes.
Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._common import forget, written

#: Turns of a block of running sums; conversations of a chunk of a digest.
BLOCK, CHUNK = 4096, 4096


def ranked(turns: DataFrame) -> DataFrame:
    """conv, rank (from 1), g1, g2 (hashes of role and text), len (code points of the text)."""
    plain = turns.select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("conv IS NOT NULL")
    keys = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    ordered = plain.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = written(ordered.select("conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"), F.xxhash64(F.lit(1), "role", "text").alias("g1"), F.xxhash64(F.lit(2), "text", "role").alias("g2"), F.length("text").cast("long").alias("len")))
    ranges = rows.groupBy("conv", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    placed = rows.join(ranges.select("conv", "part", (F.col("first") - before).alias("zero")), ["conv", "part"])
    out = written(placed.select("conv", (F.col("row") - F.col("zero") + 1).alias("rank"), "g1", "g2", "len"))
    forget(rows)
    return out


def rebuilt(rows: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """conv, depth, x1, x2, len of every rebuilt conversation's turns, and of depth 0 for each."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    base = F.col("conv") - F.col("conv") % group
    first = rows.filter((F.col("rank") < heads) & (F.col("conv") % group == 0))
    convs = rows.filter("rank = 1").select("conv", base.alias("base"))
    # a base has fewer than `heads` rows here and meets the conversations of its own hundred
    head = convs.join(first.select(F.col("conv").alias("base"), "rank", "g1", "g2", "len"), "base").filter(F.col("rank") <= h).select("conv", F.col("rank").alias("depth"), "g1", "g2", "len")
    there = first.groupBy(F.col("conv").alias("base")).agg(F.count("*").alias("there"))
    tail = rows.filter(F.col("rank") > h).withColumn("base", base).join(there, "base", "left")
    tail = tail.select("conv", (F.col("rank") - h + F.least(h, F.coalesce("there", F.lit(0)))).alias("depth"), "g1", "g2", "len")
    hashed = head.unionByName(tail).select("conv", "depth", F.xxhash64(F.lit(1), "g1", "g2", "depth").alias("x1"), F.xxhash64(F.lit(2), "depth", "g2", "g1").alias("x2"), "len")
    zero = F.lit(0).cast("long")
    return hashed.unionByName(convs.select("conv", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), zero.alias("len")))


def running(rows: DataFrame, key: str, down: bool, added: dict[str, tuple[Column, str]]) -> DataFrame:
    """rows with a running sum or XOR for each name of added, over depth (down: from the greatest) within key, by blocks.

    added: name to (column, "sum" or "bit_xor"). The blocks of a key, one for BLOCK of its depths, are summed up apart.
    """
    rows = rows.withColumn("_block", F.floor(F.col("depth") / BLOCK))
    at = F.desc if down else F.asc
    inside = Window.partitionBy(key, "_block").orderBy(at("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(key).orderBy(at("_block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy(key, "_block").agg(*(getattr(F, f)(c).alias(f"_t_{n}") for n, (c, f) in added.items()))
    before = whole.select(key, "_block", *(F.coalesce(getattr(F, f)(f"_t_{n}").over(across), F.lit(0)).alias(f"_b_{n}") for n, (_, f) in added.items()))
    here = rows.withColumns({f"_i_{n}": getattr(F, f)(c).over(inside) for n, (c, f) in added.items()}).join(before, [key, "_block"])
    join = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
    return here.select(*(c for c in rows.columns if c != "_block"), *(join[f](F.col(f"_i_{n}"), F.col(f"_b_{n}")).alias(n) for n, (_, f) in added.items()))


def nodes(members: DataFrame) -> DataFrame:
    """A row per node: depth, p1, p2, q1, q2 (its parent's key), len, conv_id, path, n_convs, n_ends, n_children, parent_conv_id, parent_path."""
    least = F.min(F.struct(F.xxhash64("conv").alias("mark"), "conv"))
    counted = members.groupBy("depth", "p1", "p2").agg(F.min("conv").alias("conv_id"), least.alias("least"), F.count("*").alias("n_convs"), F.first("q1").alias("q1"), F.first("q2").alias("q2"), F.first("len").alias("len"))
    found = written(counted.select("depth", "p1", "p2", "q1", "q2", "len", "conv_id", F.col("least.conv").alias("path"), "n_convs"))
    below = found.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    parents = written(found.join(below, ["depth", "p1", "p2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    forget(found)
    above = parents.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("parent_path"))
    out = written(parents.join(above, ["depth", "q1", "q2"], "left"))
    forget(parents)
    return out


def peeled(found: DataFrame) -> DataFrame:
    """path, at (the depth of the node that it hangs from, in parent_path), n_leaves, saved: totals of each path and all below it."""
    own = found.groupBy("path").agg(F.min(F.struct("depth", "parent_path")).alias("top"), F.sum((F.col("n_children") == 0).cast("long")).alias("n_leaves"), F.sum("saved").alias("saved"))
    paths = own.select("path", F.col("top.parent_path").alias("parent_path"), (F.col("top.depth") - 1).alias("at"), "n_leaves", "saved")
    hanging = found.filter("parent_path <> path").groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("open"))
    now = written(paths.join(hanging, "path", "left").withColumn("open", F.coalesce("open", F.lit(0))))
    finished = []
    while True:
        done = now.filter("open = 0")
        finished.append(done.select("path", "parent_path", "at", "n_leaves", "saved"))
        sent = done.filter("parent_path IS NOT NULL").groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("_n"), F.sum("n_leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        got = now.filter("open > 0").join(sent, "path", "left")
        plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
        later = written(got.select("path", "parent_path", "at", plus("n_leaves", "_leaves").alias("n_leaves"), plus("saved", "_saved").alias("saved"), (F.col("open") - F.coalesce("_n", F.lit(0))).alias("open")))
        if later.isEmpty():
            break
        now = later
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    return out


def ends(members: DataFrame) -> DataFrame:
    """depth, p1, p2, ends_sha256 of the nodes where a conversation ends."""
    chunks = members.filter("is_end").groupBy("depth", "p1", "p2", F.floor(F.col("conv") / CHUNK).alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    schema = pa.schema([("depth", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("ends_sha256", pa.string())])

    def digests(batches):
        last, state = None, None
        for b in batches:
            out: list[tuple] = []
            for *node, ids in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if node != last:
                    if last:
                        out.append((*last, state.hexdigest()))
                    last, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*last, state.hexdigest()), schema.types, strict=True)], schema=schema)

    keys = ["depth", "p1", "p2"]
    ordered = chunks.repartition(*keys).sortWithinPartitions(*keys, "chunk").select(*keys, "ids")
    return ordered.mapInArrow(digests, "depth long, p1 long, p2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, turn, role, text. saved_tokens counts code points: what a node's members but one needn't process again.
    """
    rows = ranked(turns)
    chain = written(rebuilt(rows))
    forget(rows)
    prefixes = running(chain, "conv", False, {"p1": (F.col("x1"), "bit_xor"), "p2": (F.col("x2"), "bit_xor")})
    last = chain.groupBy("conv").agg(F.max("depth").alias("last"))
    members = written(prefixes.join(last, "conv").select("conv", "depth", "p1", "p2", F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"), "len", (F.col("depth") == F.col("last")).alias("is_end")))
    forget(chain)
    found = nodes(members).withColumn("saved", (F.col("n_convs") - 1) * F.col("len"))
    totals = peeled(found)
    messages = totals.filter("parent_path IS NOT NULL").groupBy(F.col("parent_path").alias("path"), F.col("at").alias("depth")).agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
    with_messages = written(found.join(messages, ["path", "depth"], "left"))
    none = F.lit(0)
    summed = running(with_messages, "path", True, {"n_leaves": ((F.col("n_children") == 0).cast("long") + F.coalesce("_leaves", none), "sum"), "saved_tokens": (F.col("saved") + F.coalesce("_saved", none), "sum")})
    out = summed.join(ends(members), ["depth", "p1", "p2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
