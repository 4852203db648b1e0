"""Ordered operators: trims, packings, budgets, differences, carried values (WIN06-12, SRT, AGG13)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import storage

#: Bits of the number of rows in a block of a large group.
BLOCK_BITS = 16


def trim_history(rows: DataFrame, group: str, order: str, size: Column, most: int) -> DataFrame:
    """WIN06: the newest rows of each group whose sizes sum to at most `most`; older ones are dropped."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return rows.withColumn("_s", F.sum(size).over(w)).filter(F.col("_s") <= most).drop("_s")


def _folded(rows: DataFrame, group: str, order: str, size: Column, start: Column, step) -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(size.cast("long"), F.lit(0)).alias("s"))))
    return rows.groupBy(group).agg(items.alias("_items")).withColumn("_f", F.aggregate("_items", start, step))


def _any_large(rows: DataFrame, group: str, most_rows: int) -> bool:
    return not rows.groupBy(group).count().filter(F.col("count") > most_rows).isEmpty()


def _in_order(rows: DataFrame, group: str, order: str, size: Column) -> DataFrame:
    """group, order, _s (size), _row (rising in the order of the groups' rows), _block: written, so that the numbers stay."""
    plain = rows.select(group, F.col(order).cast("long").alias(order), F.coalesce(size.cast("long"), F.lit(0)).alias("_s"))
    keys = [group, order, "_s"]
    return storage.written(plain.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id()).withColumn("_block", F.shiftright("_row", BLOCK_BITS)))


def _each_run(batches, keys: tuple[str, ...]):
    """Tables of consecutive rows with equal keys; what is held at once is one such run."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        ids = [b.column(b.schema.get_field_index(k)).dictionary_encode("encode") for k in keys]
        new = np.zeros(b.num_rows, bool)
        for x in ids:
            new[1:] |= np.diff(x.indices.to_numpy()) != 0
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            if start == end:
                continue
            own = tuple(x[start].as_py() for x in ids)
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(start, end - start))
            last = own
    if held:
        yield pa.Table.from_batches(held)


class _Fold:
    """What filling batches does with a block of rows, whatever is in the open batch when it begins.

    A batch that begins at row j ends before the first row that would overflow it; prefix sums find that row. A batch open from
    before with `used` in it ends before row cut(used); from there on all goes as from a batch that begins there.
    """

    def __init__(self, sizes: np.ndarray, most: int):
        self.n, self.most = len(sizes), most
        self.sums = np.concatenate([[0], np.cumsum(sizes)])
        later = self.sums[: self.n]
        filled = np.searchsorted(self.sums, later, "right")  # the first row behind one with a size
        over = np.searchsorted(self.sums, later + most, "right") - 1
        self.next = np.maximum(np.maximum(filled, over), np.arange(1, self.n + 1)).tolist()

    def cut(self, used: int) -> int:
        filled = int(np.searchsorted(self.sums, -used, "right")) if not used else 0
        return max(filled, int(np.searchsorted(self.sums, self.most - used, "right")) - 1, 0)

    def ends(self) -> tuple[list[int], list[int], list[int], int]:
        """For each row where an open batch can end: the sum up to it with itself, what is used at the block's end, and the batches begun; and the block's sum."""
        used, begun = [0] * (self.n + 1), [0] * (self.n + 1)
        total = int(self.sums[-1])
        for j in range(self.n - 1, -1, -1):
            at = self.next[j]
            used[j], begun[j] = (used[at], begun[at] + 1) if at < self.n else (total - int(self.sums[j]), 1)
        last = min(self.cut(0) + 1, self.n)
        return self.sums[1 : last + 1].tolist(), used[:last], begun[:last], total

    def batches(self, used: int, batch: int) -> np.ndarray:
        starts, at = np.zeros(self.n, np.int64), self.cut(used)
        while at < self.n:
            starts[at] = 1
            at = self.next[at]
        return batch + np.cumsum(starts)


def _packed_by_blocks(rows: DataFrame, group: str, order: str, size: Column, most: int) -> DataFrame:
    placed = _in_order(rows, group, order, size)
    kind = placed.schema[group].dataType.simpleString()
    by_block = placed.repartition("_block").sortWithinPartitions("_block", "_row")

    def summed(batches):
        for t in _each_run(batches, ("_block", group)):
            fold = _Fold(t.column("_s").to_numpy(), most)
            sums, used, begun, total = fold.ends()
            row = [[t.column(group)[0].as_py()], [t.column("_block")[0].as_py()], [sums], [used], [begun], [total]]
            types = [t.schema.field(group).type, pa.int64(), *[pa.list_(pa.int64())] * 3, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, types, strict=True)], names=[group, "_block", "sums", "used", "begun", "total"])

    summaries = by_block.mapInArrow(summed, f"`{group}` {kind}, _block long, sums array<long>, used array<long>, begun array<long>, total long")

    def chained(batches):
        """Goes from block to block of a group; of each it reads as many rows as one batch can hold."""
        last, used, batch = None, 0, 0
        for b in batches:
            names = b.schema.names
            out: list[list] = [[], [], [], []]
            for row in b.to_pylist():
                own = (row[group],)
                if own != last:
                    last, used, batch = own, 0, 0
                for c, v in zip(out, (row[group], row["_block"], used, batch), strict=True):
                    c.append(v)
                at = 0 if not row["sums"] else max(next((i for i, x in enumerate([0, *row["sums"]]) if used + x > 0), len(row["sums"])), int(np.searchsorted(np.array(row["sums"]), most - used, "right")))
                used, batch = (row["used"][at], batch + row["begun"][at]) if at < len(row["used"]) else (used + row["total"], batch)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, [b.schema.field(names.index(group)).type, *[pa.int64()] * 3], strict=True)], names=[group, "_block", "_used", "_batch"])

    entries = storage.written(summaries.repartition(group).sortWithinPartitions(group, "_block").mapInArrow(chained, f"`{group}` {kind}, _block long, _used long, _batch long"))
    e = entries.select(F.col(group).alias("_g"), F.col("_block").alias("_b"), "_used", "_batch")
    joined = placed.join(e, (F.col("_block") == F.col("_b")) & F.col(group).eqNullSafe(F.col("_g"))).repartition("_block").sortWithinPartitions("_block", "_row")

    def assigned(batches):
        for t in _each_run(batches, ("_block", group)):
            batch = _Fold(t.column("_s").to_numpy(), most).batches(t.column("_used")[0].as_py(), t.column("_batch")[0].as_py())
            yield from pa.table({group: t.column(group), order: t.column(order), "batch": pa.array(batch, pa.int32())}).to_batches()

    return joined.select(group, order, "_s", "_row", "_block", "_used", "_batch").mapInArrow(assigned, f"`{group}` {kind}, `{order}` long, batch int")


def pack_batches(rows: DataFrame, group: str, order: str, size: Column, most: int, most_rows: int = 100_000) -> DataFrame:
    """WIN07: group, order, batch: items in order fill a batch until the next would overflow it; an item that is too large alone has its own batch.

    A group of up to most_rows items is folded in one row. With a larger one, groups are cut into blocks; a block's summary says,
    for each place where the batch open at its beginning can end, how the block ends; summaries are chained, and the blocks
    then filled side by side. The batches are the same either way. Sizes are 0 or more; a null size is 0.
    """
    if _any_large(rows, group, most_rows):
        return _packed_by_blocks(rows, group, order, size, most)
    start = F.expr(f"named_struct('batch', 0, 'used', 0L, 'out', cast(array() AS array<struct<{order}:bigint,batch:int>>))")

    def step(a, x):
        over = (a["used"] > 0) & (a["used"] + x["s"] > most)
        batch = a["batch"] + F.when(over, 1).otherwise(0)
        return F.struct(batch.alias("batch"), F.when(over, x["s"]).otherwise(a["used"] + x["s"]).alias("used"), F.concat(a["out"], F.array(F.struct(x["o"].cast("long").alias(order), batch.alias("batch")))).alias("out"))

    return _folded(rows, group, order, size, start, step).select(group, F.explode("_f.out").alias("x")).select(group, f"x.{order}", "x.batch")


def _filled_by_halves(rows: DataFrame, group: str, order: str, size: Column, most: int) -> DataFrame:
    """Each round goes on to the item that leaves at most half of the room; so the rounds are the logarithm of `most`.

    Items of at most half the room fit until they have filled half of it, as prefix sums tell; among the larger ones the first that
    fits beside the small ones before it ends the round, too, and those before it don't fit.
    """
    placed = _in_order(rows, group, order, size)
    now = placed.withColumn("_room", F.lit(most).cast("long")).filter("_s <= _room")
    taken = []
    while True:
        now = storage.written(now)
        if now.isEmpty():
            break
        small = F.col("_s") * 2 <= F.col("_room")
        inside = Window.partitionBy(group, "_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
        across = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        part = F.when(small, F.col("_s")).otherwise(0)
        blocks = now.groupBy(group, "_block").agg(F.sum(part).alias("_t")).select(F.col(group).alias("_g"), F.col("_block").alias("_b"), F.coalesce(F.sum("_t").over(across), F.lit(0)).alias("_before"))
        summed = now.withColumn("_c", F.sum(part).over(inside)).join(blocks, (F.col("_block") == F.col("_b")) & F.col(group).eqNullSafe(F.col("_g"))).withColumn("_c", F.col("_c") + F.col("_before")).drop("_g", "_b", "_before").withColumn("_small", small)
        summed = storage.written(summed)
        ends = F.when(F.col("_small"), F.col("_c") * 2 > F.col("_room")).otherwise(F.col("_s") <= F.col("_room") - F.col("_c"))
        left = F.col("_room") - F.col("_c") - F.when(F.col("_small"), 0).otherwise(F.col("_s"))
        end = summed.filter(ends).groupBy(group).agg(F.min(F.struct(F.col("_row").alias("at"), left.alias("left"))).alias("e")).select(F.col(group).alias("_g"), "e.at", "e.left")
        joined = summed.join(end, F.col(group).eqNullSafe(F.col("_g")), "left")
        taken.append(storage.written(joined.filter((F.col("_small") & (F.col("at").isNull() | (F.col("_row") <= F.col("at")))) | (F.col("_row") == F.col("at"))).select(group, order)))
        now = joined.filter((F.col("_row") > F.col("at")) & (F.col("_s") <= F.col("left"))).select(group, order, "_s", "_row", "_block", F.col("left").alias("_room"))
    return reduce(DataFrame.unionByName, taken) if taken else placed.select(group, order)


def fill_budget(rows: DataFrame, group: str, order: str, size: Column, most: int, most_rows: int = 100_000) -> DataFrame:
    """WIN08: group, order of the items taken: one that doesn't fit is skipped, later ones may still fit.

    A group of up to most_rows items is folded in one row; with a larger one, groups are filled in rounds over prefix sums.
    The items are the same either way. Sizes are 0 or more; a null size is 0.
    """
    if _any_large(rows, group, most_rows):
        return _filled_by_halves(rows, group, order, size, most)
    start = F.expr("named_struct('used', 0L, 'out', cast(array() AS array<bigint>))")

    def step(a, x):
        fits = a["used"] + x["s"] <= most
        return F.struct((a["used"] + F.when(fits, x["s"]).otherwise(0)).alias("used"), F.when(fits, F.concat(a["out"], F.array(x["o"].cast("long")))).otherwise(a["out"]).alias("out"))

    return _folded(rows, group, order, size, start, step).select(group, F.explode("_f.out").alias(order))


def central_difference(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """WIN09: -(y[i+1] - y[i-1]) / (x[i+1] - x[i-1]); ends and equal x have none."""
    w = Window.partitionBy(group).orderBy(x)
    dx = F.lead(x).over(w) - F.lag(x).over(w)
    return rows.withColumn("slope", F.try_divide(-(F.lead(y).over(w) - F.lag(y).over(w)), dx))


def neighbours(rows: DataFrame, group: str, order: str, text: str, limit: int = 200) -> DataFrame:
    """WIN10: the texts before and after, at most `limit` characters of each."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("before", F.substring(F.lag(text).over(w), 1, limit)).withColumn("after", F.substring(F.lead(text).over(w), 1, limit))


def carried(rows: DataFrame, group: str, order: str, value: Column, name: str) -> DataFrame:
    """WIN11: the last non-null value so far."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def around(lines: DataFrame, hits: DataFrame, group: str, line: str, n: int) -> DataFrame:
    """WIN12, TGF22: lines at most n away from a hit, once each. Hits are widened to line numbers, so the join is on equality."""
    wide = hits.select(group, F.explode(F.sequence(F.col(line) - n, F.col(line) + n)).alias(line)).distinct()
    return lines.join(wide, [group, line], "left_semi")


def within(lines: DataFrame, spans: DataFrame, group: str, line: str, bucket: int = 256) -> DataFrame:
    """JON23: lines inside spans (first, last) of their group. Both sides meet in buckets of line numbers."""
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("first") / bucket), F.floor(F.col("last") / bucket))))
    return lines.withColumn("_b", F.floor(F.col(line) / bucket)).join(s, [group, "_b"]).filter(F.col(line).between(F.col("first"), F.col("last"))).drop("_b")
