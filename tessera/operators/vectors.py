"""Vector retrieval (SRT06, AGG13, FIL17, RAG01) and all-pairs kernels (JON21, JON22, AGG15, AGG16, MTH)."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera import storage


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_: str = "vec_id", vector: str = "embedding", most_numbers: int = 2_000_000) -> DataFrame:
    """SRT06: query_id, id, score of the k most similar vectors of each query, by cosine, ties by id.

    Vectors and queries are cut into tiles of at most most_numbers components (16 MB as doubles); two tiles meet in one task,
    which keeps its k best per query before rows are shuffled. A product of matrices finds the candidates, all that are within
    1e-9 of the k-th; their scores are summed anew component by component, so that equal vectors tie exactly. Vectors of
    unequal lengths, with a null or without length have no score and come last.
    """
    width = vectors.agg(F.max(F.size(vector))).first()[0] or 1
    rows = max(1, most_numbers // max(1, width))
    base, asked = vectors.select(F.col(id_).alias("id"), F.col(vector).alias("v")), queries.select(F.col("query_id").alias("id"), F.col(vector).alias("v"))
    (left, down), (right, across) = _tiled(asked, rows, 1), _tiled(base, rows, 16)
    types = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField(id_, vectors.schema[id_].dataType), StructField("score", DoubleType())])

    def near(batches):
        for batch in batches:
            for q, v in zip(batch.column("_left"), batch.column("_right"), strict=True):
                yield from _best_of(q.values, v.values, k, id_)

    first = _met(left, right, min(4096, down * across)).mapInArrow(near, types)
    best = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), id_)
    return first.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k).select("query_id", id_, "score")


def _matrices(tile: pa.StructArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By width: places in the tile, vectors as doubles and their lengths. Vectors with a null or of length 0 are left out."""
    lists = tile.field("v")
    sizes = np.where(lists.is_null().to_numpy(zero_copy_only=False), -1, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    out = {}
    for width in np.unique(sizes[sizes > 0]).tolist():
        places = np.flatnonzero(sizes == width)
        flat = lists.take(pa.array(places)).flatten()
        m = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
        whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, width).any(axis=1)
        lengths = np.sqrt(_in_order(m, m))
        whole &= lengths != 0
        out[width] = places[whole], np.ascontiguousarray(m[whole]), lengths[whole]
    return out


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed component by component, as dot does."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _best_of(queries: pa.StructArray, vectors: pa.StructArray, k: int, id_: str, cells: int = 4_000_000):
    """Batches query_id, id, score: the k best of the tile for each query."""
    ids, asked = vectors.field("id"), queries.field("id")
    order = np.empty(len(ids), np.int64)  # places by id
    order[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    stored, sought, step = _matrices(vectors), _matrices(queries), max(1, cells // max(1, len(ids)))
    of = {place: width for width, (places, _, _) in sought.items() for place in places.tolist()}
    first_ids = np.argsort(order)
    unscored = np.array([p for p in range(len(asked)) if p not in of or of[p] not in stored or len(stored[of[p]][0]) < k], np.int64)
    with np.errstate(all="ignore"):
        for width, (places, m, lengths) in sought.items():
            if width not in stored or not len(stored[width][0]) or not len(places):
                continue
            at, v, sizes = stored[width]
            for i in range(0, len(places), step):
                rough = (m[i : i + step] @ v.T) / (lengths[i : i + step, None] * sizes)
                rough[np.isnan(rough)] = np.inf  # NaN is above all numbers
                if len(at) > k:
                    bar = np.partition(rough, len(at) - k, axis=1)[:, len(at) - k]
                    row, col = np.nonzero(rough >= np.where(np.isfinite(bar), bar - 1e-9, bar)[:, None])
                else:
                    row, col = (x.ravel() for x in np.indices(rough.shape))
                score = np.empty(len(row))
                for j in range(0, len(row), 65_536):
                    r, c = row[j : j + 65_536], col[j : j + 65_536]
                    score[j : j + 65_536] = _in_order(m[i + r], v[c]) / (sizes[c] * lengths[i + r])
                by = np.lexsort((order[at[col]], -np.where(np.isnan(score), np.inf, score), row))
                row, col, score = row[by], col[by], score[by]
                kept = np.arange(len(row)) - np.searchsorted(row, row) < k
                yield _hits(asked, ids, places[i + row[kept]], at[col[kept]], pa.array(score[kept]), id_)
    # where fewer than k have a score, the first ids of the others follow
    for p in unscored.tolist():
        have = set(stored[of[p]][0].tolist()) if p in of and of[p] in stored else set()
        rest = [x for x in first_ids[: k + len(have)].tolist() if x not in have][:k]
        yield _hits(asked, ids, np.full(len(rest), p), np.array(rest, np.int64), pa.nulls(len(rest), pa.float64()), id_)


def _hits(asked, ids, queries, vectors, score, id_):
    return pa.RecordBatch.from_arrays([asked.take(pa.array(queries, pa.int64())), ids.take(pa.array(vectors, pa.int64())), score], names=["query_id", id_, "score"])


def best_per_content(hits: DataFrame, content: str = "content", score: str = "score") -> DataFrame:
    """AGG13: of equal contents the hit with the highest score."""
    return hits.groupBy(content).agg(F.max(score).alias(score))


Kernel = Callable[[Column, Column, Column], dict[str, Column]]


def over(a: Column | float, b: Column) -> Column:
    """a / b by the rules of floating point: infinite or NaN where b is 0, no error."""
    return F.when(b == 0, a * F.lit(math.inf)).otherwise(a / b)


def _of_source(sources: DataFrame) -> DataFrame:
    return sources.select(*(F.col(c).alias(f"s_{c}" if c in ("id", "x", "y", "z") else c) for c in sources.columns))


#: Parts of a sum: rows that aren't null, infinite and NaN ones, and the sum of the others.
_PARTS = ("n", "up", "down", "nan", "sum")


def _classes(rows: DataFrame, skip_self: bool) -> DataFrame:
    """One row for all rows that differ only in their id: their number _m and, to tell a row from its copies, the ends of their ids."""
    rows = rows.filter("id IS NOT NULL") if skip_self else rows
    return rows.groupBy(*(c for c in rows.columns if c != "id")).agg(F.count("*").alias("_m"), F.min("id").alias("_lo"), F.max("id").alias("_hi"))


def _alone() -> Column:
    """The two classes are of one and the same id: no pair of theirs counts."""
    return (F.col("_lo") == F.col("_hi")) & (F.col("s__lo") == F.col("s__hi")) & (F.col("_lo") == F.col("s__lo"))


def _parts(pairs: DataFrame, keys: list, terms: dict[str, Column], weight: Column) -> DataFrame:
    """Per keys the parts of each term's sum, and _pairs; a pair counts `weight` times."""
    rows = pairs.select(*keys, weight.alias("_w"), *(v.alias(f"_v_{k}") for k, v in terms.items()))
    aggs, types = [F.sum("_w").alias("_pairs")], dict(rows.dtypes)
    for k in terms:
        v, w = F.col(f"_v_{k}"), F.col("_w")
        many = lambda which, w=w: F.coalesce(F.sum(F.when(which, w)), F.lit(0))
        real = types[f"_v_{k}"] in ("double", "float")
        up, down, nan = (v == math.inf, v == -math.inf, F.isnan(v)) if real else [F.lit(False)] * 3
        total = F.sum(F.when(~up & ~down & ~nan, v * w))
        aggs += [x.alias(f"_{p}_{k}") for p, x in zip(_PARTS, (many(v.isNotNull()), many(up), many(down), many(nan), F.coalesce(total, F.lit(0))), strict=True)]
    return rows.groupBy(*(k for k in rows.columns if k != "_w" and not k.startswith("_v_"))).agg(*aggs)


def _joined(parts: DataFrame, targets: DataFrame, own: DataFrame | None, names: list[str], hint: str | None) -> DataFrame:
    """id and the sums: each target takes the parts of its class (x, y, z) without those of the pairs with its own id."""
    hinted = lambda df: df.hint(hint) if hint else df
    columns = ["_pairs", *(f"_{p}_{k}" for k in names for p in _PARTS)]
    t = targets.groupBy("id", "x", "y", "z").agg(F.count("*").alias("_m"))
    p = parts.select(*(F.col(c).alias(f"_c_{c}") for c in "xyz"), *columns)
    all_ = hinted(t).join(p, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in "xyz")))
    summed = all_.groupBy("id").agg(*(F.sum(F.col(c) * F.col("_m")).alias(c) for c in columns))
    if own is not None:
        less = own.select("id", *(F.col(c).alias(f"_o{c}") for c in columns))
        summed = hinted(summed).join(less, "id", "left").select("id", *((F.col(c) - F.coalesce(f"_o{c}", F.lit(0))).alias(c) for c in columns))

    def value(k):
        n, up, down, nan, total = (F.col(f"_{p}_{k}") for p in _PARTS)
        if dict(summed.dtypes)[f"_sum_{k}"] == "double":
            bad = (nan > 0) | (up > 0) & (down > 0)
            total = F.when(bad, math.nan).when(up > 0, math.inf).when(down > 0, -math.inf).otherwise(total)
        return F.when(n > 0, total).alias(k)

    return summed.filter("_pairs > 0").select("id", *map(value, names))


def pairwise_sums(targets: DataFrame, sources: DataFrame, kernel: Kernel, skip_self: bool = True, most_sources: int = 100_000, tile: int = 8192, axes: str = "xyz") -> DataFrame:
    """JON21, JON22, AGG15, AGG16, UDF04: id and, for each named term of the kernel, its sum over all sources.

    Both have id, x, y, z. The kernel gets the differences (source - target) as columns and may use the sources' own columns by
    their names. Targets at one place are a class, and so are sources alike in all columns but their id: the kernel is asked
    once for two classes, and the pairs of a row with itself are taken out again, counted apart where a term isn't finite.
    axes: those that the kernel reads, where it doesn't read all; classes are coarser then.

    Up to most_sources classes the sources are sent to all tasks. Beyond, both sides are cut into tiles of about
    `tile` rows and a pair of tiles is a group of a join: it meets in one task, whose sums per target are combined before
    they are shuffled. So nothing grows with the input but the number of tasks; the sums are the same either way.
    """
    flat = lambda rows: rows.select(*(F.lit(0.0).alias(c) if c in "xyz" and c not in axes else F.col(c) for c in rows.columns))
    targets, sources = flat(targets.select("id", "x", "y", "z")), flat(sources)
    t, s = _classes(targets, skip_self), storage.written(_classes(sources, skip_self))
    s = s.select(*(F.col(c).alias(f"s_{c}" if c in ("x", "y", "z", "_m", "_lo", "_hi") else c) for c in s.columns))
    n, hint = s.count(), None
    if n <= most_sources:
        pairs = t.crossJoin(F.broadcast(s))
    else:
        hint = "merge"
        t = storage.written(t)
        across, down = -(-n // tile), max(1, -(-t.count() // tile))
        # numbered once and written, so that a row's tile doesn't change when a task is repeated
        cut = lambda rows, name, tiles: storage.written(rows.withColumn(name, F.monotonically_increasing_id() % tiles))
        each = lambda rows, name, tiles: rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)).cast("array<bigint>")))
        left = each(cut(t, "_down", down), "_across", across)
        right = each(cut(s, "_across", across), "_down", down)
        pairs = left.join(right.hint("shuffle_hash"), ["_down", "_across"])
    terms = lambda: kernel(F.col("s_x") - F.col("x"), F.col("s_y") - F.col("y"), F.col("s_z") - F.col("z"))
    names, own = list(terms()), None
    if skip_self:
        pairs = pairs.filter(~_alone())
        own = _parts(_own(targets, sources, hint), ["id"], terms(), F.lit(1).cast("long"))
    return _joined(_parts(pairs, ["x", "y", "z"], terms(), F.col("s__m")), targets, own, names, hint)


def _own(targets: DataFrame, sources: DataFrame, hint: str | None = None) -> DataFrame:
    """The pairs of rows with one id, but for those of classes that hold nothing else."""
    t = targets.filter("id IS NOT NULL").select("id", "x", "y", "z")
    s = _of_source(sources.filter("id IS NOT NULL"))
    like = [c for c in s.columns if c != "s_id"]
    hinted = lambda df: df.hint(hint) if hint else df
    same = lambda keys: reduce(lambda p, q: p & q, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys))
    of = lambda df, id_, keys: df.groupBy(*(F.col(c).alias(f"_k_{c}") for c in keys)).agg(F.min(id_).alias("_lo"), F.max(id_).alias("_hi"))
    t = hinted(t).join(of(t, "id", ["x", "y", "z"]), same(["x", "y", "z"])).select("id", "x", "y", "z", "_lo", "_hi")
    s = hinted(s).join(of(s, "s_id", like), same(like)).select(*s.columns, F.col("_lo").alias("s__lo"), F.col("_hi").alias("s__hi"))
    return hinted(t).join(s, F.col("id") == F.col("s_id")).filter(~_alone())


def _tiled(rows: DataFrame, tile: int, least: int) -> tuple[DataFrame, int]:
    """_tile, _rows (an array of structs): the rows in tiles of about `tile` rows, at least `least` tiles if there are as many rows."""
    n = rows.count()
    tiles = max(1, -(-n // tile), min(least, n))
    dealt = rows.withColumn("_tile", F.pmod(F.xxhash64(*rows.columns), F.lit(tiles)))  # by values, so that a repeated task deals alike
    return dealt.groupBy("_tile").agg(F.collect_list(F.struct(*rows.columns)).alias("_rows")), tiles


def _met(left: DataFrame, right: DataFrame, groups: int) -> DataFrame:
    """_left, _right: each pair of tiles, a partition for each."""
    pairs = left.select(F.col("_rows").alias("_left")).crossJoin(right.select(F.col("_rows").alias("_right")))
    return pairs.withColumn("_g", F.monotonically_increasing_id()).repartition(groups, "_g").drop("_g")


def _arrays(cell: pa.Scalar, columns: list[str]) -> dict[str, np.ndarray]:
    """The columns of a tile; nulls of doubles become NaN."""
    return {c: cell.values.field(c).to_numpy(zero_copy_only=False) for c in columns}


#: A kernel on arrays: the differences (source - target), targets down and sources across, and the sources' columns.
BlockKernel = Callable[[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]], dict[str, np.ndarray]]


def block_sums(targets: DataFrame, sources: DataFrame, kernel: BlockKernel, terms: list[str], skip_self: bool = True, tile: int = 16_384, block: int = 65_536) -> DataFrame:
    """JON21, AGG15, AGG16: as pairwise_sums, for doubles and a kernel on numpy arrays: id and the sum of each term as a double.

    All pairs are computed, so the work grows with the square of the points. Both sides are cut into tiles; two tiles meet in one
    task, in blocks of `block` pairs that stay in a core's cache, and partial sums per target are shuffled. Memory is bounded by
    two tiles a task. 1 / 0 is infinite and 0 / 0 NaN. A source with a null adds to no term; a sum without any is null.
    """
    names, mine = [*sources.columns, "_null"], ["id", "x", "y", "z", "_null"]
    schema = "id long, _met long, _real long, " + ", ".join(f"`{k}` double" for k in terms)

    def summed(batches):
        for batch in batches:
            for left, right in zip(batch.column("_left"), batch.column("_right"), strict=True):
                t, s = _arrays(left, mine), _arrays(right, names)
                shared = bool(np.intersect1d(t["id"], s["id"]).size) if skip_self else False
                wide = min(len(s["id"]), 2048)
                down = max(1, block // wide)
                out, met, real = np.zeros((len(terms), len(t["id"]))), *np.zeros((2, len(t["id"])), np.int64)
                gaps = bool(s["_null"].any() or t["_null"].any())
                with np.errstate(all="ignore"):
                    for i in range(0, len(t["id"]), down):
                        at = {c: v[i : i + down, None] for c, v in t.items()}
                        for j in range(0, len(s["id"]), wide):
                            part = {c: v[None, j : j + wide] for c, v in s.items()}
                            values = kernel(part["x"] - at["x"], part["y"] - at["y"], part["z"] - at["z"], part)
                            own = at["id"] == part["id"] if shared else None
                            own = own if own is not None and own.any() else None
                            out_ = own if not gaps else part["_null"] | at["_null"] | (False if own is None else own)
                            shape = at["id"].shape[0], part["id"].shape[1]
                            met[i : i + down] += shape[1] - (0 if own is None else own.sum(axis=1))
                            real[i : i + down] += shape[1] - (0 if out_ is None else out_.sum(axis=1))
                            for k, name in enumerate(terms):
                                v = np.broadcast_to(values[name], shape)
                                out[k, i : i + down] += (v if out_ is None else np.where(out_, 0.0, v)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(t["id"]), pa.array(met), pa.array(real), *map(pa.array, out)], names=["id", "_met", "_real", *terms])

    def numbers(rows):
        rows = rows.filter("id IS NOT NULL").select("id", *(F.col(c).cast("double") for c in rows.columns if c != "id"))
        return rows.withColumn("_null", reduce(lambda a, b: a | b, (F.col(c).isNull() for c in rows.columns[1:])))

    sources = numbers(sources)
    (left, down), (right, across) = _tiled(numbers(targets.select("id", "x", "y", "z")), tile, 8), _tiled(sources, tile, 8)
    groups = min(4096, down * across)
    parts = _met(left, right, groups).mapInArrow(summed, schema)
    whole = parts.groupBy("id").agg(*(F.sum(k).alias(k) for k in ("_met", "_real", *terms)))
    return whole.filter("_met > 0").select("id", *(F.when(F.col("_real") > 0, F.col(k)).alias(k) for k in terms))


def neighbours(targets: DataFrame, sources: DataFrame, cutoff: float, box: tuple[float, float, float] | None = None, skip_self: bool = True) -> DataFrame:
    """JON22, MTH06: the pairs within the cut-off: id, dx, dy, dz (source - target), and the sources' columns (s_id, s_x, ...).

    Space is a grid of cells at least as wide as the cut-off; a target meets the sources of its own and the 26 neighbouring
    cells by an equi-join, so on evenly spread points the rows grow with their number. box: lengths of a periodic cell, in
    which a neighbouring cell beyond the border is one at the other side, a period away; no source is copied. With a cut-off
    longer than a period the pairs with each image in reach count (also a point's own images), over as many cells as needed.
    Null coordinates have no neighbours.
    """
    s = _of_source(sources)
    near = _near(targets.select("id", "x", "y", "z"), s, cutoff, box)
    if skip_self:
        near = near.filter((F.col("id") != F.col("s_id")) | ~F.col("_home"))
    return near.select("id", "dx", "dy", "dz", *s.columns)


def _reach(cutoff: float) -> Column:
    return F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz") <= cutoff * cutoff


def _inside(box: tuple[float, float, float] | None, i: int) -> Callable[[Column], Column]:
    return (lambda c: c - F.floor(c / box[i]) * box[i]) if box else (lambda c: c)


def _near(t: DataFrame, s: DataFrame, cutoff: float, box: tuple[float, float, float] | None) -> DataFrame:
    """The pairs of t (x, y, z) and s (s_x, s_y, s_z) within the cut-off, with all columns; _home: no image is between them."""
    if not cutoff > 0 or box and not min(box) > 0:
        raise ValueError("the cut-off and the lengths of the box must be above 0")
    cells = [max(1, int(size // cutoff)) if box else 0 for size in box or (0, 0, 0)]
    width = [size / n if box else cutoff for size, n in zip(box or (0, 0, 0), cells, strict=True)]
    for axis, i in zip("xyz", range(3), strict=True):
        reach = math.ceil(cutoff / width[i])
        inside = _inside(box, i)
        # a coordinate just below the border may round up to it
        cell = lambda c, i=i: F.least(F.floor(c / width[i]), F.lit(cells[i] - 1)) if box else F.floor(c / width[i])
        s = s.withColumn(f"_at_{axis}", inside(F.col(f"s_{axis}"))).withColumn(f"_c_{axis}", cell(F.col(f"_at_{axis}")))
        here = cell(F.col(f"_own_{axis}"))
        t = t.withColumn(f"_own_{axis}", inside(F.col(axis))).withColumn("_n", F.explode(F.sequence(here - reach, here + reach)))
        shift = F.floor(F.col("_n") / cells[i]) if box else F.lit(0).cast("long")
        t = t.withColumn(f"_s_{axis}", shift).withColumn(f"_c_{axis}", F.col("_n") - F.col(f"_s_{axis}") * cells[i]).drop("_n")
    near = t.join(s, [f"_c_{axis}" for axis in "xyz"])
    for axis, i in zip("xyz", range(3), strict=True):
        near = near.withColumn(f"d{axis}", F.col(f"_at_{axis}") - F.col(f"_own_{axis}") + (F.col(f"_s_{axis}") * box[i] if box else 0.0))
    near = near.filter(_reach(cutoff))
    return near.withColumn("_home", (F.col("_s_x") == 0) & (F.col("_s_y") == 0) & (F.col("_s_z") == 0))


def cutoff_sums(targets: DataFrame, sources: DataFrame, kernel: Kernel, cutoff: float, box: tuple[float, float, float] | None = None, skip_self: bool = True) -> DataFrame:
    """JON22, AGG15: pairwise_sums over the sources within the cut-off, by classes as there; a target without any has no row."""
    targets = targets.select("id", "x", "y", "z")
    t, s = _classes(targets, skip_self), _classes(sources, skip_self)
    s = s.select(*(F.col(c).alias(f"s_{c}" if c in ("x", "y", "z", "_m", "_lo", "_hi") else c) for c in s.columns))
    near, own = _near(t, s, cutoff, box), None
    terms = lambda: kernel(F.col("dx"), F.col("dy"), F.col("dz"))
    if skip_self:
        near = near.filter(~(_alone() & F.col("_home")))
        pairs = _own(targets, sources)
        for i, axis in enumerate("xyz"):
            inside = _inside(box, i)
            pairs = pairs.withColumn(f"d{axis}", inside(F.col(f"s_{axis}")) - inside(F.col(axis)))
        own = _parts(pairs.filter(_reach(cutoff)), ["id"], terms(), F.lit(1).cast("long"))
    return _joined(_parts(near, ["x", "y", "z"], terms(), F.col("s__m")), targets, own, list(terms()), None)


def coulomb(r: Column, q: Column) -> tuple[Column, Column]:
    """MTH04: energy and force of a charge product at a distance."""
    return over(q, r), over(q, r * r)


def lennard_jones(r: Column, r0: Column, e0: Column) -> tuple[Column, Column]:
    """MTH04: energy and force with the minimum -e0 at r0."""
    u = F.pow(over(r0, r), 6)
    return e0 * (u * u - 2 * u), over(12 * e0, r) * (u * u - u)


def morse(r: Column, r0: Column, e0: Column, b: Column) -> tuple[Column, Column]:
    """MTH04, MTH06: energy and force with the minimum -e0 at r0 and the stiffness b."""
    e = F.exp(-b * (r - r0))
    return e0 * (e * e - 2 * e), 2 * e0 * b * (e * e - e)


def exp_linear(x: Column, n: int) -> Column:
    """MTH05: (1 + x / n) ^ n, an exponential that ends at -n."""
    return F.pow(F.greatest(1 + x / n, F.lit(0.0)), n)


def biot_savart(dx: Column, dy: Column, dz: Column, jx: Column, jy: Column, jz: Column) -> dict[str, Column]:
    """MTH05: the field of a current element, by the difference from its target to it."""
    r3 = F.pow(dx * dx + dy * dy + dz * dz, 1.5)
    return {"bx": over(jz * dy - jy * dz, r3), "by": over(jx * dz - jz * dx, r3), "bz": over(jy * dx - jx * dy, r3)}


def mixed(a: Column, b: Column) -> dict[str, Column]:
    """MTH04: mixing rules: radii add up, energies and charges multiply."""
    return {"r0": a["r"] + b["r"], "e0": F.sqrt(a["e"] * b["e"]), "q": a["q"] * b["q"]}


def derivative_error(f: Callable[[Column], Column], df: Callable[[Column], Column], x: Column, step: float = 1e-4) -> Column:
    """MTH01: difference of a derivative to the forward difference of its function."""
    return F.abs((f(x + step) - f(x)) / step - df(x))


def ring(spark, n: int, radius: float = 1.0) -> DataFrame:
    """TGF26: n points on a circle, with the direction along it."""
    a = F.col("id") * (2 * 3.141592653589793 / n)
    return spark.range(n).select("id", (radius * F.cos(a)).alias("x"), (radius * F.sin(a)).alias("y"), F.lit(0.0).alias("z"), (-F.sin(a)).alias("jx"), F.cos(a).alias("jy"), F.lit(0.0).alias("jz"))


def periodic(rows: DataFrame, cell: tuple[float, float, float], images: int = 1) -> DataFrame:
    """JON22: the rows and their images in all neighbouring cells up to `images` away."""
    steps = F.sequence(F.lit(-images), F.lit(images))
    out = rows
    for axis, size in zip("xyz", cell, strict=True):
        out = out.withColumn(f"_{axis}", F.explode(steps)).withColumn(axis, F.col(axis) + F.col(f"_{axis}") * size)
    return out


def potential_differences(rows: DataFrame, r: str, r0: float, e0: float, b: float) -> DataFrame:
    """MTH10: the rows with lennard_jones, morse (energies with one minimum) and the distance between them."""
    lj, m = lennard_jones(F.col(r), F.lit(r0), F.lit(e0))[0], morse(F.col(r), F.lit(r0), F.lit(e0), F.lit(b))[0]
    return rows.withColumn("lennard_jones", lj).withColumn("morse", m).withColumn("difference", F.abs(F.col("lennard_jones") - F.col("morse")))
