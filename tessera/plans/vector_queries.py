"""Vector retrieval on embeddings and all-pairs sums on suppliers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import vectors as V
from tessera.registry import query

COSINE = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
KNN_SQL = f"SELECT query_id, vec_id, score FROM (SELECT a.vec_id AS query_id, b.vec_id, {COSINE} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) WHERE r <= 8"


def knn(t):
    return V.nearest(t.embeddings, t.embeddings.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 8)


@query("srt06_knn", f"SELECT query_id, vec_id, round(score, 5) AS score FROM ({KNN_SQL})")
def srt06(t):
    return knn(t).withColumn("score", F.round("score", 5))


@query("agg13_max_score_dedup", f"SELECT label, round(max(score), 5) AS score FROM ({KNN_SQL}) JOIN embeddings USING (vec_id) WHERE vec_id <> query_id GROUP BY 1")
def agg13(t):
    hits = knn(t).filter("vec_id <> query_id").join(t.embeddings.select("vec_id", "label"), "vec_id")
    return V.best_per_content(hits, "label").withColumn("score", F.round("score", 5))


@query("fil17_threshold", f"SELECT query_id, count(*) AS n FROM ({KNN_SQL}) WHERE score >= 0.3 GROUP BY 1")
def fil17(t):
    return knn(t).filter("score >= 0.3").groupBy("query_id").agg(F.count("*").alias("n"))


@query("rag01_retrieve", f"SELECT query_id, string_agg(vec_id || ':' || label, ' ' ORDER BY score DESC, vec_id) AS context FROM ({KNN_SQL}) JOIN embeddings USING (vec_id) WHERE score >= 0.1 GROUP BY 1")
def rag01(t):
    hits = knn(t).filter("score >= 0.1").join(t.embeddings.select("vec_id", "label"), "vec_id")
    grouped = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "vec_id", "label"))).alias("s"))
    return grouped.select("query_id", F.array_join(F.transform("s", lambda x: F.concat(x["vec_id"].cast("string"), F.lit(":"), x["label"].cast("string"))), " ").alias("context"))


POINTS_SQL = "(SELECT s_suppkey AS id, (s_suppkey % 10)::DOUBLE AS x, (s_suppkey // 10 % 10)::DOUBLE AS y, (s_suppkey // 100)::DOUBLE AS z, s_acctbal / 1000 AS q FROM supplier)"


def points(t):
    return t.supplier.selectExpr("s_suppkey AS id", "cast(s_suppkey % 10 AS double) AS x", "cast(s_suppkey div 10 % 10 AS double) AS y", "cast(s_suppkey div 100 AS double) AS z", "s_acctbal / 1000 AS q")


def _field(dx, dy, dz, s):
    r2 = dx * dx + dy * dy + dz * dz
    w = s["q"] / (r2 * np.sqrt(r2))
    return {"fx": w * dx, "fy": w * dy, "fz": w * dz}


@query("jon21_pairs", f"WITH p AS {POINTS_SQL} SELECT a.id, " + ", ".join(f"round(sum(b.q * (b.{c} - a.{c}) / pow((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2, 1.5)), 6) AS f{c}" for c in "xyz") + " FROM p a JOIN p b ON a.id <> b.id GROUP BY 1")
def jon21(t):
    out = V.block_sums(points(t), points(t), _field, ["fx", "fy", "fz"])
    return out.select("id", *(F.round(f"f{c}", 6).alias(f"f{c}") for c in "xyz"))


@query("jon22_biot_savart", "SELECT s_suppkey AS id, 0.0 AS sideways, round(64 / pow(1 + pow(s_suppkey / 10.0, 2), 1.5), 6) AS bz FROM supplier")
def jon22(t):
    loop = V.ring(t.spark, 64)
    kernel = lambda dx, dy, dz: V.biot_savart(dx, dy, dz, F.col("jx"), F.col("jy"), F.col("jz"))
    targets = t.supplier.selectExpr("s_suppkey AS id", "0D AS x", "0D AS y", "s_suppkey / 10D AS z")
    field = V.pairwise_sums(targets, loop, kernel, skip_self=False)
    return field.select("id", F.round(F.abs("bx") + F.abs("by"), 6).alias("sideways"), F.round("bz", 6).alias("bz"))


@query("agg16_energy", f"WITH p AS {POINTS_SQL} SELECT round(sum(u * u - 2 * u), 6) AS energy, count(*) AS pairs FROM (SELECT pow(1.5 / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2), 6) AS u FROM p a JOIN p b ON a.id < b.id)")
def agg16(t):
    def terms(dx, dy, dz, _):
        u = 2.25 / (dx * dx + dy * dy + dz * dz)
        u = u * u * u
        return {"energy": u * (u - 2), "pairs": 1.0}

    each = V.block_sums(points(t).drop("q"), points(t).drop("q"), terms, ["energy", "pairs"])  # each pair twice
    return each.agg(F.round(F.sum("energy") / 2, 6).alias("energy"), (F.coalesce(F.sum("pairs"), F.lit(0.0)) / 2).cast("long").alias("pairs"))


@query("mth04_potentials", "SELECT s_suppkey, round(1.0 * q / r, 6) AS ec, round(pow(2 / r, 12) - 2 * pow(2 / r, 6), 6) AS elj, round(exp(-2 * (r - 2)) - 2 * exp(-(r - 2)), 6) AS em FROM (SELECT s_suppkey, 1 + s_suppkey / 20 AS r, s_acctbal / 1000 AS q FROM supplier)")
def mth04(t):
    s = t.supplier.selectExpr("s_suppkey", "1 + s_suppkey / 20 AS r", "s_acctbal / 1000 AS q")
    r, one, two = F.col("r"), F.lit(1.0), F.lit(2.0)
    return s.select("s_suppkey", F.round(V.coulomb(r, F.col("q"))[0], 6).alias("ec"), F.round(V.lennard_jones(r, two, one)[0], 6).alias("elj"), F.round(V.morse(r, two, one, one)[0], 6).alias("em"))


@query("mth01_derivative", "SELECT s_suppkey, abs((exp(x + 1e-4) - exp(x)) / 1e-4 - exp(x)) < 0.01 AS close FROM (SELECT s_suppkey, s_suppkey % 5 / 3.0 AS x FROM supplier)")
def mth01(t):
    return t.supplier.select("s_suppkey", (V.derivative_error(F.exp, F.exp, F.col("s_suppkey") % 5 / 3.0) < 0.01).alias("close"))


#: Points whose coordinates are multiples of 1/8, so that distances are exact in either engine.
SPREAD_SQL = "(SELECT c_custkey AS id, (c_custkey * 7919 % 800) / 8 AS x, (c_custkey * 104729 % 800) / 8 AS y, (c_custkey * 31 % 800) / 8 AS z FROM customer)"


def spread(t):
    at = lambda n: (F.col("c_custkey") * n % 800) / 8.0
    return t.customer.select(F.col("c_custkey").alias("id"), at(7919).alias("x"), at(104729).alias("y"), at(31).alias("z"))


@query("jon22_tiled_sums", f"WITH p AS {SPREAD_SQL}, q AS {POINTS_SQL} SELECT a.id, round(sum(b.q / (1 + (b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2)), 6) AS energy, count(*) AS pairs FROM p a JOIN q b ON a.id <> b.id GROUP BY 1")
def jon22_tiled(t):
    kernel = lambda dx, dy, dz: {"energy": F.col("q") / (1 + dx * dx + dy * dy + dz * dz), "pairs": F.lit(1)}
    out = V.pairwise_sums(spread(t), points(t), kernel, most_sources=0, tile=512)
    return out.select("id", F.round("energy", 6).alias("energy"), "pairs")


_WITHIN = "a.id <> b.id AND {x} ** 2 + {y} ** 2 + {z} ** 2 <= 64"
_OPEN = {c: f"(b.{c} - a.{c})" for c in "xyz"}
_WRAPPED = {c: f"(b.{c} - a.{c} - 100 * round((b.{c} - a.{c}) / 100))" for c in "xyz"}


def _near_sql(d):
    return f"WITH p AS {SPREAD_SQL} SELECT a.id, round(sum(1 / sqrt({d['x']} ** 2 + {d['y']} ** 2 + {d['z']} ** 2)), 6) AS energy, count(*) AS near FROM p a JOIN p b ON {_WITHIN.format(**d)} GROUP BY 1"


def _near(t, box):
    kernel = lambda dx, dy, dz: {"energy": V.over(F.lit(1.0), F.sqrt(dx * dx + dy * dy + dz * dz)), "near": F.lit(1)}
    return V.cutoff_sums(spread(t), spread(t), kernel, 8.0, box).select("id", F.round("energy", 6).alias("energy"), "near")


@query("jon22_cutoff", _near_sql(_OPEN))
def jon22_cutoff(t):
    return _near(t, None)


@query("jon22_periodic", _near_sql(_WRAPPED))
def jon22_periodic(t):
    return _near(t, (100.0, 100.0, 100.0))
