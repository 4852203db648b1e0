"""Matching, cascades and name resolution on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import jobs as J
from tessera.operators import identity as I
from tessera.registry import query


@query("jon11_fuzzy_title")
def jon11(t):
    title = F.substring_index("text", ".", 1)
    probes = t.benchmark.select(F.col("item_id").alias("probe_id"), title.alias("title"), F.lit(None).cast("string").alias("authors"), F.lit(2000).alias("year"))
    papers = t.documents.select(F.col("doc_id").alias("paper_id"), title.alias("title"), F.lit(None).cast("string").alias("authors"), F.lit(2000).alias("year"))
    return I.fuzzy_matches(probes, papers).withColumn("score", F.round("score", 6))


@query(
    "jon11_edit_distance",
    """SELECT a.p_partkey AS probe_id, b.p_partkey AS paper_id, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size
    WHERE levenshtein(a.p_name, b.p_name) <= 3""",
)
def jon11_edit(t):
    p = t.part.select("p_partkey", F.col("p_name").alias("title"), F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string")).alias("block"))
    return I.edit_matches(p.withColumnRenamed("p_partkey", "probe_id"), p.withColumnRenamed("p_partkey", "paper_id"), "block", 3)


@query(
    "jon14_identity_cascade",
    """WITH d AS (SELECT doc_id, sha256(text) AS h, source FROM documents), by_hash AS (SELECT d.doc_id, min(o.doc_id) AS m FROM d JOIN d o ON d.h = o.h AND o.doc_id < d.doc_id GROUP BY 1),
    by_label AS (SELECT doc_id, max(quality)::BIGINT AS m FROM labels GROUP BY 1)
    SELECT doc_id, coalesce(h.m, l.m) AS match, CASE WHEN h.m IS NOT NULL THEN 'hash' WHEN l.m IS NOT NULL THEN 'label' ELSE 'created' END AS outcome FROM d LEFT JOIN by_hash h USING (doc_id) LEFT JOIN by_label l USING (doc_id)""",
)
def jon14(t):
    h = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    first = h.groupBy("h").agg(F.min("doc_id").alias("match"))
    by_hash = h.join(first, "h").filter("match < doc_id").select("doc_id", "match")
    by_label = t.labels.groupBy("doc_id").agg(F.max("quality").cast("long").alias("match"))
    return I.cascade(t.documents, "doc_id", [("hash", by_hash), ("label", by_label)])


@query(
    "jon16_resolve_priority",
    """SELECT DISTINCT n_name AS call, CASE WHEN n_name || '::0' IN (SELECT r_name || '::' || r_regionkey FROM region) THEN n_name || '::0'
    WHEN 'AFRICA' || '::' || n_regionkey IN (SELECT r_name || '::' || r_regionkey FROM region) THEN 'AFRICA::' || n_regionkey ELSE n_name END AS target FROM nation""",
)
def jon16(t):
    calls = t.nation.select(F.col("n_name").alias("call"), "n_regionkey").distinct()
    functions = t.region.select(F.concat_ws("::", "r_name", F.col("r_regionkey").cast("string")).alias("name"))
    tried = calls.withColumn("call", F.col("call"))
    candidates = [F.concat("call", F.lit("::0")), F.concat(F.lit("AFRICA::"), F.col("n_regionkey").cast("string"))]
    keyed = tried.select("call", F.posexplode(F.array(*candidates)).alias("priority", "full"))
    found = keyed.join(functions.withColumnRenamed("name", "full"), "full").groupBy("call").agg(F.min_by("full", "priority").alias("target"))
    return calls.join(found, "call", "left").select("call", F.coalesce("target", "call").alias("target"))


@query("jon18_import_aliases", "SELECT DISTINCT l_orderkey AS file, 'p' || l_partkey % 5 AS local_name, p_brand AS target FROM lineitem JOIN part ON l_partkey = p_partkey")
def jon18(t):
    uses = t.lineitem.select(F.col("l_orderkey").alias("file"), "l_partkey", F.concat(F.lit("p"), F.col("l_partkey") % 5).alias("local_name"))
    return J.import_targets(uses, t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("target")), "l_partkey")


@query("src02_index_outcome", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'path' WHEN md5(html) IN (SELECT md5(html) FROM pages WHERE page_id % 5 = 0) THEN 'hash' ELSE 'created' END AS outcome FROM pages")
def src02(t):
    known = t.pages.filter("page_id % 5 = 0")
    by_path = known.select("page_id", F.col("page_id").alias("match"))
    h = known.groupBy(F.md5("html").alias("h")).agg(F.min("page_id").alias("match"))
    by_hash = t.pages.select("page_id", F.md5("html").alias("h")).join(h, "h").select("page_id", "match")
    return I.cascade(t.pages, "page_id", [("path", by_path), ("hash", by_hash)]).select("page_id", "outcome")
