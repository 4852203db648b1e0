"""TGF and CMP on documents, pages, labels and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import jobs as J
from tessera.operators import documents as D
from tessera.operators import sequences
from tessera.registry import query


@query("tgf01_search_units")
def tgf01(t):
    md = F.concat(F.lit("# Paper "), "doc_id", F.lit("\n## Methods\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return D.search_units(t.documents.select("doc_id", md.alias("text")), "doc_id").groupBy("doc_id", "unit_type").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@query(
    "tgf02_paragraphs",
    "WITH p AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS c FROM documents) SELECT doc_id, count(*) AS n, sum(length(c))::BIGINT AS chars FROM p WHERE length(c) >= 20 GROUP BY 1",
)
def tgf02(t):
    return D.paragraphs(t.documents, "doc_id", mark="\n").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@query(
    "tgf05_heading_chunks",
    """WITH m AS (SELECT doc_id, replace(text, chr(10), chr(10) || '## ') AS m FROM documents), c AS (SELECT doc_id, unnest(string_split(replace(m, chr(10) || '## ', chr(1) || '## '), chr(1))) AS c FROM m)
    SELECT doc_id, count(*) AS n FROM c WHERE length(trim(c)) > 50 GROUP BY 1""",
)
def tgf05(t):
    md = t.documents.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n## ")).alias("text"))
    return D.heading_chunks(md, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


@query(
    "tgf06_character_chunks",
    """SELECT doc_id, i AS ordinal, md5(substr(text, i * 800 + 1, 1000)) AS h FROM (SELECT doc_id, text, unnest(range(0, 1 + greatest(length(text) - 201, 0) // 800)) AS i FROM documents WHERE length(text) > 0)""",
)
def tgf06(t):
    return D.character_chunks(t.documents, "doc_id").select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.md5("content").alias("h"))


@query(
    "tgf07_equations",
    """SELECT doc_id, e AS latex FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\$\\$((?s:.+?))\\$\\$', 1) || regexp_extract_all(regexp_replace(text, '\\$\\$(?s:.+?)\\$\\$', ' ', 'g'), '\\$([^$\\n]+?)\\$', 1)) AS e FROM documents)""",
)
def tgf07(t):
    return D.equations(t.documents, "doc_id").select("doc_id", "latex")


@query("str10_definitions", "SELECT doc_id, len(regexp_extract_all(text || ' x is the size of y.', '\\b([A-Za-z][A-Za-z0-9_]{0,19})\\s+(?:is the|denotes)\\s+([^.,;\\n]{3,200})')) AS n FROM documents WHERE lang = 'de'")
def str10(t):
    return t.documents.filter("lang = 'de'").select("doc_id", F.size(D.definitions(F.concat("text", F.lit(" x is the size of y.")))).cast("long").alias("n"))


@query("src19_html_text", "SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g'))::BIGINT AS bare_chars FROM pages")
def src19(t):
    return t.pages.select("page_id", F.length(F.regexp_replace("html", "<[^>]+>", "")).cast("long").alias("bare_chars"))


@query("src19_page_text")
def src19_text(t):
    return t.pages.select("page_id", D.html_text(F.col("html")).alias("text"))


@query("tgf15_import_edges", "SELECT source AS file, unnest(string_split(string_agg(DISTINCT lang, ',' ORDER BY lang), ',')) AS module FROM documents GROUP BY 1")
def tgf15(t):
    return J.imported_modules(t.documents, "source", "lang")


@query("tgf16_skeleton", "SELECT l_orderkey, string_agg(l_linenumber || ': ' || l_returnflag, chr(10) ORDER BY l_linenumber, l_returnflag) AS skeleton FROM lineitem GROUP BY 1")
def tgf16(t):
    return J.listed(t.lineitem, "l_orderkey", ["l_linenumber", "l_returnflag"], F.concat(F.col("l_linenumber").cast("string"), F.lit(": "), "l_returnflag"), "skeleton")


@query("tgf19_tag_rows", "SELECT c_custkey AS paper_id, c_mktsegment AS raw_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'construction' ELSE lower(c_mktsegment) END AS tag, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 0.8 ELSE 0.7 END AS DOUBLE) AS confidence FROM customer")
def tgf19(t):
    tagged = t.customer.select(F.col("c_custkey").alias("paper_id"), F.lit("topic").alias("category"), F.col("c_mktsegment").alias("raw_name"))
    aliases = t.spark.sql("SELECT 'building' AS normalized_alias, 'topic' AS category, 'construction' AS tag")
    return D.tag_rows(tagged, aliases).select("paper_id", "raw_name", "tag", "confidence")


@query(
    "cmp03_first_method",
    "SELECT l_orderkey, arg_min(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS l_partkey, count(*) AS methods FROM lineitem GROUP BY 1",
)
def cmp03(t):
    return J.first_method(t.lineitem, "l_orderkey", "l_partkey", F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey"))


@query("cmp04_axis_matrix", "SELECT source, coalesce(max(doc_id) FILTER (lang = 'en')::VARCHAR, 'N/A') AS en, coalesce(max(doc_id) FILTER (lang = 'de')::VARCHAR, 'N/A') AS de FROM documents GROUP BY 1")
def cmp04(t):
    return J.axis_matrix(t.documents, "source", "lang", "doc_id", ["en", "de"])


@query("cmp06_describe", "SELECT d.doc_id, d.lang, coalesce(string_agg(l.quality || '/' || l.toxic, ';' ORDER BY l.quality, l.toxic), '') AS tags FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL")
def cmp06(t):
    tag = F.concat(F.col("quality").cast("string"), F.lit("/"), F.col("toxic").cast("string"))
    return J.described(t.documents.select("doc_id", "lang"), t.labels, "doc_id", ["quality", "toxic"], tag)


@query(
    "cmp08_skip_equivalent",
    "SELECT event_id FROM events e WHERE event_type <> 'purchase' AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_type = 'purchase' AND o.user_id = e.user_id AND o.props = e.props)",
)
def cmp08(t):
    return J.without_equivalent(t.events.filter("event_type <> 'purchase'"), t.events.filter("event_type = 'purchase'"), ["user_id", "props"]).select("event_id")


@query(
    "cmp10_concept_map",
    "SELECT source, string_agg(lang || ' (' || n || ')', ', ' ORDER BY n DESC, lang) AS line FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY 1",
)
def cmp10(t):
    return J.concept_map(t.documents, "source", "lang")


@query("cmp01_context_pack")
def cmp01(t):
    """The 500 best units, packed greedily into a budget per language."""
    from tessera.operators import search as S
    from tessera.plans.search_queries import units

    found = S.bm25(units(t), [["the"]]).orderBy("rank", "unit_id").limit(500).join(units(t).select("unit_id", "content"), "unit_id")
    placed = found.join(t.documents.select(F.col("doc_id").alias("paper_id"), "lang"), "paper_id")
    scored = placed.withColumn("order", F.row_number().over(Window.partitionBy("lang").orderBy("rank", "unit_id")).cast("long"))
    taken = sequences.fill_budget(scored, "lang", "order", F.ceil(F.length("content") / 4), 1000)
    return scored.join(taken, ["lang", "order"]).select("lang", "order", "unit_id", "content")
