"""Composite jobs on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import composite as C
from tessera.registry import query


def _legacy(t):
    return t.events.select(F.col("user_id").cast("string").alias("stem"), F.concat(F.lit("20"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("run_name"), F.when(F.col("event_type") != "view", F.concat(F.lit("/out/"), F.when(F.col("event_type") == "click", "vlm").otherwise("docling"), F.lit("/"), "event_id")).alias("md_path"), F.lit(None).cast("string").alias("doi"), F.concat(F.lit("t"), "event_id").alias("title"), F.when(F.col("event_id") % 2 == 0, "2001").otherwise("").alias("year"), F.col("props").alias("essence"))


@query(
    "cmp07_migrated_papers",
    """SELECT user_id::VARCHAR AS stem, coalesce(arg_max('/out/vlm/' || event_id, event_id) FILTER (event_type = 'click'), arg_max('/out/docling/' || event_id, event_id) FILTER (event_type NOT IN ('click', 'view'))) AS md_path,
    't' || max(event_id) AS title, max(CASE WHEN event_id % 2 = 0 THEN 2001 END) AS year, arg_max(props, event_id) AS essence, user_id::VARCHAR AS paper_key FROM events WHERE user_id % 10 <> 0 GROUP BY user_id""",
)
def cmp07(t):
    tags = t.spark.sql("SELECT '' AS run_name, 1 AS id, 'x' AS name, 'c' AS category LIMIT 0")
    links = t.spark.sql("SELECT '' AS run_name, '' AS article_id, 1 AS tag_id LIMIT 0")
    done = t.events.filter("user_id % 10 = 0").select(F.col("user_id").cast("string").alias("stem")).distinct()
    return C.migrate(_legacy(t), tags, links, [], done)["papers"].drop("doi")


@query("agg18_migrated_links", "SELECT DISTINCT user_id::VARCHAR AS stem, CASE WHEN event_type = 'click' THEN 'clicking' ELSE event_type END AS name, 'kind' AS category FROM events")
def agg18(t):
    tags = t.events.select(F.concat(F.lit("20"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("run_name"), F.col("event_id").alias("id"), F.initcap("event_type").alias("name"), F.lit("kind").alias("category"))
    links = tags.select("run_name", F.col("id").alias("tag_id")).join(t.events.select(F.col("event_id").alias("tag_id"), F.col("user_id").cast("string").alias("article_id")), "tag_id")
    return C.migrate(_legacy(t), tags, links, [("clicking", "^cli")])["links"]


@query("cmp02_paper_sections", """WITH RECURSIVE o AS (SELECT conv_id, turn, text, length(text) + 1 AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
    f AS (SELECT conv_id, turn, r, s <= 500 AS took, CASE WHEN s <= 500 THEN s ELSE 0 END AS used FROM o WHERE r = 1 UNION ALL
      SELECT o.conv_id, o.turn, o.r, f.used + o.s <= 500, CASE WHEN f.used + o.s <= 500 THEN f.used + o.s ELSE f.used END FROM f JOIN o ON o.conv_id = f.conv_id AND o.r = f.r + 1)
    SELECT conv_id AS paper_id, string_agg(text, chr(10) ORDER BY turn) AS section FROM f JOIN conversations USING (conv_id, turn) WHERE took GROUP BY 1""")
def cmp02(t):
    return C.paper_sections(t.conversations.select(F.col("conv_id").alias("paper_id"), "turn", "text"), 500)


@query("cmp11_repository_map", "SELECT p_brand AS folder, count(*) AS files, (3 * count(*))::BIGINT AS lines, (2 * count(*))::BIGINT AS symbols, 'python' AS languages FROM part GROUP BY 1")
def cmp11(t):
    src = F.concat(F.lit("class A:\n  def f(self): pass\n"), F.lit(""))
    files = t.part.select(F.concat("p_brand", F.lit("/"), "p_partkey", F.lit(".py")).alias("path"), F.lit("python").alias("language"), src.alias("code"))
    return C.repository_map(files)["folders"].withColumn("languages", F.array_join("languages", ","))


@query("cmp15_pipeline_chunks", "SELECT page_id AS id, count(*) AS chunks FROM pages WHERE length(html) > 80 GROUP BY 1")
def cmp15(t):
    md = t.pages.filter(F.length("html") > 80).select(F.col("page_id").alias("id"), F.replace("html", F.lit("\n"), F.lit(" ")).alias("text"))
    return C.document_pipeline(md)["chunks"].groupBy("id").agg(F.count("*").alias("chunks"))


@query("cmp09_refreshed", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, CASE WHEN c_custkey % 4 <> 3 THEN 'book' END) AS journal FROM customer")
def cmp09(t):
    papers = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("journal"))
    found = t.customer.filter("c_custkey % 4 <> 3").select("c_custkey", F.lit(None).cast("string").alias("journal"), F.lit("book").alias("booktitle"))
    return C.refreshed(papers, found, "c_custkey")


@query("tgf09_parser_sections", "SELECT p_partkey, unnest(['A', 'A > B', 'A > B', 'C']) AS path FROM part")
def tgf09(t):
    item = lambda label, level, text: f'{{"label":"{label}","level":{level},"text":"{text}"}}'
    doc = '{"texts":[' + ",".join([item("section_header", 1, "A"), item("section_header", 2, "B"), item("text", 0, "x"), item("section_header", 1, "C")]) + "]}"
    return C.parser_sections(t.part.select("p_partkey", F.lit(doc).alias("json")), "p_partkey").select("p_partkey", "path")


@query("mth07_cross_product", "SELECT s_suppkey, (2.0 * 0 - s_suppkey * 1.0)::DOUBLE AS x FROM supplier")
def mth07(t):
    a = F.array(F.lit(1.0), F.lit(2.0), F.col("s_suppkey").cast("double"))
    return t.supplier.select("s_suppkey", C.cross(a, F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)))[0].alias("x"))


@query("mth08_power_steps", "SELECT s_suppkey, round(pow(s_suppkey % 7 / 10.0, 13), 9) AS p FROM supplier")
def mth08(t):
    s = t.supplier.select("s_suppkey", (F.col("s_suppkey") % 7 / 10.0).alias("x"))
    for name, expression in C.power_steps(13):
        s = s.withColumn(name, F.expr(expression))
    return s.select("s_suppkey", F.round("x_to_13", 9).alias("p"))


@query("str15_repaired_paths", "SELECT page_id, CASE WHEN page_id IN (1, 2) THEN '/new/' ELSE '/old/' END || page_id AS path FROM pages")
def str15(t):
    known = F.array(F.lit("/new/1"), F.lit("/new/2"))
    return t.pages.select("page_id", C.repaired_path(F.concat(F.lit("/old/"), "page_id"), "/old/", "/new/", known).alias("path"))


@query("src23_candidates", "SELECT DISTINCT a.c_mktsegment AS stem, 'run/' || b.c_mktsegment || '_' || b.c_nationkey || '.md' AS path FROM customer a JOIN customer b ON a.c_mktsegment = b.c_mktsegment")
def src23(t):
    stems = t.customer.select(F.col("c_mktsegment").alias("stem")).distinct()
    files = t.customer.select(F.concat(F.lit("run/"), "c_mktsegment", F.lit("_"), "c_nationkey", F.lit(".md")).alias("path")).distinct()
    return C.candidates(stems, files)


@query("src24_owned_names", "SELECT page_id, substr(sha256(html), 1, 16) || '_' || page_id || '.html' AS name FROM pages")
def src24(t):
    return t.pages.select("page_id", C.owned_name(F.col("html"), F.concat(F.lit("/a/"), "page_id", F.lit(".html"))).alias("name"))


@query("src28_ctags_lines", "SELECT p_name AS name, 'a.c' AS path, '/x/' AS pattern, 'f' AS kind FROM part")
def src28(t):
    lines = t.part.select(F.concat_ws("\t", "p_name", F.lit("a.c"), F.lit("/x/"), F.lit("f")).alias("value")).unionByName(t.spark.sql("SELECT '!_TAG\tx\ty\tz' AS value"))
    return C.ctags_lines(lines)


@query("src30_implementations", "SELECT 'f' || p_partkey || '.h' AS header, CASE WHEN p_partkey % 2 = 0 THEN 'f' || p_partkey || '.cpp' END AS implementation FROM part")
def src30(t):
    name = F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    files = t.part.select(F.concat(name, F.lit(".h")).alias("path")).unionByName(t.part.filter("p_partkey % 2 = 0").select(F.concat(name, F.lit(".cpp")).alias("path")))
    return C.implementations(files)


@query("jsn02_rows_to_json", "SELECT json_object('r_regionkey', r_regionkey, 'r_name', r_name)::VARCHAR AS json FROM region")
def jsn02(t):
    return t.region.select(F.to_json(F.struct("r_regionkey", "r_name")).alias("json"))


@query("arr01_first_distinct", "SELECT o_custkey, array_to_string(list_distinct(list(o_orderpriority))[1:0] || list_sort(list_distinct(list(o_orderpriority)))[1:3], ',') AS first3 FROM orders GROUP BY 1")
def arr01(t):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.slice(F.sort_array(F.collect_set("o_orderpriority")), 1, 3), ",").alias("first3"))


@query("fil22_topic_papers", "SELECT o_custkey AS topic_id, count(*) AS papers FROM orders GROUP BY 1")
def fil22(t):
    return t.orders.groupBy(F.col("o_custkey").alias("topic_id")).agg(F.count("*").alias("papers"))


@query("fil24_artefact_or_empty", "SELECT d.doc_id, coalesce(p.url, '') AS artefact FROM documents d LEFT JOIN pages p ON d.doc_id = p.page_id")
def fil24(t):
    return t.documents.select("doc_id").join(t.pages.select(F.col("page_id").alias("doc_id"), "url"), "doc_id", "left").select("doc_id", F.coalesce("url", F.lit("")).alias("artefact"))


@query("fil25_not_keywords", "SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]+')), lambda w: w NOT IN ('if', 'for', 'return', 'in'))) AS n FROM documents")
def fil25(t):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return t.documents.select("doc_id", F.size(F.filter(words, lambda w: ~w.isin("if", "for", "return", "in"))).cast("long").alias("n"))


@query("fts05_paper_level_index", "SELECT term, count(DISTINCT paper_id) AS n FROM (SELECT doc_id AS paper_id, unnest(regexp_extract_all(lower(strip_accents(substr(text, 1, 200000) || ' ' || source)), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY 1 HAVING n > 30")
def fts05(t):
    from tessera.operators import search

    units = t.documents.select(F.col("doc_id").alias("unit_id"), F.col("doc_id").alias("paper_id"), F.concat_ws(" ", F.substring("text", 1, 200_000), "source").alias("content"))
    return search.postings(units).groupBy("term").agg(F.count("*").alias("n")).filter("n > 30")
