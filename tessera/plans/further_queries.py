"""The rest of the inventory on the driver's tables: updates, text functions, parsers and resolutions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import hooks
from tessera.functions import text as X
from tessera.operators import jobs as J
from tessera.operators import code, documents, identity, parsing, search, sequences, vectors
from tessera.operators import relational as R
from tessera.registry import query
from tessera.sources import readers, writers


@query("dml02_conditional_update", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS c_name FROM customer")
def dml02(t):
    return J.conditional_update(t.customer.select("c_custkey", "c_name"), F.col("c_custkey") % 3 == 0, {"c_name": F.lit("new")})


@query("dml07_fold_run_events", "SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'ok' WHEN bool_or(event_type = 'error') THEN 'failed' ELSE 'running' END AS status, min(ts) AS started_at, max(ts) AS finished_at FROM events GROUP BY 1")
def dml07(t):
    return J.folded_runs(t.events, "user_id", "event_type", "ts", {"purchase": "ok", "error": "failed"}, "running")


@query("dml11_alias_ignore", "SELECT DISTINCT p_type AS tag, lower(trim(p_brand)) AS normalized_alias FROM part")
def dml11(t):
    a = t.part.select(F.col("p_type").alias("tag"), X.normalize_alias(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("x"), F.lower(F.trim("p_brand")).alias("normalized_alias"))
    return R.insert_ignore(a.filter("normalized_alias = 'brand#11'").select("tag", "normalized_alias").distinct(), a.select("tag", "normalized_alias"), ["tag", "normalized_alias"])


@query("dml14_move_assertions", "SELECT DISTINCT l_orderkey, CASE WHEN l_linestatus = 'O' THEN 'F' ELSE l_linestatus END AS l_linestatus, l_returnflag FROM lineitem")
def dml14(t):
    return R.merge_tags(t.lineitem.select("l_orderkey", "l_linestatus", "l_returnflag"), "l_linestatus", "O", "F", ["l_orderkey", "l_linestatus", "l_returnflag"])


@query("dml15_delete_tag", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#11')")
def dml15(t):
    gone = t.part.filter("p_brand = 'Brand#11'").select(F.col("p_partkey").alias("l_partkey"))
    return R.missing(t.lineitem.select("l_partkey", "l_orderkey"), gone, "l_partkey").select("l_orderkey", "l_partkey")


@query("dml20_topic_papers_ignore", "SELECT DISTINCT o_custkey AS topic_id, o_orderkey AS paper_id FROM orders WHERE o_totalprice > 1000")
def dml20(t):
    rows = t.orders.filter("o_totalprice > 1000").select(F.col("o_custkey").alias("topic_id"), F.col("o_orderkey").alias("paper_id"))
    return R.insert_ignore(rows.limit(0), rows.unionByName(rows), ["topic_id", "paper_id"])


@query("dml22_user_tags", "SELECT c_custkey, 'user' AS category, replace(c_mktsegment || '_' || c_nationkey, '_', ' ') AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'domain', replace(c_mktsegment || '_' || c_nationkey, '_', ' ') FROM customer WHERE c_custkey % 2 = 1")
def dml22(t):
    raw = F.concat(F.when(F.col("c_custkey") % 2 == 1, "domain:").otherwise(""), F.col("c_mktsegment"), F.lit("_"), F.col("c_nationkey"))
    return t.customer.select("c_custkey", J.user_tag(raw).alias("x")).select("c_custkey", "x.*")


@query("srt02_top_by_price", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100")
def srt02(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(100)


@query("srt07_last_size", "SELECT source, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1 HAVING arg_max(n_chars, doc_id) > 500")
def srt07(t):
    return R.latest(t.documents, ["source"], "n_chars", "doc_id").filter("n_chars > 500").orderBy(F.desc("n_chars"))


@query("jon02_restricted_ids", "SELECT doc_id, length(text)::BIGINT AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def jon02(t):
    return R.present(t.documents.select("doc_id", F.length("text").cast("long").alias("chars")), t.labels.filter("quality = 1"), "doc_id")


@query(
    "jon12_containment",
    """WITH s AS (SELECT DISTINCT substr(text, 1, 60) AS stem FROM documents WHERE length(text) >= 60), k AS (SELECT doc_id AS ordinal, substr(text, 1, 45) AS key FROM documents WHERE length(text) >= 60)
    SELECT stem, (SELECT arg_min(key, ordinal) FROM k WHERE contains(stem, substr(key, 1, 30)) OR contains(key, substr(stem, 1, 30))) AS match FROM s""",
)
def jon12(t):
    d = t.documents.filter(F.length("text") >= 60)
    stems = d.select(F.substring("text", 1, 60).alias("stem")).distinct()
    keys = d.select(F.col("doc_id").alias("ordinal"), F.substring("text", 1, 45).alias("key"))
    return identity.by_containment(stems, keys).select("stem", "match")


@query("jon13_bibtex_cascade", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_partkey WHEN p_partkey % 3 = 1 THEN p_partkey + 1000000 END AS match, CASE WHEN p_partkey % 3 = 0 THEN 'doi' WHEN p_partkey % 3 = 1 THEN 'stem' ELSE 'created' END AS outcome FROM part")
def jon13(t):
    p = t.part.select("p_partkey")
    doi = p.filter("p_partkey % 3 = 0").withColumn("match", F.col("p_partkey"))
    stem = p.filter("p_partkey % 3 <> 2").withColumn("match", F.col("p_partkey") + 1_000_000)
    return identity.cascade(p, "p_partkey", [("doi", doi), ("stem", stem)])


@query("jon17_suffix_resolution", "WITH f AS (SELECT r_name || '::' || n_name AS name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT n_name AS call, name AS target FROM f UNION ALL SELECT 'NOWHERE', 'NOWHERE'")
def jon17(t):
    functions = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("::", "r_name", "n_name").alias("name"))
    calls = t.nation.select(F.col("n_name").alias("call")).unionByName(t.spark.sql("SELECT 'NOWHERE' AS call"))
    return parsing.by_suffix(calls, functions)


@query("jon20_includes", "SELECT source || '/main.c' AS path, lang || '.h' AS include, CASE WHEN lang = 'en' THEN source || '/en.h' WHEN lang = 'de' THEN 'include/de.h' END AS file FROM (SELECT DISTINCT source, lang FROM documents)")
def jon20(t):
    d = t.documents.select("source", "lang").distinct()
    edges = d.select(F.concat("source", F.lit("/main.c")).alias("path"), F.concat("lang", F.lit(".h")).alias("include"))
    files = d.select(F.concat("source", F.lit("/en.h")).alias("path")).unionByName(t.spark.sql("SELECT 'include/de.h' AS path"))
    return parsing.resolve_includes(edges, files)


@query("jon24_attach_members", "SELECT c_mktsegment AS class, 'f' || c_nationkey || '.cpp' AS file, c_name AS name, CASE WHEN c_nationkey < 10 THEN 'f' || c_nationkey || '.cpp' WHEN c_nationkey < 20 THEN 'f' || c_nationkey || '.h' END AS class_file FROM customer")
def jon24(t):
    members = t.customer.select(F.col("c_mktsegment").alias("class"), F.concat(F.lit("f"), "c_nationkey", F.lit(".cpp")).alias("file"), F.col("c_name").alias("name"))
    end = F.when(F.col("c_nationkey") < 10, ".cpp").otherwise(".h")
    classes = t.customer.filter("c_nationkey < 20").select(F.col("c_mktsegment").alias("class"), F.concat(F.lit("f"), "c_nationkey", end).alias("file")).distinct()
    return code.attach(members, classes)


@query("str03_latex_accents", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Müller ' WHEN 1 THEN 'Gödel é ' ELSE 'ñandú ' END || c_name AS name FROM customer")
def str03(t):
    return t.customer.select("c_custkey", X.decode_latex(F.concat(F.element_at(F.array(F.lit('M\\"{u}ller {'), F.lit("G\\\"odel \\'e {"), F.lit("\\~nand\\'{u} {")), (F.col("c_custkey") % 3 + 1).cast("int")), "c_name", F.lit("}"))).alias("name"))


@query("str07_filename", "SELECT doc_id, substr(regexp_replace(regexp_replace(text, '[^A-Za-z0-9.-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 40) AS name FROM documents")
def str07(t):
    return t.documents.select("doc_id", X.safe_filename(F.col("text"), 40).alias("name"))


@query("str11_excerpt")
def str11(t):
    return t.documents.select("doc_id", X.excerpt(F.col("text"), 200).alias("excerpt"))


@query("str12_section", "SELECT page_id, split_part(split_part(html, '<body>', 2), '</body>', 1) AS body FROM pages WHERE contains(html, '<body>')")
def str12(t):
    return t.pages.filter(F.col("html").contains("<body>")).select("page_id", X.section(F.col("html"), "<body>", "</body>").alias("body"))


@query("str13_compile", "SELECT page_id, url || chr(10) || chr(10) || '# Extracted source text' || chr(10) || chr(10) || 'body ' || page_id AS text FROM pages")
def str13(t):
    return t.pages.select("page_id", X.compile_markdown(F.col("url"), F.concat(F.lit("old\n# Extracted source text\n\nbody "), "page_id")).alias("text"))


@query("str16_backend", "SELECT page_id, CASE WHEN contains(lower(url), 'vlm') THEN 'vlm' WHEN contains(lower(url), 'pdfminer') THEN 'pdfminer' ELSE 'legacy_docling' END AS backend FROM pages")
def str16(t):
    return t.pages.select("page_id", X.infer_backend(F.col("url")).alias("backend"))


@query("str19_comments", "SELECT doc_id, length(regexp_replace(text, '#[^\\n]*', '', 'g'))::BIGINT AS chars FROM documents")
def str19(t):
    return t.documents.select("doc_id", F.length(X.without_comments(F.col("text"), "python")).cast("long").alias("chars"))


@query("str22_path", "SELECT page_id, '/papers/' || page_id || '.pdf' AS path FROM pages")
def str22(t):
    return t.pages.select("page_id", X.clean_path(F.concat(F.lit(":/papers/"), "page_id", F.lit(".pdf:pdf"))).alias("path"))


@query("str25_positions", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations")
def str25(t):
    return t.conversations.withColumn("position", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long")).select("conv_id", "turn", "role", "position")


def _markdown(t):
    return t.part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("# Head "), "p_brand", F.lit("\nbefore\n$$ e = "), "p_size", F.lit(" $$ (2.1)\nafter\nKeywords: alpha, "), "p_type", F.lit("; alpha, xy\n## Algorithm 1: Solve\n1. first step\n2. second step\n# End\n1. not a step\n")).alias("text"))


@query("tgf08_equations_in_context", "SELECT p_partkey AS id, 2 AS line_no, 'e = ' || p_size AS latex, '2.1' AS number, 'Head ' || p_brand AS heading, 'before' AS before, 'after' AS after FROM part")
def tgf08(t):
    return parsing.equations_in_context(_markdown(t), "id")


@query("tgf10_algorithms", "SELECT p_partkey AS id, 'Algorithm 1: Solve' AS name, 'first step|second step' AS steps, 0.9::DOUBLE AS confidence FROM part")
def tgf10(t):
    return parsing.algorithms(_markdown(t), "id").withColumn("steps", F.array_join("steps", "|"))


@query("tgf11_keywords", "SELECT p_partkey AS id, unnest(['alpha', p_type]) AS concept FROM part")
def tgf11(t):
    return documents.keywords(_markdown(t), "id")


@query("tgf04_structured_units", "SELECT 'equation' AS unit_type, count(*) AS n FROM part UNION ALL SELECT 'section', count(*) FROM part WHERE p_partkey % 2 = 0")
def tgf04(t):
    p = t.part.select("p_partkey")
    unit = lambda kind: p.select("p_partkey", F.lit(1).alias("ordinal"), F.lit(kind).alias("unit_type"), F.lit("").alias("section_path"), F.lit("x").alias("content"))
    units = unit("equation").unionByName(unit("section").filter("p_partkey % 2 = 0"))
    found = p.filter("p_partkey % 4 = 0").withColumn("latex", F.lit("y"))
    return documents.with_structured(units, found, "p_partkey").groupBy("unit_type").agg(F.count("*").alias("n"))


@query("tgf18_diff_files", "SELECT c_custkey, 'src/' || c_nationkey || '.c' AS file, 2::BIGINT AS added, 1::BIGINT AS removed FROM customer")
def tgf18(t):
    diff = F.concat(F.lit("diff --git a/src/"), "c_nationkey", F.lit(".c b/src/x.c\n--- a\n+++ b\n+one\n+two\n-three\n same\n"))
    return code.diff_files(t.customer.select("c_custkey", diff.alias("text")), "c_custkey", "text")


@query("tgf20_method_rows", "SELECT p_partkey AS paper_id, CASE WHEN p_size > 25 THEN p_name ELSE 'unnamed' END AS name, CAST(CASE WHEN p_partkey % 2 = 0 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS confidence FROM part")
def tgf20(t):
    name = F.when(F.col("p_size") > 25, F.col("p_name"))
    source = t.part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("paper_id"), name.alias("name"), F.lit(0.9).alias("confidence"), F.array("p_type").alias("steps"))
    other = t.part.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("paper_id"), name.alias("name"), F.lit(None).cast("double").alias("confidence"), F.lit("{}").alias("card_json"))
    return parsing.method_rows(source, other).select("paper_id", "name", "confidence")


@query("tgf25_kernels", "SELECT p_partkey, 'k' || p_partkey AS name, 'n,pos' AS arguments FROM part")
def tgf25(t):
    src = F.concat(F.lit("__kernel void k"), "p_partkey", F.lit("(int n, __global float4* pos) { }"))
    return t.part.select("p_partkey", F.explode(parsing.kernel_headers(src)).alias("k")).select("p_partkey", "k.name", F.array_join("k.arguments", ",").alias("arguments"))


@query("tgf26_ring", "SELECT range AS id, round(2 * cos(range * pi() / 18), 6) + 0.0 AS x, round(2 * sin(range * pi() / 18), 6) + 0.0 AS y FROM range(36) WHERE (SELECT count(*) FROM region) > 0")
def tgf26(t):
    return vectors.ring(t.spark, 36, 2.0).join(t.region.limit(1).select(F.lit(1).alias("one"))).select("id", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


@query("tgf22_function_context", """WITH l AS (SELECT doc_id, part[i] AS line, i - 1 AS n FROM (SELECT doc_id, part, unnest(range(1, len(part) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS part FROM documents))),
  s AS (SELECT doc_id, sum(length(line) + 1) AS chars FROM l GROUP BY 1) SELECT doc_id, 'f' AS name, md5(string_agg(line, chr(10) ORDER BY n)) AS h FROM l JOIN s USING (doc_id) WHERE chars <= 1000 OR n BETWEEN 1 AND 2 GROUP BY 1""")
def tgf22(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    spans = t.documents.select("doc_id", F.lit("f").alias("name"), F.lit(1).alias("first"), F.lit(2).alias("last"))
    return parsing.function_context(lines, spans, "doc_id", "n", "line", 1000).select("doc_id", "name", F.md5("context").alias("h"))


@query("cmp17_insert_lines", """SELECT conv_id, n, text FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY o) - 1 AS n, text FROM
  (SELECT conv_id, turn * 2 AS o, text FROM conversations UNION ALL SELECT conv_id, 2 * 1 - 1, 'doc' FROM (SELECT DISTINCT conv_id FROM conversations)))""")
def cmp17(t):
    lines = t.conversations.select("conv_id", F.col("turn").alias("n"), "text")
    added = lines.select("conv_id").distinct().select("conv_id", F.lit(1).cast("long").alias("n"), F.lit("doc").alias("text"))
    return parsing.insert_lines(lines, added, "conv_id", "n", "text").select("conv_id", F.col("n").cast("long").alias("n"), "text")


@query("cmp05_match_scores", "SELECT paper_id, 1.0 / r AS match_score FROM (SELECT o_orderkey AS paper_id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 30")
def cmp05(t):
    return J.match_scores(t.orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 30).select(F.col("o_orderkey").alias("paper_id"), "match_score")


@query("cmp12_resolve_canonical", "SELECT DISTINCT p_brand AS raw, CASE WHEN p_brand = 'Brand#11' THEN 'Brand#12' ELSE p_brand END AS canonical FROM part")
def cmp12(t):
    raw = t.part.select(F.col("p_brand").alias("raw")).distinct()
    names = raw.filter("raw <> 'Brand#11'").select("raw", F.col("raw").alias("match"))
    aliases = t.spark.sql("SELECT 'Brand#11' AS raw, 'Brand#12' AS match")
    return identity.cascade(raw, "raw", [("name", names), ("alias", aliases)]).select("raw", F.col("match").alias("canonical"))


@query("cmp13_formula_check", "SELECT p_partkey, 'b' || p_size AS missing, 21::BIGINT AS cost FROM part")
def cmp13(t):
    formula = F.concat(F.lit("a^2 + b"), F.col("p_size"))
    used = F.array_distinct(F.regexp_extract_all(formula, F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    return t.part.select("p_partkey", F.array_join(code.undefined(used, F.array(F.lit("a")), ["pi"]), ",").alias("missing"), X.operator_cost(formula).alias("cost"))


@query("grf05_call_edges", "SELECT DISTINCT a.n_name AS caller, b.n_name AS callee FROM nation a JOIN nation b ON b.n_nationkey IN ((a.n_nationkey + 1) % 25, a.n_regionkey)")
def grf05(t):
    names = t.nation.agg(F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("m"))  # 25 nations
    called = t.nation.crossJoin(F.broadcast(names)).select(F.col("n_name").alias("name"), F.array(F.col("m")[(F.col("n_nationkey") + 1) % 25], F.col("m")[F.col("n_regionkey")], F.lit("printf")).alias("calls"))
    return parsing.within_folder_graph(called)


@query("src09_bibtex_lookup", "SELECT 'k' || p_partkey AS entry_id, 'f' || p_partkey AS key FROM part")
def src09(t):
    entries = t.part.select(F.concat(F.lit("k"), "p_partkey").alias("entry_id"), F.col("p_partkey").alias("ordinal"), F.concat(F.lit(":/x/f"), "p_partkey", F.lit(".pdf:pdf")).alias("file"), F.lit("").alias("title"))
    return readers.bibtex_lookup(entries)


@query("snk03_bibtex_entry", "SELECT c_custkey, '@article{c' || c_custkey || ',' || chr(10) || '  title = {' || c_name || '}' || chr(10) || '}' || chr(10) AS bibtex FROM customer")
def snk03(t):
    return t.customer.select("c_custkey", writers.bibtex_entry(F.concat(F.lit("c"), "c_custkey"), title=F.col("c_name"), doi=F.lit(None).cast("string")).alias("bibtex"))


@query("snk07_commit_pages", "SELECT event_id::VARCHAR AS hash, '# Commit ' || event_id || chr(10) || chr(10) || 'Author: ' || user_id || chr(10) || 'Date: d' || chr(10) || chr(10) || event_type || chr(10) AS page FROM events")
def snk07(t):
    return writers.commit_pages(t.events.select(F.col("event_id").cast("string").alias("hash"), F.col("user_id").cast("string").alias("author"), F.lit("d").alias("date"), F.col("event_type").alias("message")))


@query("hsh03_cached_hashes", "SELECT page_id::VARCHAR AS path, length(html)::BIGINT AS size, 0 AS modified, CASE WHEN page_id % 2 = 0 THEN 'cached' ELSE sha256(html) END AS sha256 FROM pages")
def hsh03(t):
    found = t.pages.select(F.col("page_id").cast("string").alias("path"), F.length("html").cast("long").alias("size"), F.lit(0).alias("modified"), F.encode("html", "utf-8").alias("content"))
    cache = found.filter("cast(path AS int) % 2 = 0").select("path", "size", "modified", F.lit("cached").alias("sha256"))
    return readers.with_hashes(found, cache)


@query("mth02_named_steps", "SELECT s_suppkey, round((s_acctbal * 2 + 1) * (s_acctbal * 2), 4) AS c FROM supplier")
def mth02(t):
    return J.named_steps(t.supplier, [("a", "s_acctbal * 2"), ("b", "a + 1"), ("c", "b * a")]).select("s_suppkey", F.round("c", 4).alias("c"))


@query("mth05_exp_linear", "SELECT s_suppkey, round(pow(greatest(1 - s_suppkey / 50.0 / 8, 0), 8), 6) AS e FROM supplier")
def mth05(t):
    return t.supplier.select("s_suppkey", F.round(vectors.exp_linear(-F.col("s_suppkey") / 50.0, 8), 6).alias("e"))


@query("win04_preferred_run", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'click') DESC, event_id) AS r FROM events) WHERE r = 1")
def win04(t):
    return J.preferred_run(t.events, "user_id", "event_id", F.col("event_type") == "click")


@query("fts08_tag_ids", "SELECT min(p_partkey) AS id FROM part WHERE lower(p_brand) = 'brand#21' OR lower(p_name) = 'brand#21'")
def fts08(t):
    p = lambda c: t.part.select(F.col("p_partkey").alias("id"), F.col(c).alias("name"))
    return J.tag_ids(p("p_brand"), p("p_name"), "Brand#21").agg(F.min("id").alias("id"))


@query("fts12_methods_of_hits", "SELECT doc_id AS paper_id, quality FROM documents JOIN labels USING (doc_id) WHERE contains(lower(text), 'license')")
def fts12(t):
    hits = R.contains_any(t.documents, F.col("text"), ["license"]).select(F.col("doc_id").alias("paper_id"))
    return hits.join(t.labels.select(F.col("doc_id").alias("paper_id"), "quality"), "paper_id")


@query("fil20_query_split", "SELECT 'text' AS part, 'spin glass' AS value UNION ALL SELECT 'domain', 'solid state' WHERE (SELECT count(*) FROM region) > 0")
def fil20(t):
    text, tags = search.split_query("spin domain:solid_state glass")
    return t.spark.createDataFrame([("text", text), *tags], "part string, value string")


@query("rag02_embed")
def rag02(t):
    return t.documents.select("doc_id", hooks.embed(F.col("text"), 16).alias("embedding"))


@query("udf02_summaries", "SELECT page_id, url, trim(url) AS summary, NULL::VARCHAR AS error FROM pages")
def udf02(t):
    return hooks.per_row(t.pages.select("page_id", "url"), "url", hooks.summarize, "summary")


@query("rag_prompt_windows", "SELECT conv_id, count(*) AS n FROM (SELECT conv_id, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS s FROM conversations) WHERE s <= 900 GROUP BY 1")
def rag_prompt(t):
    return sequences.trim_history(t.conversations, "conv_id", "turn", F.length("text"), 900).groupBy("conv_id").agg(F.count("*").alias("n"))
