"""FIL, JON, AGG, SET, DML and WIN01-05 on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.registry import RUNS_SQL, query

TAGS_SQL = "(SELECT DISTINCT p_brand AS name, p_type AS category FROM part)"
LINKS_SQL = "(SELECT l_orderkey AS paper_id, p_brand AS name, p_type AS category, l_returnflag AS source FROM lineitem JOIN part ON l_partkey = p_partkey)"


def tags(t):
    return t.part.select(F.col("p_brand").alias("name"), F.col("p_type").alias("category")).distinct()


def links(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("paper_id"), F.col("p_brand").alias("name"), F.col("p_type").alias("category"), F.col("l_returnflag").alias("source"))


@query("fil01_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def fil01(t):
    return t.customer.filter("c_custkey = 42").select("c_custkey", "c_name")


@query("fil02_files_preferred_first", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_returnflag = 'R' AS INT) AS is_preferred FROM lineitem")
def fil02(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").cast("int").alias("is_preferred"))
    return rows.orderBy("l_orderkey", F.desc("is_preferred"), "l_linenumber")


@query("fil03_by_hash", "SELECT d.doc_id, b.doc_id AS same_as FROM documents d JOIN documents b ON sha256(d.text) = sha256(b.text) AND b.doc_id < d.doc_id")
def fil03(t):
    h = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    return h.alias("d").join(h.alias("b"), (F.col("d.h") == F.col("b.h")) & (F.col("b.doc_id") < F.col("d.doc_id"))).select("d.doc_id", F.col("b.doc_id").alias("same_as"))


@query("fil04_current_run", f"SELECT paper_id, max(id) AS run_id FROM {RUNS_SQL} r WHERE status = 'ok' GROUP BY paper_id")
def fil04(t):
    return t.runs.filter("status = 'ok'").groupBy("paper_id").agg(F.max("id").alias("run_id"))


@query("fil05_equivalent_run", f"SELECT paper_id, operation, max(id) AS run_id FROM {RUNS_SQL} r WHERE status = 'ok' AND operation = 1 GROUP BY ALL")
def fil05(t):
    return R.equivalent_runs(t.runs, operation=1)


@query("fil06_year_range", "SELECT o_orderkey, year(o_orderdate)::BIGINT AS year FROM orders WHERE year(o_orderdate) BETWEEN 1993 AND 1995")
def fil06(t):
    rows = t.orders.filter((F.col("o_orderdate") >= "1993-01-01") & (F.col("o_orderdate") < "1996-01-01"))  # reaches the scan
    return R.year_range(rows, F.year("o_orderdate"), 1993, 1995).select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"))


@query("fil07_metadata_candidates", "SELECT doc_id FROM documents WHERE lower(text) LIKE '%license%' OR lower(text) LIKE '%token%'")
def fil07(t):
    return R.contains_any(t.documents, F.col("text"), ["license", "token"]).select("doc_id")


@query("fil08_active", f"SELECT user_id AS paper_id, count(*) AS n FROM events WHERE event_id % 5 = 0 OR event_type = 'purchase' GROUP BY 1")
def fil08(t):
    rows = t.events.select(F.col("user_id").alias("paper_id"), F.when(F.col("event_id") % 5 != 0, F.col("event_id")).alias("run_id"))
    return R.active(rows, t.runs).groupBy("paper_id").agg(F.count("*").alias("n"))


@query("fil09_summary_history", f"SELECT paper_id, id, row_number() OVER (PARTITION BY paper_id ORDER BY id DESC) = 1 AS is_active FROM {RUNS_SQL} r WHERE status = 'ok'")
def fil09(t):
    return R.supersede(t.runs.withColumn("operation", F.lit(0))).select("paper_id", "id", "is_active")


@query("fil10_tags_of_category", f"SELECT name, category FROM {TAGS_SQL} WHERE category = 'ECONOMY' OR category = 'PROMO'")
def fil10(t):
    return tags(t).filter(F.col("category").isin("ECONOMY", "PROMO")).orderBy("category", "name")


@query("fil11_missing_anti", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def fil11(t):
    return R.missing(t.documents.select("doc_id"), t.labels, "doc_id")


@query("jon07_semi", "SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def jon07(t):
    return R.present(t.documents.select("doc_id", "lang"), t.labels.filter("quality = 1"), "doc_id")


@query(
    "fil12_needs_reprocessing",
    f"""WITH r AS {RUNS_SQL} SELECT DISTINCT paper_id FROM r p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.paper_id = p.paper_id AND operation = 1 AND status = 'ok')
    OR EXISTS (SELECT 1 FROM r f WHERE f.paper_id = p.paper_id AND f.status = 'failed' AND NOT EXISTS
      (SELECT 1 FROM r n WHERE n.paper_id = f.paper_id AND n.operation = f.operation AND n.status = 'ok' AND n.id > f.id))""",
)
def fil12(t):
    return R.needs_reprocessing(t.runs, 1)


@query("fil13_facets_any", f"SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT paper_id FROM {LINKS_SQL} WHERE name IN ('Brand#11', 'Brand#22', 'Brand#33')) AND o_orderstatus = 'F'")
def fil13(t):
    papers = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("paper_id"))
    return R.with_any_tag(papers, links(t), "name", ["Brand#11", "Brand#22", "Brand#33"], "paper_id").withColumnRenamed("paper_id", "o_orderkey")


@query("fil13_facets_all", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2)")
def fil13_all(t):
    papers, link = t.orders.select(F.col("o_orderkey").alias("paper_id")), t.lineitem.select(F.col("l_orderkey").alias("paper_id"), "l_returnflag")
    return R.with_all_tags(papers, link, "l_returnflag", ["A", "R"], "paper_id").withColumnRenamed("paper_id", "o_orderkey")


@query("fil14_facets", "SELECT DISTINCT coalesce(nullif(p_type, 'PROMO'), 'uncategorized') AS category FROM part")
def fil14(t):
    return t.part.select(F.coalesce(F.nullif("p_type", F.lit("PROMO")), F.lit("uncategorized")).alias("category")).distinct().orderBy(F.desc("category"))


@query("fil15_like_search", f"SELECT DISTINCT paper_id, name FROM {LINKS_SQL} WHERE lower(name) LIKE '%#1%' AND category = 'STANDARD'")
def fil15(t):
    return R.contains_any(links(t).filter("category = 'STANDARD'"), F.col("name"), ["#1"]).select("paper_id", "name").distinct()


@query("fil16_variable_subset", "SELECT l_orderkey FROM lineitem WHERE l_linestatus IN ('F', 'O') GROUP BY 1 HAVING count(DISTINCT l_linestatus) = 2")
def fil16(t):
    return R.subset_of(t.lineitem, "l_orderkey", "l_linestatus", ["F", "O"])


@query("fil18_page", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 25")
def fil18(t):
    return R.page(t.customer.select("c_custkey", "c_name"), "c_custkey", 50, 25)


@query("fil19_name_contains", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), '7')")
def fil19(t):
    return t.part.filter(F.lower("p_name").contains("7")).select("p_partkey", "p_name")


@query("jon03_tags_distinct", f"SELECT DISTINCT paper_id, name, category FROM {LINKS_SQL}")
def jon03(t):
    return links(t).select("paper_id", "name", "category").distinct()


@query("jon04_first_alias", "SELECT lower(trim(p_name)) AS normalized_alias, min(p_partkey) AS tag_id FROM part GROUP BY 1")
def jon04(t):
    return t.part.groupBy(F.lower(F.trim("p_name")).alias("normalized_alias")).agg(F.min("p_partkey").alias("tag_id"))


@query("jon05_alias_or", "SELECT DISTINCT p_partkey FROM part WHERE lower(p_brand) = 'brand#12' OR lower(p_type) = 'promo'")
def jon05(t):
    p = t.part.select("p_partkey", F.lower("p_brand").alias("b"), F.lower("p_type").alias("c"))
    return p.filter("b = 'brand#12'").select("p_partkey").union(p.filter("c = 'promo'").select("p_partkey")).distinct()


@query("jon06_active_left", "SELECT c_custkey, count(e.event_id) AS n_ok FROM customer LEFT JOIN events e ON c_custkey = user_id AND event_type = 'purchase' GROUP BY 1")
def jon06(t):
    n = t.events.filter("event_type = 'purchase'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_ok"))


@query("jon08_three_way", f"SELECT o_orderpriority, category, count(*) AS n FROM orders JOIN {LINKS_SQL} l ON o_orderkey = paper_id GROUP BY ALL")
def jon08(t):
    return t.orders.join(links(t), F.col("o_orderkey") == F.col("paper_id")).groupBy("o_orderpriority", "category").agg(F.count("*").alias("n"))


@query("jon10_semi_known", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1")
def jon10(t):
    known = t.part.filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.join(known, "l_partkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("jon15_equations_by_number", "SELECT DISTINCT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber IN (1, 3)")
def jon15(t):
    refs = t.orders.select("o_orderkey", F.explode(F.split(F.lit("1,3"), ",")).alias("ref"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", F.col("l_linenumber").cast("string").alias("ref"))
    return refs.join(lines, ["o_orderkey", "ref"]).select("o_orderkey", "l_linenumber", "l_partkey").distinct()


@query(
    "agg01_status",
    f"""SELECT 'papers' AS metric, count(*) AS n FROM orders UNION ALL SELECT 'tags', count(*) FROM {TAGS_SQL} UNION ALL
    SELECT 'runs_ok', count(*) FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'with_label', count(DISTINCT doc_id) FROM labels UNION ALL
    SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'with_text', count(text) FROM documents UNION ALL SELECT 'links', count(*) FROM lineitem""",
)
def agg01(t):
    one = lambda df, name, n: df.agg(n.alias("n")).select(F.lit(name).alias("metric"), "n")
    parts = [one(t.orders, "papers", F.count("*")), one(tags(t), "tags", F.count("*")), one(t.events.filter("event_type = 'purchase'"), "runs_ok", F.count("*")), one(t.labels, "with_label", F.count_distinct("doc_id")), one(t.documents, "documents", F.count("*")), one(t.documents, "with_text", F.count("text")), one(t.lineitem, "links", F.count("*"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("agg02_tag_counts", f"SELECT name, category, count(*) AS n FROM {LINKS_SQL} GROUP BY ALL")
def agg02(t):
    return links(t).groupBy("name", "category").agg(F.count("*").alias("n"))


DIST_SQL = f"SELECT t.name, t.category, count(l.paper_id) AS freq FROM {TAGS_SQL} t LEFT JOIN {LINKS_SQL} l USING (name, category) GROUP BY ALL"


def dist(t):
    return R.distribution(tags(t), links(t))


@query("agg03_tag_distribution", DIST_SQL)
def agg03(t):
    return dist(t)


@query("agg03_orphans", "SELECT r_name AS name, 'region' AS category FROM region")
def agg03_orphans(t):
    both = t.lineitem.select("l_partkey").distinct().join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("name"), F.col("p_type").alias("category")).unionAll(t.region.select("r_name", F.lit("region")))
    return R.orphans(both, links(t))


@query("agg03_top20", f"SELECT name, category, freq FROM ({DIST_SQL}) ORDER BY freq DESC, name, category LIMIT 20")
def agg03_top(t):
    return dist(t).orderBy(F.desc("freq"), "name", "category").limit(20)


@query("agg04_vault_having", f"SELECT category, name, count(*) AS cnt FROM {LINKS_SQL} GROUP BY ALL HAVING count(*) > 40")
def agg04(t):
    return links(t).groupBy("category", "name").agg(F.count("*").alias("cnt")).filter("cnt > 40").orderBy("category", F.desc("cnt"), "name")


@query("agg06_latest_status", f"SELECT paper_id, operation, arg_max(status, id) AS status FROM {RUNS_SQL} r GROUP BY ALL")
def agg06(t):
    return R.latest(t.runs, ["paper_id", "operation"], "status", "id")


@query("agg07_folder_stats", "SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS lines, array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages FROM documents GROUP BY 1")
def agg07(t):
    return R.folder_stats(t.documents, "source", F.col("n_chars"), "lang")


@query("agg08_tech_matrix", "SELECT source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM documents GROUP BY 1")
def agg08(t):
    return R.matrix(t.documents, "source", "lang", ["de", "en", "es", "fr"])


@query("agg09_symbols_per_file", "SELECT l_orderkey, count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def agg09(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"))


@query("agg10_pipeline_report", "SELECT count(*) AS n, count(*) FILTER (n_chars > 1000) AS converted, count(*) FILTER (contains(text, '$$')) AS with_equations, sum(n_chars)::BIGINT AS chars FROM documents")
def agg10(t):
    return t.documents.agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("converted"), F.count_if(F.col("text").contains("$$")).alias("with_equations"), F.sum("n_chars").alias("chars"))


@query("agg14_batch_outcomes", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def agg14(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("agg17_tags_by_category", f"SELECT paper_id, category, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM {LINKS_SQL} GROUP BY ALL")
def agg17(t):
    return links(t).groupBy("paper_id", "category").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names"))


@query("set01_union", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT l_orderkey FROM lineitem WHERE l_quantity > 45")
def set01(t):
    return t.orders.filter("o_orderstatus = 'F'").select("o_orderkey").union(t.lineitem.filter("l_quantity > 45").select("l_orderkey")).distinct()


@query("set01_difference", "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def set01_minus(t):
    return t.orders.select("o_orderkey").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_anti").distinct()


@query("set01_intersection", "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def set01_both(t):
    return t.lineitem.filter("l_returnflag = 'A'").select("l_orderkey").intersect(t.lineitem.filter("l_returnflag = 'R'").select("l_orderkey"))


@query("set02_pairs_across_runs", "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem")
def set02(t):
    by_year = [t.lineitem.filter(F.col("l_linestatus") == s).select("l_suppkey", "l_partkey") for s in ("F", "O")]
    return by_year[0].unionByName(by_year[1]).distinct()


@query("set03_roots", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT n_regionkey FROM nation)")
def set03(t):
    return t.nation.join(t.nation.select(F.col("n_regionkey").alias("n_nationkey")).distinct(), "n_nationkey", "left_anti").select("n_name")


@query("win01_last_wins", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def win01(t):
    return R.latest(t.events, ["user_id"], "event_type", "event_id")


@query("win02_first_plus_override", "SELECT user_id, arg_min(event_type, event_id) AS event_type, arg_max(nullif(props, ''), event_id) AS props FROM events GROUP BY 1")
def win02(t):
    return R.first_with_override(t.events, "user_id", "event_type", "props", "event_id")


@query("win03_priority", """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY
  CASE event_type WHEN 'purchase' THEN 5 WHEN 'click' THEN 4 WHEN 'view' THEN 1 ELSE 0 END DESC, event_id) AS r FROM events) WHERE r = 1""")
def win03(t):
    return R.best_by_priority(t.events, "user_id", "event_type", {"purchase": 5, "click": 4, "view": 1}, "event_id")


@query("win05_suffix", """SELECT c_custkey, CASE WHEN r = 1 THEN base ELSE base || '_' || r END AS paper_key FROM
  (SELECT c_custkey, c_mktsegment || '_' || c_nationkey AS base, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS r FROM customer)""")
def win05(t):
    return R.numbered_collisions(t.customer.withColumn("base", F.concat_ws("_", "c_mktsegment", "c_nationkey")), "base", "c_custkey").select("c_custkey", "paper_key")


@query("srt04_top_k_per_group", """SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3""")
def srt04(t):
    return R.top_per_group(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@query("srt05_smallest_first", "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars, doc_id LIMIT 40")
def srt05(t):
    return t.documents.filter("lang = 'en'").select("doc_id", "n_chars").orderBy("n_chars", "doc_id").limit(40)


@query("dml01_upsert_coalesce", """SELECT coalesce(s.c_custkey, t.c_custkey) AS c_custkey, coalesce(s.c_name, t.c_name) AS c_name, coalesce(s.c_acctbal, t.c_acctbal) AS c_acctbal
  FROM (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0) t
  FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) END AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 3 = 0) s USING (c_custkey)""")
def dml01(t):
    c = t.customer.select("c_custkey", "c_name", "c_acctbal")
    s = c.filter("c_custkey % 4 = 0 OR c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return R.upsert(c.filter("c_custkey % 3 <> 0"), s, "c_custkey")


@query("dml04_preferred_file", "SELECT doc_id AS id, source AS paper_id, CAST(doc_id = max(doc_id) OVER (PARTITION BY source) AS INT) AS is_preferred FROM documents")
def dml04(t):
    files = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("paper_id"), F.lit(1).alias("is_preferred"))
    return R.preferred_file(files, files.groupBy("paper_id").agg(F.max("id").alias("file_id"))).select("id", "paper_id", "is_preferred")


@query("dml05_replace_units", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey % 10 <> 0 UNION ALL SELECT l_orderkey, l_linenumber, -l_quantity FROM lineitem WHERE l_orderkey % 10 = 0 AND l_linenumber = 1")
def dml05(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    # a key's rows are all replaced; keys without a first line stay as they are
    source = rows.filter("l_orderkey % 10 = 0 AND l_linenumber = 1").withColumn("l_quantity", -F.col("l_quantity"))
    return R.replace_group(rows, source, "l_orderkey").filter("l_orderkey % 10 <> 0 OR l_quantity < 0")


@query("dml09_supersede", f"SELECT id, paper_id, operation, row_number() OVER w = 1 AS is_active, lead(id) OVER w AS supersedes_run_id FROM {RUNS_SQL} r WHERE status = 'ok' WINDOW w AS (PARTITION BY paper_id, operation ORDER BY id DESC)")
def dml09(t):
    return R.supersede(t.runs)


@query("dml10_insert_or_find", "SELECT DISTINCT p_brand, p_type FROM part")
def dml10(t):
    p = t.part.select("p_brand", "p_type")
    return R.insert_ignore(p.filter("p_type = 'PROMO'").distinct(), p, ["p_brand", "p_type"])


@query("dml12_first_visible", "SELECT user_id AS paper_id, CAST(floor(value) AS INT) % 5 AS tag_id, coalesce(nullif(event_type, 'view'), '') AS source, arg_min(value, event_id) AS confidence, min(event_id) AS event_id FROM events GROUP BY 1, 2, 3")
def dml12(t):
    rows = t.events.select(F.col("user_id").alias("paper_id"), (F.floor("value").cast("int") % 5).alias("tag_id"), F.nullif("event_type", F.lit("view")).alias("source"), F.col("value").alias("confidence"), "event_id")
    return R.first_links(rows, "event_id")


@query("dml13_refresh_max", """SELECT a.user_id AS paper_id, a.event_id % 7 AS tag_id, 'llm' AS source, max(a.event_id) AS run_id, max(a.value) AS confidence, max(a.props) AS raw_name
  FROM events a WHERE a.event_type = 'purchase' GROUP BY 1, 2""")
def dml13(t):
    a = t.events.select(F.col("user_id").alias("paper_id"), (F.col("event_id") % 7).alias("tag_id"), F.lit("llm").alias("source"), F.col("event_id").alias("run_id"), F.col("value").alias("confidence"), F.col("props").alias("raw_name"))
    return R.visible_links(a, t.runs)


@query("dml16_merge_tags", "SELECT DISTINCT l_orderkey, CASE WHEN l_returnflag = 'A' THEN 'R' ELSE l_returnflag END AS tag FROM lineitem")
def dml16(t):
    rows = t.lineitem.select("l_orderkey", F.col("l_returnflag").alias("tag"))
    return R.merge_tags(rows, "tag", "A", "R", ["l_orderkey", "tag"])


@query("dml19_active_summary", "SELECT user_id AS paper_id, max(event_id) AS id FROM events WHERE event_id % 4 = 0 OR event_type = 'purchase' GROUP BY 1")
def dml19(t):
    s = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("paper_id"), F.when(F.col("event_id") % 4 != 0, F.col("event_id")).alias("run_id"))
    return R.active_summaries(s, t.runs)


@query("dml21_overwrite", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_name END AS s_name FROM supplier")
def dml21(t):
    s = t.supplier.select("s_suppkey", "s_name")
    return R.overwrite(s, s.filter("s_suppkey % 2 = 0").withColumn("s_name", F.lit(None).cast("string")), "s_suppkey")


@query("dml24_first_category", "SELECT lower(p_name) AS name, arg_min(p_type, p_partkey) AS category FROM part GROUP BY 1")
def dml24(t):
    return t.part.groupBy(F.lower("p_name").alias("name")).agg(F.min_by("p_type", "p_partkey").alias("category"))


@query("surrogate_ids", "SELECT o_orderkey, 1000 + row_number() OVER (ORDER BY o_orderkey) AS id FROM orders")
def surrogate_ids(t):
    return R.start_ids(t.orders.select("o_orderkey"), "o_orderkey", 1000)
