"""STR, HSH, JSN, MAP, ARR, CST and AGG11-12, AGG19 on documents, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import jobs as J
from tessera.registry import query


@query("str01_doi", "SELECT doc_id, nullif(trim(regexp_replace(lower(trim(d)), '^(https?://)?(dx\\.)?doi\\.org/|^doi:\\s*', '')), '') AS doi FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'https://doi.org/10.' WHEN 1 THEN 'doi: 10.' WHEN 2 THEN 'http://dx.doi.org/10.' ELSE ' 10.' END || doc_id || '/AB.C ' AS d FROM documents)")
def str01(t):
    head = F.element_at(F.array(*map(F.lit, ("https://doi.org/10.", "doi: 10.", "http://dx.doi.org/10.", " 10."))), (F.col("doc_id") % 4 + 1).cast("int"))
    return t.documents.select("doc_id", X.normalize_doi(F.concat(head, "doc_id", F.lit("/AB.C "))).alias("doi"))


@query("str02_detect", "SELECT page_id, regexp_extract(html, '(?i)(https?://[a-z0-9./-]+)', 1) AS link, regexp_extract(url, '((?:19|20)[0-9]{2})', 1) AS year FROM pages")
def str02(t):
    return t.pages.select("page_id", F.regexp_extract("html", "(?i)(https?://[a-z0-9./-]+)", 1).alias("link"), F.coalesce(X.find_year(F.col("url")).cast("string"), F.lit("")).alias("year"))


@query("str04_key", "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Macklin_2016_XPBD' WHEN 1 THEN 'Macklin_2016_Customer' || c_custkey WHEN 2 THEN 'Unknown_0000_Untitled' WHEN 3 THEN 'Plato_2016_The' WHEN 4 THEN 'ONeil_2016_mesh' ELSE 'Mller_2016_A' END AS paper_key FROM customer")
def str04(t):
    pick = lambda *x: F.element_at(F.array(*x), (F.col("c_custkey") % 6 + 1).cast("int"))
    authors = pick(*map(F.lit, ("Miles Macklin; Other, B", "Macklin, Miles and X Y", "", "Plato", "O'Neil, J", "Müller, K")))
    title = pick(F.lit("XPBD: a method"), F.concat(F.lit("Customer"), "c_custkey", F.lit(" data")), F.lit(""), F.lit("The of an"), F.lit("Using mesh x"), F.lit("A an"))
    return t.customer.select("c_custkey", X.paper_key(authors, F.when(F.col("c_custkey") % 6 != 2, 2016), title).alias("paper_key"))


@query("str06_norm", "SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g')) AS title FROM documents")
def str06(t):
    return t.documents.select("doc_id", X.normalize_title(F.col("text")).alias("title"))


@query("str08_latex", "SELECT DISTINCT trim(regexp_replace(regexp_replace(regexp_replace(trim(e), '^\\$+|\\$+$', '', 'g'), '\\s*\\([0-9]+(\\.[0-9]+)*\\)\\s*$', ''), '\\s+', ' ', 'g')) AS latex FROM (SELECT '$$ a_' || doc_id % 100 || '  = b (' || doc_id % 7 || '.1) ' AS e FROM documents)")
def str08(t):
    e = F.concat(F.lit("$$ a_"), F.col("doc_id") % 100, F.lit("  = b ("), F.col("doc_id") % 7, F.lit(".1) "))
    return t.documents.select(X.normalize_latex(e).alias("latex")).distinct()


@query("str09_equation_number", "SELECT doc_id, nullif(regexp_extract(e, '\\(([0-9]+(?:\\.[0-9]+)*)\\)\\s*$', 1), '') AS number FROM (SELECT doc_id, 'x = y (' || doc_id % 9 || '.' || doc_id % 4 || ') ' AS e FROM documents)")
def str09(t):
    return t.documents.select("doc_id", X.equation_number(F.concat(F.lit("x = y ("), F.col("doc_id") % 9, F.lit("."), F.col("doc_id") % 4, F.lit(") "))).alias("number"))


@query("str14_rules", "SELECT page_id, CASE WHEN regexp_matches(url, '(?i)blog') THEN 'blog' WHEN regexp_matches(url, '(?i)[0-9]{3}') THEN 'numbered' ELSE url END AS tag FROM pages")
def str14(t):
    return t.pages.select("page_id", X.first_rule(F.col("url"), [("blog", "blog"), ("numbered", "[0-9]{3}")]).alias("tag"))


@query("str18_json", "SELECT event_id, regexp_extract('text ' || props || ' end', '(\\{.*\\})', 1) AS found FROM events")
def str18(t):
    return t.events.select("event_id", X.json_in(F.concat(F.lit("text "), "props", F.lit(" end"))).alias("found"))


@query("str23_rgb", "SELECT p_partkey, round((p_partkey % 256) / 255.0, 6) AS red FROM part")
def str23(t):
    return t.part.select("p_partkey", F.round(X.rgb(F.concat(F.lit("#"), F.lpad(F.hex(F.col("p_partkey") % 256), 2, "0"), F.lit("0000")))[0], 6).alias("red"))


@query("jsn01_extract", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def jsn01(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("cst01_lenient_cast", "SELECT doc_id, TRY_CAST(substr(text, 1, 1) AS INT) AS first_digit, TRY_CAST(source[4:] AS INT) AS source_no FROM documents")
def cst01(t):
    return t.documents.select("doc_id", F.substring("text", 1, 1).try_cast("int").alias("first_digit"), F.substring("source", 4, 99).try_cast("int").alias("source_no"))


@query("map01_lookup", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE 'other' END AS language FROM documents")
def map01(t):
    names = F.create_map(F.lit("en"), F.lit("English"), F.lit("de"), F.lit("German"))
    return t.documents.select("doc_id", F.coalesce(F.try_element_at(names, F.col("lang")), F.lit("other")).alias("language"))


@query("dat01_stamp", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def dat01(t):
    return t.events.select("event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"))


@query("hsh01_sha256", "SELECT doc_id, sha256(text) AS sha, strlen(text)::BIGINT AS size FROM documents")
def hsh01(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("size"))


@query("hsh02_md5_dedup", "SELECT md5(text) AS hash, max(doc_id) AS doc_id FROM documents GROUP BY 1")
def hsh02(t):
    return t.documents.groupBy(F.md5("text").alias("hash")).agg(F.max("doc_id").alias("doc_id"))


@query(
    "agg11_bigrams",
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]{2,}') AS w FROM documents),
    b AS (SELECT w[i] || ' ' || w[i + 1] AS bigram FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w)) SELECT bigram, count(*) AS n FROM b GROUP BY 1 HAVING count(*) >= 50""",
)
def agg11(t):
    return J.bigrams(t.documents, "text", 50)


@query("agg12_op_cost", "SELECT doc_id, " + " + ".join(f"(length(text) - length(replace(text, '{o}', ''))) * {w}" for o, w in X.OPERATOR_COST.items()) + " AS cost FROM documents")
def agg12(t):
    return t.documents.select("doc_id", X.operator_cost(F.col("text")).alias("cost"))


@query("agg19_token_estimates", "SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS up, greatest(1, length(text) // 4)::BIGINT AS down FROM documents")
def agg19(t):
    return t.documents.select("doc_id", X.estimated_tokens(F.col("text")).alias("up"), X.floor_tokens(F.col("text")).alias("down"))


@query("str24_prompt", "SELECT page_id, 'Source: ' || url || chr(10) || 'Question: what?' AS prompt FROM pages")
def str24(t):
    return t.pages.select("page_id", X.prompt("Source: {url}\nQuestion: {question}", url=F.col("url"), question=F.lit("what?")).alias("prompt"))
