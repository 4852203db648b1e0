"""FTS on the documents table: a document is a paper, its lines of 20 characters or more are the units."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import storage
from tessera.operators import jobs as J
from tessera.operators import search as S
from tessera.operators.segments import Segments
from tessera.registry import query

QUERY = "license lang:en"


def units(t):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "content")).filter(F.length("content") >= 20)
    return lines.select((F.col("doc_id") * 1_000_000 + F.col("i")).alias("unit_id"), F.col("doc_id").alias("paper_id"), "content")


_stored: dict[tuple[str, str, str], S.Index] = {}


def index(t) -> S.Index:
    """The stored index of the documents' lines, built once in a session for the table's present files."""
    path = f"{t.sf_dir}/documents.parquet"
    key = (t.spark.sparkContext.applicationId, path, storage.stamp(t.spark, path))
    if key not in _stored:
        _stored[key] = S.Index.build(units(t), storage.new_path(t.spark))
    return _stored[key]


def papers(t):
    title = F.substring_index(F.substring_index("text", "\n", 1), ".", 1)
    return t.documents.select(F.col("doc_id").alias("paper_id"), F.concat(F.lit("doc"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("paper_key"), title.alias("title"), F.col("text").alias("body"), (F.col("doc_id") % 30 + 1990).alias("year"))


def tags(t):
    d = t.documents.select(F.col("doc_id").alias("paper_id"), F.col("lang").alias("name"), F.lit("lang").alias("category"), F.lit("llm").alias("source"))
    q = t.labels.filter("quality = 1").select(F.col("doc_id").alias("paper_id"), F.lit("good").alias("name"), F.lit("label").alias("category"), F.lit("user").alias("source"))
    x = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("paper_id"), F.lit("toxic").alias("name"), F.lit("label").alias("category"), F.lit("user").alias("source"))
    return d.unionByName(q).unionByName(x)


UNITS_SQL = """units AS (SELECT doc_id * 1000000 + i - 1 AS unit_id, doc_id AS paper_id, part[i] AS content FROM
  (SELECT doc_id, part, unnest(range(1, len(part) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS part FROM documents)) WHERE length(part[i]) >= 20),
tok AS (SELECT unit_id, paper_id, regexp_extract_all(lower(strip_accents(content)), '[\\p{L}\\p{N}]+') AS w FROM units)"""


def bm25_sql(phrases: list[str], more: str = "") -> str:
    """phrases: conditions on w[i], one list per phrase."""
    f = ", ".join(f"len(list_filter(range(1, len(w) + 1), lambda i: {p})) AS f{k}" for k, p in enumerate(phrases))
    score = " - ".join(["0.0", *(f"(CASE WHEN ln((u - n{k} + 0.5) / (n{k} + 0.5)) > 0 THEN ln((u - n{k} + 0.5) / (n{k} + 0.5)) ELSE 1e-6 END) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * d / a))" for k in range(len(phrases)))])
    n = ", ".join(f"count(*) FILTER (f{k} > 0) AS n{k}" for k in range(len(phrases)))
    return f"""{UNITS_SQL}, freq AS (SELECT unit_id, paper_id, len(w) AS d, {f} FROM tok), fig AS (SELECT count(*) AS u, avg(d) AS a, {n} FROM freq),
ranked AS (SELECT unit_id, paper_id, {score} AS rank FROM freq, fig WHERE {' AND '.join(f'f{k} > 0' for k in range(len(phrases)))}{more})"""


ROUNDED = "SELECT unit_id, paper_id, round(rank, 6) AS rank FROM ranked"


@query("fts02_bm25", f"WITH {bm25_sql(['w[i] = ' + repr('apache') + ' AND w[i + 1] = ' + repr('license'), 'w[i] = ' + repr('version')])} {ROUNDED}")
def fts02(t):
    return index(t).bm25(S.query_phrases(t.spark, "Apache-License version")).select("unit_id", "paper_id", F.round("rank", 6).alias("rank"))


@query("fts03_restricted", f"WITH {bm25_sql(['w[i] = ' + repr('the')], ' AND paper_id IN (SELECT doc_id FROM labels WHERE quality = 0)')} {ROUNDED}")
def fts03(t):
    good = t.labels.filter("quality = 0").select(F.col("doc_id").alias("paper_id"))
    return index(t).bm25([["the"]], papers=good).select("unit_id", "paper_id", F.round("rank", 6).alias("rank"))


@query(
    "fts04_index_refresh",
    f"""WITH {UNITS_SQL} SELECT term, count(*) AS n FROM (SELECT DISTINCT unit_id, unnest(w) AS term FROM tok WHERE unit_id % 10 <> 3) GROUP BY term HAVING count(*) > 5""",
)
def fts04(t):
    u = units(t)
    old = S.postings(u.filter("unit_id % 10 <> 7"))
    index = S.refresh(old, u.filter("unit_id % 10 IN (7, 8)"), u.filter("unit_id % 10 = 3"))
    return index.groupBy("term").agg(F.count("*").alias("n")).filter("n > 5")


RANK_SQL = f"""WITH {bm25_sql(['w[i] = ' + repr('license')])},
counted AS (SELECT paper_id, count(*) AS n FROM (SELECT * FROM ranked ORDER BY rank, unit_id LIMIT 200) GROUP BY 1),
p AS (SELECT doc_id AS paper_id, contains(lower(split_part(split_part(text, chr(10), 1), '.', 1)), 'license') AS in_title, contains(lower(text), 'license') AS in_body,
  lang, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic, coalesce(c.n, 0) AS n
  FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN counted c ON c.paper_id = doc_id),
s AS (SELECT paper_id, CASE WHEN in_title THEN 5 ELSE 0 END::BIGINT AS title_points, CASE WHEN in_body THEN 2 ELSE 0 END::BIGINT AS body_points,
  (4 * quality)::BIGINT AS preferred_points, (6 * quality)::BIGINT AS user_points, least(n, 3) AS unit_points, 10::BIGINT AS required_points FROM p WHERE lang = 'en' AND toxic = 0)
SELECT *, title_points + body_points + preferred_points + user_points + unit_points + required_points AS score FROM s ORDER BY score DESC, paper_id LIMIT 20"""


@query("fts06_rank", RANK_SQL)
def fts06(t):
    return S.search(index(t), papers(t), tags(t), QUERY, 20, preferred=[(None, "good")], excluded=[("label", "toxic")]).drop("paper_key", "title", "best_rank")


@query("fts07_search", f"SELECT paper_id, score FROM ({RANK_SQL.replace('LIMIT 20', 'LIMIT 10').replace('LIMIT 200', 'LIMIT 100')})")
def fts07(t):
    return S.search(index(t), papers(t), tags(t), QUERY, 10, preferred=[(None, "good")], excluded=[("label", "toxic")]).select("paper_id", "score")


TERM_SQL = f"""WITH {bm25_sql(['w[i] = ' + repr('license')])},
counted AS (SELECT paper_id, count(*) AS n, min(rank) AS best FROM (SELECT * FROM ranked ORDER BY rank, unit_id LIMIT 500) GROUP BY 1),
p AS (SELECT doc_id AS paper_id, 'doc' || lpad(doc_id::VARCHAR, 12, '0') AS paper_key, split_part(split_part(text, chr(10), 1), '.', 1) AS title, doc_id % 30 + 1990 AS year, contains(lower(text), 'license') AS in_body, coalesce(c.n, 0) AS n, best
  FROM documents LEFT JOIN counted c ON c.paper_id = doc_id WHERE contains(lower(text), 'license') OR c.n > 0),
s AS (SELECT *, contains(lower(title), 'license') AS in_title FROM p),
top AS (SELECT *, CASE WHEN in_title THEN 5 ELSE 0 END + CASE WHEN in_body THEN 2 ELSE 0 END + least(n, 3) AS score FROM s ORDER BY score DESC, best ASC NULLS LAST, paper_key LIMIT 50)"""


@query("fts11_explain", f"{TERM_SQL} SELECT paper_id, paper_key, score::BIGINT AS score, least(n, 3)::BIGINT AS unit_points FROM top WHERE paper_key = (SELECT min(paper_key) FROM top)")
def fts11(t):
    best = S.search(index(t), papers(t), tags(t), "license", 50, explain=True)
    first = best.agg(F.min("paper_key")).first()[0]
    return S.explain_match(index(t), papers(t), tags(t), "license", first or "").select("paper_id", "paper_key", "score", "unit_points")


@query(
    "fts13_projection",
    f"""{TERM_SQL} SELECT paper_id AS id, paper_key, title, year, '' AS authors_text, '' AS essence, '' AS abstract, '' AS doi, score::BIGINT AS score,
    to_json(map_from_entries(list_filter([('title', CASE WHEN in_title THEN 5 ELSE 0 END), ('body', CASE WHEN in_body THEN 2 ELSE 0 END), ('unit', least(n, 3)::INT)], lambda x: x[2] > 0)))::VARCHAR AS breakdown FROM top""",
)
def fts13(t):
    return S.projected(S.search(index(t), papers(t), tags(t), "license", 50, explain=True), papers(t))


@query(
    "fts09_tag_sets",
    "SELECT doc_id AS paper_id FROM documents WHERE lang = 'de' UNION SELECT doc_id FROM labels WHERE toxic = 1",
)
def fts09(t):
    return J.papers_of_tags(tags(t), ["de", "toxic"])


@query(
    "fts10_related",
    """WITH t AS (SELECT l_orderkey AS paper_id, p_brand AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
    own AS (SELECT DISTINCT name FROM t WHERE paper_id = 7) SELECT paper_id, 4 * count(DISTINCT name) AS score FROM t WHERE paper_id <> 7 AND name IN (SELECT name FROM own) GROUP BY 1 ORDER BY score DESC, paper_id LIMIT 25""",
)
def fts10(t):
    links = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("paper_id"), F.col("p_brand").alias("name"))
    return S.related(links, 7, 25)


def segments(t) -> Segments:
    """The documents' lines as an index that grew: first without every tenth line, then those and some again, while others went."""
    index, u = Segments(t.spark, storage.new_path(t.spark)), units(t)
    index.refresh(u.filter("unit_id % 10 <> 7"))
    index.refresh(u.filter("unit_id % 10 IN (7, 8)"), u.filter("unit_id % 10 = 3"))
    return index


def without_thirds(sql: str) -> str:
    return sql.replace("WHERE length(part[i]) >= 20", "WHERE length(part[i]) >= 20 AND (doc_id * 1000000 + i - 1) % 10 <> 3")


_BOTH = bm25_sql(["w[i] = " + repr("license"), "w[i] = " + repr("version")])


@query("fts04_segments", f"WITH {without_thirds(_BOTH)} {ROUNDED}")
def fts04_segments(t):
    return segments(t).bm25([["license"], ["version"]]).select("unit_id", "paper_id", F.round("rank", 6).alias("rank"))


@query("srt02_best_units", f"WITH {without_thirds(_BOTH)} {ROUNDED.replace('round(rank, 6) AS rank FROM ranked', 'round(rank, 6) AS rank FROM (SELECT * FROM ranked ORDER BY rank, unit_id LIMIT 25)')}")
def srt02_best(t):
    return segments(t).best(["license", "version"], 25)[0].select("unit_id", "paper_id", F.round("rank", 6).alias("rank"))


@query("fts05_index_build", f"WITH {UNITS_SQL} SELECT count(*) AS units, sum(len(w)) AS tokens, count(*) FILTER (len(w) = 0) AS bare FROM tok")
def fts05_build(t):
    """An index built anew, whatever is stored: what the searches don't show in their times."""
    built = S.Index.build(units(t), storage.new_path(t.spark))
    one = built.postings().groupBy("unit_id", "size").count().agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("tokens"))
    return built.figures().crossJoin(one).select(F.col("_n_units").alias("units"), "tokens", (F.col("_n_units") - F.col("n")).alias("bare"))
