"""Sinks and parsers on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.registry import query
from tessera.sources import readers, writers


@query("src08_bibtex", "SELECT 'k' || p_partkey AS entry_id, p_name AS title, p_partkey % 30 + 1990 AS year, '10.1/x' || p_partkey AS doi FROM part")
def src08(t):
    entry = writers.bibtex_entry(F.concat(F.lit("k"), "p_partkey"), title=F.col("p_name"), year=F.col("p_partkey") % 30 + 1990, doi=F.concat(F.lit("https://doi.org/10.1/X"), "p_partkey"), journal=F.lit(""))
    return readers.bibtex(t.part.select(F.col("p_name").alias("path"), entry.alias("text"))).select("entry_id", "title", F.col("year").cast("long").alias("year"), "doi")


@query("snk02_companions", "SELECT source AS paper_id, json_object('paper_id', source, 'tags', json_object('lang', list_sort(list(DISTINCT lang))))::VARCHAR AS json FROM documents GROUP BY 1")
def snk02(t):
    papers = t.documents.select(F.col("source").alias("paper_id")).distinct()
    tags = t.documents.select(F.col("source").alias("paper_id"), F.lit("lang").alias("category"), F.col("lang").alias("name"))
    return writers.companions(papers, tags)


@query("snk05_report", "SELECT 0 AS part, '# Documents' || chr(10) || chr(10) || '- files: ' || count(*) || chr(10) || '- characters: ' || sum(n_chars) AS text FROM documents UNION ALL SELECT 1, '| ' || doc_id || ' | ' || lang || ' | ' || n_chars || ' |' FROM documents")
def snk05(t):
    return writers.report(t.documents.select("doc_id", "lang", "n_chars"), "Documents", "doc_id", {"files": F.count("*"), "characters": F.sum("n_chars")})


@query(
    "snk06_vault",
    """WITH l AS (SELECT DISTINCT p_type AS category, p_brand AS name, p_name AS k FROM part), p AS (SELECT category, name, list_sort(list(k)) AS k FROM l GROUP BY ALL)
    SELECT name, '# ' || name || chr(10) || chr(10) || array_to_string(list_transform(k, lambda x: '- [[' || x || ']]'), chr(10)) AS page FROM p
    UNION ALL SELECT 'index', string_agg(category || ': [[' || name || ']] (' || len(k) || ')', chr(10) ORDER BY category, len(k) DESC, name) FROM p""",
)
def snk06(t):
    return writers.vault(t.part.select(F.col("p_type").alias("category"), F.col("p_brand").alias("name"), F.col("p_name").alias("paper_key")))


@query(
    "snk06_vault_by_category",
    """WITH l AS (SELECT DISTINCT p_type AS category, p_brand AS name, p_name AS k FROM part), p AS (SELECT category, name, list_sort(list(k)) AS k FROM l GROUP BY ALL)
    SELECT name, '# ' || name || chr(10) || chr(10) || array_to_string(list_transform(k, lambda x: '- [[' || x || ']]'), chr(10)) AS page FROM p
    UNION ALL SELECT 'index/' || category, string_agg('[[' || name || ']] (' || len(k) || ')', chr(10) ORDER BY len(k) DESC, name) FROM p GROUP BY category
    UNION ALL SELECT 'index', string_agg('[[index/' || category || ']] (' || n || ')', chr(10) ORDER BY category) FROM (SELECT category, count(*) AS n FROM p GROUP BY 1)""",
)
def snk06_by_category(t):
    return writers.vault_by_category(t.part.select(F.col("p_type").alias("category"), F.col("p_brand").alias("name"), F.col("p_name").alias("paper_key")))


@query("snk08_rename", "SELECT c_custkey, c_mktsegment || '_' || (c_custkey % 30 + 1990) || '_' || regexp_replace(c_name, '[^A-Za-z0-9.-]+', '_', 'g') AS name FROM customer")
def snk08(t):
    return t.customer.select("c_custkey", writers.rename_proposal(F.col("c_mktsegment"), F.col("c_custkey") % 30 + 1990, F.col("c_name")).alias("name"))


@query("snk10_bundle", """SELECT page_id, '---' || chr(10) || 'url: "' || url || '"' || chr(10) || '---' || chr(10) || chr(10) || '# Generated scientific summary' || chr(10) || chr(10) || 'none' || chr(10) || chr(10) || '# Extracted source text' || chr(10) || chr(10) || url AS text FROM pages""")
def snk10(t):
    return t.pages.select("page_id", writers.bundle({"url": F.col("url"), "doi": F.lit("")}, F.lit("none"), F.col("url")).alias("text"))


@query("src20_crossref", "SELECT c_custkey, c_name AS title, '10.1/' || c_custkey AS doi, (c_custkey % 20 + 2000)::BIGINT AS year FROM customer")
def src20(t):
    answer = F.format_string('{"message": {"title": ["%s"], "DOI": "10.1/%d", "issued": {"date-parts": [[%d, 1]]}, "created": {"date-parts": [[1990]]}}}', "c_name", "c_custkey", F.col("c_custkey") % 20 + 2000)
    return t.customer.select("c_custkey", readers.crossref(answer).alias("m")).select("c_custkey", "m.title", "m.doi", F.col("m.year").cast("long").alias("year"))


@query("src17_elements", "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 26 WHEN 2 THEN 79 WHEN 3 THEN 118 WHEN 4 THEN 57 END AS number, CASE c_custkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 7 WHEN 4 THEN 6 END AS period FROM customer")
def src17(t):
    symbol = F.element_at(F.array(*map(F.lit, ("H", "Fe", "Au", "Og", "La", "Zz"))), (F.col("c_custkey") % 6 + 1).cast("int"))
    return t.customer.withColumn("symbol", symbol).join(F.broadcast(readers.elements(t.spark)), "symbol", "left").select("c_custkey", "number", "period")  # 118 rows
