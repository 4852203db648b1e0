"""Readers, writers, parsers, hooks and small operators on the driver's tables; files are written to the shared folder and read back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera import storage
from tessera.api import PaperBase
from tessera.functions import algebra, hooks
from tessera.functions import text as X
from tessera.operators import code as C
from tessera.operators import composite, documents, parsing, relational
from tessera.operators import vectors as V
from tessera.plans import cpp_shapes
from tessera.registry import query
from tessera.sources import readers, sqlite, writers


def saved(t, rows, by: str | None = None) -> str:
    """The folder of text files with the rows' value; by: a file for each value of a column."""
    path = storage.new_path(t.spark)
    (rows.write if by is None else rows.write.partitionBy(by)).text(path)
    return path


def nation_files(t) -> str:
    return saved(t, t.nation.select(F.concat_ws("\n", F.concat(F.lit("# "), "n_name"), F.lit(""), F.concat(F.lit("Region "), "n_regionkey")).alias("value"), F.col("n_nationkey").alias("k")), "k")


def key():
    return F.regexp_extract("path", r"k=(\d+)", 1).cast("long")


NATION_TEXT = "'# ' || n_name || chr(10) || chr(10) || 'Region ' || n_regionkey || chr(10)"


@query("src01_folder_scan", f"SELECT n_nationkey::BIGINT AS k, length({NATION_TEXT})::BIGINT AS size, sha256({NATION_TEXT}) AS sha256 FROM nation")
def src01(t):
    return readers.with_hashes(readers.files(t.spark, nation_files(t), "*.txt")).select(key().alias("k"), "size", "sha256")


@query("src18_load_documents", f"SELECT n_nationkey::BIGINT AS k, {NATION_TEXT} AS text FROM nation")
def src18(t):
    return readers.files(t.spark, nation_files(t), "*.txt").select(key().alias("k"), F.decode("content", "utf-8").alias("text"))


PATHS_SQL = "(SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '/r/build/' WHEN 1 THEN '/r/src/' ELSE '/r/' END || 'f' || p_partkey || CASE p_partkey % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.hpp' WHEN 2 THEN '.PDF' WHEN 3 THEN '.cc' WHEN 4 THEN '.toml' WHEN 5 THEN '.pdf' ELSE '' END AS path FROM part)"


def paths(t):
    folder = F.element_at(F.array(F.lit("/r/build/"), F.lit("/r/src/"), F.lit("/r/")), (F.col("p_partkey") % 3 + 1).cast("int"))
    ending = F.element_at(F.array(*map(F.lit, (".py", ".hpp", ".PDF", ".cc", ".toml", ".pdf", ""))), (F.col("p_partkey") % 7 + 1).cast("int"))
    return t.part.select(F.concat(folder, F.lit("f"), "p_partkey", ending).alias("path"))


@query("src03_first_files", f"SELECT path FROM {PATHS_SQL} WHERE lower(path) LIKE '%.pdf' ORDER BY path LIMIT 40")
def src03(t):
    return readers.first_files(paths(t), 100, 40).select("path")


@query("src04_code_files", f"SELECT path, CASE p_partkey % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'cpp_header' ELSE 'cpp' END AS language FROM {PATHS_SQL} WHERE p_partkey % 7 IN (0, 1, 3) AND p_partkey % 3 <> 0")
def src04(t):
    return readers.with_language(paths(t)).select("path", "language")


@query("src05_numbered", f"SELECT row_number() OVER (ORDER BY path) AS place, path FROM {PATHS_SQL} WHERE path NOT LIKE '%/src/%'")
def src05(t):
    return readers.numbered(paths(t).filter(~readers.ignored(F.col("path"), ["*/src/*"])))


def run_folders(t) -> str:
    base = storage.new_path(t.spark)
    for run, part in (("2023", "n_nationkey < 15"), ("2024", "n_nationkey >= 10")):
        t.nation.filter(part).write.parquet(f"{base}/{run}/papers.parquet")
    return base


@query("src06_legacy_tables", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 15 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 10")
def src06(t):
    return readers.runs_in_order(t.spark, run_folders(t), "papers").select("n_nationkey", "n_name")


@query("src07_runs_in_order", "SELECT n_nationkey, '2023' AS first_run FROM nation WHERE n_nationkey < 15 UNION ALL SELECT n_nationkey, '2024' FROM nation WHERE n_nationkey >= 15")
def src07(t):
    path = F.regexp_extract(F.input_file_name(), r"/(20\d\d)/papers", 1)
    rows = t.spark.read.option("recursiveFileLookup", "true").parquet(run_folders(t)).withColumn("run", path)
    return rows.groupBy("n_nationkey").agg(F.min("run").alias("first_run"))


def ctags_line():
    return F.when(F.col("p_partkey") % 5 == 4, F.lit("{broken")).otherwise(F.format_string('{"_type": "tag", "name": "%s%d", "path": "f%d.cpp", "line": %d, "kind": "%s", "scope": "K%d", "scopeKind": "class"}', F.when(F.col("p_partkey") % 5 == 3, "__anon").otherwise("m"), "p_partkey", F.col("p_partkey") % 10, "p_partkey", F.when(F.col("p_partkey") % 2 == 0, "function").otherwise("member"), F.col("p_partkey") % 10))


@query("src10_ctags", "SELECT 'm' || p_partkey AS name, 'f' || p_partkey % 10 || '.cpp' AS path, p_partkey AS line FROM part WHERE p_partkey % 5 < 3")
def src10(t):
    return readers.ctags(t.spark, saved(t, t.part.select(ctags_line().alias("value")))).select("name", "path", "line")


@query(
    "src11_members_by_class",
    """SELECT 'K' || p_partkey % 10 AS class, coalesce(string_agg('m' || p_partkey, ',' ORDER BY 'm' || p_partkey) FILTER (p_partkey % 2 = 0), '') AS functions,
    coalesce(string_agg('m' || p_partkey, ',' ORDER BY 'm' || p_partkey) FILTER (p_partkey % 2 = 1), '') AS members FROM part WHERE p_partkey % 5 < 3 GROUP BY 1""",
)
def src11(t):
    return readers.members_by_class(readers.ctags(t.spark, saved(t, t.part.select(ctags_line().alias("value")))))


@query("src12_git_log", "SELECT 'h' || c_custkey AS hash, c_mktsegment AS author, '2024' AS date, c_name || '|more' AS message FROM customer")
def src12(t):
    return readers.git_log(t.spark, saved(t, t.customer.select(F.concat(F.lit("h"), "c_custkey", F.lit("|"), "c_mktsegment", F.lit("|2024|"), "c_name", F.lit("|more")).alias("value"))))


@query("src14_dat", "SELECT p_partkey::INT AS i0, CASE WHEN p_partkey % 4 = 0 THEN -1 ELSE p_size END AS i1, CASE WHEN p_partkey % 4 = 0 THEN 'nan'::DOUBLE ELSE p_retailprice END AS f0, CASE WHEN p_partkey % 4 > 0 THEN 'n' || p_partkey % 3 END AS name FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 3 <> 2")
def src14(t):
    line = F.when(F.col("p_partkey") % 4 == 0, F.col("p_partkey").cast("string")).otherwise(F.concat_ws("  ", "p_partkey", "p_size", "p_retailprice", F.concat(F.lit("n"), F.col("p_partkey") % 3)))
    return readers.dat(t.spark, saved(t, t.part.select(line.alias("value"))), 2, 1, ["n2"])


@query("src15_grid", "SELECT n_nationkey::BIGINT AS k, b AS block, r AS row, (n_nationkey * 100 + b * 10 + r)::DOUBLE AS first_value, 2 AS n FROM nation, (SELECT unnest(range(0, 2)) AS b), (SELECT unnest(range(0, 3)) AS r)")
def src15(t):
    block = lambda b: F.concat_ws("\n", *(F.concat_ws(" ", F.col("n_nationkey") * 100 + b * 10 + r, F.lit("0.5")) for r in range(3)))
    grid = readers.gnuplot_grid(t.spark, saved(t, t.nation.select(F.concat(F.lit("# head\n"), block(0), F.lit("\n\n"), block(1)).alias("value"), F.col("n_nationkey").alias("k")), "k") + "/*")
    return grid.select(key().alias("k"), F.col("block").cast("long").alias("block"), F.col("row").cast("long").alias("row"), F.get("values", F.lit(0)).alias("first_value"), F.size("values").alias("n"))


@query("src16_xyz", "SELECT n_nationkey::BIGINT AS k, a AS atom, CASE a WHEN 0 THEN 'H' ELSE 'O' END AS symbol, n_nationkey + a::DOUBLE AS x FROM nation, (SELECT unnest(range(0, 2)) AS a)")
def src16(t):
    text = F.concat(F.lit("2\ncomment\nH "), "n_nationkey", F.lit(" 0 0\nO "), F.col("n_nationkey") + 1, F.lit(" 0 1"))
    found = readers.xyz(t.spark, saved(t, t.nation.select(text.alias("value"), F.col("n_nationkey").alias("k")), "k") + "/*")
    return found.select(key().alias("k"), F.col("atom").cast("long").alias("atom"), "symbol", "x")


@query("src21_source_kind", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'path' WHEN 1 THEN 'doi' WHEN 2 THEN 'arxiv' ELSE 'url' END AS kind FROM customer")
def src21(t):
    text = F.element_at(F.array(F.concat(F.lit("/a/"), "c_custkey", F.lit(".PDF")), F.concat(F.lit("https://doi.org/10.1234/"), "c_custkey"), F.concat(F.lit("arXiv:2101.0"), "c_custkey"), F.concat(F.lit("https://x.org/"), "c_custkey", F.lit(".pdf"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return t.customer.select("c_custkey", X.source_kind(text).alias("kind"))


def bib(t):
    book = F.concat(F.lit("@inproceedings{b"), "p_partkey", F.lit(", title={Second}, booktitle={Proc}}\n"))
    first = F.concat(F.lit("@article{k"), "p_partkey", F.lit(", title={"), "p_name", F.lit("}, author={A B and C D}, "), F.when(F.col("p_partkey") % 2 == 0, "journal={J}, ").otherwise("booktitle={P}, "), F.lit("year=2001}\n"))
    return readers.bibtex(t.part.select(F.concat(F.lit("f"), "p_partkey").alias("path"), F.concat(first, book).alias("text")))


@query("src26_entry_texts", "SELECT 'f' || p_partkey AS path, 'k' || p_partkey || chr(10) || 'title: ' || p_name || chr(10) || 'authors: A B; C D' || chr(10) || 'year: 2001' || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'journal: J' ELSE '' END AS text FROM part")
def src26(t):
    return readers.entry_texts(bib(t), 1).select("path", "text")


@query("src27_first_entry", "SELECT 'f' || p_partkey AS path, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'J' ELSE 'P' END AS journal FROM part")
def src27(t):
    return readers.first_entries(bib(t)).select("path", "title", "journal")


@query("src25_extraction", "SELECT c_custkey, 1 AS ordinal, 'text' AS label, c_mktsegment AS path, c_name AS text FROM customer UNION ALL SELECT c_custkey, 0, 'section_header', c_mktsegment, c_mktsegment FROM customer")
def src25(t):
    json = F.to_json(F.struct(F.array(F.struct(F.lit("section_header").alias("label"), F.lit(1).alias("level"), F.col("c_mktsegment").alias("text")), F.struct(F.lit("text").alias("label"), F.lit(1).alias("level"), F.col("c_name").alias("text"))).alias("texts")))
    return composite.parser_sections(t.customer.select("c_custkey", json.alias("json")), "c_custkey").select("c_custkey", "ordinal", "label", "path", "text")


@query("src29_commit_changes", "SELECT c_custkey, 'a.py,b' || c_custkey || '.py' AS files, length('diff --git a/b' || c_custkey || '.py b/x' || chr(10) || '+x' || chr(10) || 'diff --git a/a.py b/a.py' || chr(10))::INT AS n FROM customer")
def src29(t):
    diff = F.concat(F.lit("diff --git a/b"), "c_custkey", F.lit(".py b/x\n+x\ndiff --git a/a.py b/a.py\n"))
    return C.commit_changes(t.customer.select("c_custkey", diff.alias("d")), "c_custkey", "d").select("c_custkey", "files", F.length("diff").alias("n"))


@query("src31_page_text", "SELECT page_id, 'see ' || page_id || ' and ' AS text FROM pages")
def src31(t):
    return t.pages.select("page_id", readers.page_text(F.concat(F.lit("see ["), "page_id", F.lit("](http://a/b) and "), "url")).alias("text"))


@query(
    "src22_import",
    """SELECT 'k' || c_custkey AS entry_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey WHEN c_custkey % 5 = 0 THEN c_custkey END AS paper_id, NOT (c_custkey % 3 = 0 OR c_custkey % 5 = 0) AS was_new,
    CASE WHEN c_custkey % 2 = 0 THEN '/lib/' || c_custkey || '.pdf' END AS path FROM customer""",
)
def src22(t):
    k = F.col("c_custkey")
    entries = t.customer.select(F.concat(F.lit("k"), k).alias("entry_id"), F.concat(F.lit("10.1/"), k).alias("doi"), F.when(k % 4 == 0, F.concat(F.lit("/lib/"), k, F.lit(".pdf"))).otherwise(F.concat(F.lit("C:\\old\\"), k, F.lit(".pdf"))).alias("file"))
    papers = t.customer.filter(k % 3 == 0).select(k.alias("id"), F.lit("other").alias("paper_key"), F.concat(F.lit("10.1/"), k).alias("doi"))
    papers = papers.unionByName(t.customer.filter((k % 5 == 0) & (k % 3 != 0)).select(k.alias("id"), F.concat(F.lit("k"), k).alias("paper_key"), F.lit(None).cast("string").alias("doi")))
    files = t.customer.filter(k % 2 == 0).select(F.concat(F.lit("/lib/"), k, F.lit(".pdf")).alias("path"))
    return readers.import_entries(entries, papers, files)


@query("snk01_non_empty", "SELECT n_nationkey, n_name AS text FROM nation")
def snk01(t):
    return t.spark.read.parquet(_written_path(t, writers.non_empty(t.nation.select("n_nationkey", F.col("n_name").alias("text")), "text")))


def _written_path(t, rows) -> str:
    path = storage.new_path(t.spark)
    rows.write.parquet(path)
    return path


@query("snk04_table", "SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS name FROM customer")
def snk04(t):
    path = storage.new_path(t.spark)
    writers.write_table(t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("name")), path)
    return t.spark.read.option("sep", "\t").option("header", True).csv(path)


@query("snk09_vectors", "SELECT vec_id AS chunk_id, len(embedding) AS n FROM embeddings")
def snk09(t):
    path = storage.new_path(t.spark)
    chunks = t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("text"), "embedding")
    writers.write_vectors(chunks.unionByName(chunks), path)
    return t.spark.read.parquet(path).select("chunk_id", F.size("embedding").cast("long").alias("n"))


@query("dml03_set_bibtex", "SELECT c_custkey AS id, c_name AS paper_key, CASE WHEN c_custkey % 2 = 0 THEN '/bib/' || c_name || '.bib' END AS bibtex_path FROM customer")
def dml03(t):
    papers = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("paper_key"), F.lit(None).cast("string").alias("bibtex_path"))
    entries = t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit("@article{x}").alias("bibtex"))
    return relational.set_bibtex(papers, entries, "/bib")


@query("dml06_append", "SELECT n_nationkey AS id, n_name AS content, NULL::VARCHAR AS section_path FROM nation UNION ALL SELECT r_regionkey, r_name, 'r' FROM region")
def dml06(t):
    have = t.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("content"), F.lit("r").alias("section_path"))
    return relational.append(have, t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("content")))


@query(
    "dml08_supersede",
    """SELECT id, lag(id) OVER w AS superseded, lead(id) OVER w IS NULL AS is_active FROM (SELECT event_id AS id, user_id, user_id % 3 AS operation FROM events WHERE event_type = 'purchase') WINDOW w AS (PARTITION BY user_id, operation ORDER BY id)""",
)
def dml08(t):
    return relational.supersede(t.runs).select("id", F.col("supersedes_run_id").alias("superseded"), "is_active")


@query("dml17_link_equations", "SELECT DISTINCT l_orderkey AS method_id, l_partkey AS equation_id FROM lineitem")
def dml17(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("method_id"), F.col("l_partkey").alias("equation_id"))
    half = rows.filter("method_id % 2 = 0").distinct()
    return relational.insert_ignore(half, rows, ["method_id", "equation_id"])


@query(
    "dml18_stage_summary",
    """SELECT event_id AS id, user_id AS paper_id, coalesce(event_id = max(event_id) FILTER (event_type <> 'error') OVER (PARTITION BY user_id), false) AS is_active FROM events""",
)
def dml18(t):
    runs = t.events.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"))
    summaries = t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("paper_id"), F.col("event_id").alias("run_id"))
    return relational.staged_summaries(summaries, runs)


@query("dml23_manual_tags", "SELECT DISTINCT doc_id AS paper_id, lang AS name, 'lang' AS category FROM documents WHERE lang <> 'de' UNION SELECT doc_id, 'to read', 'manual' FROM labels")
def dml23(t):
    links = t.documents.select(F.col("doc_id").alias("paper_id"), F.col("lang").alias("name"), F.lit("lang").alias("category"))
    wanted = t.labels.select(F.col("doc_id").alias("paper_id"), F.lit("  To Read ").alias("name"))
    return relational.without_tag(relational.with_manual_tags(links, wanted), "DE ")


@query("fil21_tag_reference", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'domain' WHEN 1 THEN 'a' END AS category, CASE c_custkey % 3 WHEN 0 THEN 'spin waves' WHEN 1 THEN 'b:c' ELSE 'x_y' END AS name FROM customer")
def fil21(t):
    text = F.element_at(F.array(F.lit(" domain:spin_waves "), F.lit("a : b:c"), F.lit("x_y")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return t.customer.select("c_custkey", X.tag_reference(text).alias("r")).select("c_custkey", "r.category", "r.name")


@query("jon01_orders_of_customers", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def jon01(t):
    return relational.matched(t.orders, t.customer, "o_custkey", "c_custkey").select("o_orderkey", "c_name")


@query("jon09_division", "SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2")
def jon09(t):
    links = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return relational.with_all_tags(t.orders.select("o_orderkey"), links, "l_returnflag", ["A", "N"], "o_orderkey")


@query("jon19_type_lookup", "SELECT p_partkey, 'f.h::N' || p_partkey || '::T' || p_partkey AS target FROM part")
def jon19(t):
    k = F.col("p_partkey")
    types = t.part.select(F.concat(F.lit("f.h::N"), k, F.lit("::T"), k).alias("name"))
    asked = F.when(k % 3 == 0, F.concat(F.lit("T"), k)).when(k % 3 == 1, F.concat(F.lit("N"), k, F.lit("::T"), k)).otherwise(F.concat(F.lit("f.h::N"), k, F.lit("::T"), k))
    return parsing.by_suffix(t.part.select("p_partkey", asked.alias("call")), types).select("p_partkey", "target")


def python_code():
    return F.concat(F.lit("import os as o\nimport sys\nfrom a.b import c as d, e\nclass K"), "p_partkey", F.lit("(Base):\n    def m(self, x=1):\n        return x\ndef f():\n    pass\n"))


def python_files(t):
    return t.part.select(F.concat(F.lit("p"), "p_partkey", F.lit(".py")).alias("path"), F.lit("python").alias("language"), python_code().alias("code"))


@query("jon25_imports", "SELECT 'p' || p_partkey || '.py' AS path, x[1] AS local_name, x[2] AS target FROM part, (SELECT unnest([['o', 'os'], ['sys', 'sys'], ['d', 'a.b.c'], ['e', 'a.b.e']]) AS x)")
def jon25(t):
    return C.imports(python_files(t))


@query("tgf24_python_constructs", "SELECT 'p' || p_partkey || '.py' AS path, x[1] AS kind, replace(x[2], '#', p_partkey::VARCHAR) AS name, replace(x[3], '#', p_partkey::VARCHAR) AS parent, x[4] AS detail FROM part, (SELECT unnest([['class', 'K#', '', 'Base'], ['method', 'm', 'K#', 'self, x=1'], ['function', 'f', '', '']]) AS x)")
def tgf24(t):
    return C.python_symbols(python_files(t)).filter("kind <> 'import'").select("path", "kind", "name", "parent", "detail")


def cpp_code():
    return F.concat(F.lit('#include "a.h"\n#include <vector>\nnamespace ns {\nclass K'), "p_partkey", F.lit(" : public Base {\n  int x;\n  double* y = 0;\n  void run(int a);\n};\n}\nint K::get(int b) {\n  return helper(b);\n}\n"))

def cpp_files(t):
    return t.part.select(F.concat(F.lit("src/c"), "p_partkey", F.lit(".cpp")).alias("path"), F.lit("cpp").alias("language"), cpp_code().alias("code"))


@query("tgf23_cpp_constructs", cpp_shapes.CONSTRUCTS_SQL)
def tgf23(t):
    return C.cpp_constructs(cpp_shapes.files(t.part))


@query("tgf13_symbols", f"SELECT kind, count(*) AS n FROM (SELECT x[1] AS kind FROM {cpp_shapes.ROWS_SQL} UNION ALL SELECT unnest(['class', 'method', 'function', 'import', 'import', 'import', 'import']) FROM part) GROUP BY 1")
def tgf13(t):
    return C.symbols_by_language(cpp_shapes.files(t.part).unionByName(python_files(t))).groupBy("kind").agg(F.count("*").alias("n"))


@query("grf03_cpp_scopes", f"SELECT scope, count(*) AS members FROM (SELECT replace(x[2], '@', p_partkey::VARCHAR) AS scope FROM {cpp_shapes.ROWS_SQL} WHERE x[1] IN ('class', 'field', 'method', 'function')) WHERE scope <> '' GROUP BY 1")
def grf03_scopes(t):
    found = C.cpp_constructs(cpp_shapes.files(t.part)).filter(F.col("kind").isin("class", "field", "method", "function") & (F.col("parent") != ""))
    return found.groupBy(F.col("parent").alias("scope")).agg(F.count("*").alias("members"))


@query("tgf17_pages", "SELECT 'src/c' || p_partkey || '.cpp' AS path, array_to_string(['# src/c' || p_partkey || '.cpp', '[purpose of the file]', '## Includes', '- `a.h`', '## Classes', '- `K' || p_partkey || '` from `public Base`', '## Functions', '- `K::get(int b)`: [purpose]'], chr(10)) AS page FROM part")
def tgf17(t):
    return C.documentation_pages(C.cpp_constructs(cpp_files(t)))


@query("tgf21_skeletons", "SELECT 'src/c' || p_partkey || '.cpp' AS path, array_to_string(['# `c' || p_partkey || '.cpp`', '# Classes', '### `K' || p_partkey || '`', '##### Properties', '* `x`', '* `y`', '##### Methods', '* `run`'], chr(10)) AS page FROM part")
def tgf21(t):
    return C.skeletons(C.cpp_constructs(cpp_files(t)))


@query("tgf03_unit_types", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'summary' WHEN c_custkey % 3 = 0 THEN 'method' ELSE 'section' END AS unit_type FROM customer")
def tgf03(t):
    path = F.when(F.col("c_custkey") % 3 == 0, "2 Our Methods").otherwise("1 Results")
    return t.customer.select("c_custkey", documents.unit_type(path, F.col("c_custkey") % 2 == 0).alias("unit_type"))


ASSERTED = "(SELECT l_orderkey AS paper_id, l_suppkey AS tag_id, l_returnflag AS source, l_linenumber AS run_id, l_discount AS confidence, l_linestatus AS raw_name FROM lineitem)"


@query("agg05_visible_links", f"SELECT paper_id, tag_id, source, max(run_id) AS run_id, max(confidence) AS confidence, max(raw_name) AS raw_name FROM {ASSERTED} WHERE run_id <= 5 GROUP BY ALL")
def agg05(t):
    rows = t.lineitem.selectExpr("l_orderkey AS paper_id", "l_suppkey AS tag_id", "l_returnflag AS source", "l_linenumber AS run_id", "l_discount AS confidence", "l_linestatus AS raw_name")
    runs = t.spark.range(1, 8).select(F.col("id").cast("int").alias("id"), F.when(F.col("id") <= 5, "ok").otherwise("failed").alias("status"))
    return relational.visible_links(rows, runs)


POINTS = "(SELECT s_suppkey AS id, (s_suppkey % 10)::DOUBLE AS x, (s_suppkey // 10 % 10)::DOUBLE AS y, (s_suppkey // 100)::DOUBLE AS z, s_acctbal / 1000 AS q FROM supplier)"


def points(t):
    return t.supplier.selectExpr("s_suppkey AS id", "cast(s_suppkey % 10 AS double) AS x", "cast(s_suppkey div 10 % 10 AS double) AS y", "cast(s_suppkey div 100 AS double) AS z", "s_acctbal / 1000 AS q")


@query("agg15_pair_sums", f"WITH p AS {POINTS} SELECT a.id, round(sum(b.q / sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2)), 6) AS energy FROM p a JOIN p b ON a.id <> b.id GROUP BY 1")
def agg15(t):
    kernel = lambda dx, dy, dz, s: {"energy": s["q"] / np.sqrt(dx * dx + dy * dy + dz * dz)}
    return V.block_sums(points(t), points(t), kernel, ["energy"]).select("id", F.round("energy", 6).alias("energy"))


@query("udf04_pair_function", f"WITH p AS {POINTS} SELECT a.id, round(sum(greatest(0, 2 - abs(b.x - a.x))), 6) AS near, count(*) AS n FROM p a JOIN p b ON a.id <> b.id GROUP BY 1")
def udf04(t):
    return V.pairwise_sums(points(t), points(t), lambda dx, dy, dz: {"near": F.greatest(F.lit(0.0), 2 - F.abs(dx)), "n": F.lit(1)}, axes="x").select("id", F.round("near", 6).alias("near"), "n")


@query("srt01_best_first", "SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, quality ASC NULLS LAST, doc_id) AS place FROM documents LEFT JOIN labels USING (doc_id) QUALIFY place <= 100")
def srt01(t):
    rows = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return relational.placed(rows, [F.desc("n_chars"), F.asc_nulls_last("quality"), F.asc("doc_id")], 100).select("doc_id", "place")


@query("srt03_listing", "SELECT p_partkey, row_number() OVER (ORDER BY p_size % 7 DESC, p_name, p_partkey) AS place FROM part QUALIFY place <= 200")
def srt03(t):
    return relational.placed(t.part, [F.desc(F.col("p_size") % 7), F.asc("p_name"), F.asc("p_partkey")], 200).select("p_partkey", "place")


@query("str05_fuzzy_score")
def str05(t):
    from tessera.operators import identity

    return t.part.select("p_partkey", identity.match_score(F.col("p_name"), F.col("p_type"), F.lower("p_brand"), F.col("p_brand"), F.col("p_size"), F.col("p_size") + F.col("p_partkey") % 2).alias("score"))


@query("str17_file_metadata", "SELECT p_partkey, 'Smith' AS authors, CASE WHEN p_partkey % 2 = 0 THEN 2004 END AS year, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'Smith_2004' ELSE 'Smith' END ELSE 'Spin waves' END AS title FROM part")
def str17(t):
    stem = F.concat(F.lit("Smith"), F.when(F.col("p_partkey") % 2 == 0, "_2004").otherwise(""), F.when(F.col("p_partkey") % 3 == 0, "").otherwise("_Spin-waves"))
    return t.part.select("p_partkey", X.file_metadata(stem).alias("m")).select("p_partkey", "m.*")


@query("jsn03_axis", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'a; b' WHEN 1 THEN 'O(n)' WHEN 2 THEN 'own' ELSE 'N/A' END AS value FROM customer")
def jsn03(t):
    k = F.col("c_custkey") % 4
    card = F.when(k == 0, '{"complexity": ["a", "b"]}').when(k == 1, '{"complexity": "O(n)"}').otherwise("{}")
    return t.customer.select("c_custkey", X.axis_value(card, "Complexity", F.when(k == 2, "own")).alias("value"))


@query("fts01_query_terms", "SELECT item_id, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: regexp_matches(w, '[\\p{L}\\p{N}]'))) AS n FROM benchmark")
def fts01(t):
    return t.benchmark.select("item_id", F.size(X.query_terms(F.col("text"))).cast("long").alias("n"))


@query("mth03_polynomials", "SELECT p_partkey, round((p_size + 2 * 3 * 0.5 + 3 * p_size * 0.25)::DOUBLE, 6) AS slope, round((2 * 1 + p_size / 2.0 * 1 + 1 + p_size / 4.0)::DOUBLE, 6) AS area FROM part")
def mth03(t):
    n = F.col("p_size").cast("double")
    p = F.array(F.lit(2.0), n, F.lit(3.0), n)
    return t.part.select("p_partkey", F.round(algebra.value(algebra.derivative(p), F.lit(0.5)), 6).alias("slope"), F.round(algebra.integral(p, F.lit(0.0), F.lit(1.0)), 6).alias("area"))


@query("mth06_cutoff", "SELECT p_partkey, round(-1 * (1 + 2 * u) * (1 - u) ** 2 + 0.5 * 2 * u * (1 - u) ** 2, 6) AS v FROM (SELECT p_partkey, p_size % 11 / 10.0 AS u FROM part)")
def mth06(t):
    a, b, c, d = composite.cutoff_fit(3.0, -1.0, 0.5, 5.0)
    r = 3 + 2 * (F.col("p_size") % 11) / 10
    return t.part.select("p_partkey", F.round(algebra.value(F.array(*map(F.lit, (d, c, b, a))), r), 6).alias("v"))


@query("mth09_algebra", "SELECT p_partkey, gcd(gcd(p_partkey * 6, p_size * 4), 10) AS factor, round(p_size / 4.0, 6)::DOUBLE AS shift, round(7 - p_size * p_size / 8.0, 6)::DOUBLE AS rest, 3 AS terms FROM part")
def mth09(t):
    n = F.col("p_size").cast("double")
    square = algebra.completed_square(F.lit(2.0), n, F.lit(7.0))
    factor = algebra.common_factor(F.array(F.col("p_partkey") * 6, F.col("p_size").cast("long") * 4, F.lit(10).cast("long")))
    return t.part.select("p_partkey", factor.alias("factor"), F.round(square["shift"], 6).alias("shift"), F.round(square["rest"], 6).alias("rest"), algebra.term_count(F.concat(F.lit("2*x^2 + "), "p_size", F.lit("*x - 7"))).alias("terms"))


@query(
    "mth09_costs",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS terms, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 18 WHEN 2 THEN 66 ELSE 5 END AS cost,
    gcd(6 * p_size, 10) AS factor, 1 + p_partkey % 3 AS power FROM part""",
)
def mth09_costs(t):
    k = F.col("p_partkey")
    shapes = F.array(F.lit("s+1"), F.lit("x^2 - 3*x + 1e-5"), F.lit("-sin(x^-2)/2"), F.concat(k.cast("string"), F.lit(" * a - b")))
    text = F.get(shapes, (k % 4).cast("int"))
    p = F.concat(F.array_repeat(F.lit(0).cast("long"), (1 + k % 3).cast("int")), F.array(F.lit(10).cast("long"), 6 * F.col("p_size").cast("long")))
    found = algebra.prefactor(p)
    return t.part.select("p_partkey", algebra.term_count(text).alias("terms"), algebra.operation_cost(text).alias("cost"), found["factor"].alias("factor"), found["power"].alias("power"))


@query("mth10_potentials", "SELECT p_partkey, round(abs((pow(3 / r, 12) - 2 * pow(3 / r, 6)) - (exp(-2 * 1.5 * (r - 3)) - 2 * exp(-1.5 * (r - 3)))), 6) AS difference FROM (SELECT p_partkey, 2.5 + p_size / 10.0 AS r FROM part)")
def mth10(t):
    return V.potential_differences(t.part.select("p_partkey", (2.5 + F.col("p_size") / 10).alias("r")), "r", 3.0, 1.0, 1.5).select("p_partkey", F.round("difference", 6).alias("difference"))


@query("udf01_tool", "SELECT n_nationkey, (n_nationkey * 2)::BIGINT AS twice FROM nation")
def udf01(t):
    def twice(x: int) -> int:
        """Two times a number."""
        return 2 * x

    hooks.register_tool(t.spark, twice)
    return t.nation.selectExpr("n_nationkey", "twice(cast(n_nationkey AS bigint)) AS twice")


@query("udf03_per_row", "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 3)::VARCHAR END AS result, c_custkey % 3 = 0 AS failed FROM customer")
def udf03(t):
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, (F.col("c_custkey") % 3).cast("string")).otherwise("x").alias("v"))
    return hooks.per_row(rows, "v", lambda s: str(int(s))).select("c_custkey", "result", F.col("error").isNotNull().alias("failed"))


@query("udf05_parser", "SELECT n_nationkey::BIGINT AS k, json_object('headings', [n_name])::VARCHAR AS structured_json FROM nation")
def udf05(t):
    found = readers.files(t.spark, nation_files(t), "*.txt").select("path", F.decode("content", "utf-8").alias("text"))
    return hooks.parse(found).select(key().alias("k"), "structured_json")


@query("udf06_tool_calls", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN (c_custkey * 2)::VARCHAR WHEN 1 THEN 'Error: Function other is not available.' END AS content FROM customer")
def udf06(t):
    k = F.col("c_custkey")
    reply = F.when(k % 3 == 0, F.concat(F.lit('{"tool": "twice", "arguments": {"x": '), k, F.lit("}}"))).when(k % 3 == 1, '{"tool": "other", "arguments": {}}').otherwise("just text")
    return hooks.run_tools(t.customer.select("c_custkey", reply.alias("reply")), "reply", {"twice": lambda a: F.get_json_object(a, "$.x").try_cast("long") * 2}).select("c_custkey", "content")


@query("cfg01_template", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'b' WHEN c_custkey % 3 = 1 THEN 'c' ELSE 'a' END AS template FROM customer")
def cfg01(t):
    k = F.col("c_custkey") % 3
    return t.customer.select("c_custkey", hooks.template(F.when(k == 0, "b"), F.when(k <= 1, "c"), ["a", "b", "c"]).alias("template"))


def base(t) -> PaperBase:
    return PaperBase(t.spark, storage.new_path(t.spark))


@query("fil23_facade", "SELECT 'paper' AS what, n_name AS value FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'doi', n_name FROM nation WHERE n_nationkey = 4 UNION ALL SELECT 'file', '/f/' || n_nationkey || '.pdf' FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'bibtex', '@article{NATION_' || n_nationkey || ',' FROM nation")
def fil23(t):
    b = base(t)
    b.upsert_papers(t.nation.select(F.concat(F.lit("NATION_"), "n_nationkey").alias("paper_key"), F.col("n_name").alias("title"), F.concat(F.lit("10.1/"), "n_nationkey").alias("doi")))
    ids = b.list_papers(1000).select(F.col("id").alias("paper_id"), "paper_key")
    b.add_files(ids.select(F.col("paper_id").alias("id"), "paper_id", F.concat(F.lit("/f/"), F.substring_index("paper_key", "_", -1), F.lit(".pdf")).alias("path")))
    third = b.get_paper("NATION_3")
    out = third.select(F.lit("paper").alias("what"), F.col("title").alias("value")).unionAll(b.get_paper("10.1/4").select(F.lit("doi"), "title"))
    out = out.unionAll(b.get_files(third.first().id).select(F.lit("file"), "path"))
    return out.unionAll(b.get_bibtex().select(F.lit("bibtex"), F.substring_index("bibtex", "\n", 1)))


@query("cmp14_ingest", "SELECT n_name AS title, 'existing_path' AS again FROM nation")
def cmp14(t):
    b, folder = base(t), nation_files(t)
    b.ingest_folder(folder, "*.txt")
    again = b.ingest_folder(folder, "*.txt").select(key().alias("k"), F.col("outcome").alias("again"))
    titles = b.list_papers(1000).select(F.regexp_extract("markdown_path", r"k=(\d+)", 1).cast("long").alias("k"), "title")
    return titles.join(again, "k", "full_outer").select("title", "again")


@query("cmp16_migrations", "SELECT 'N' || n_nationkey AS entry_id, false AS was_new, CASE WHEN n_nationkey % 2 = 0 THEN '/lib/' || n_nationkey || '.pdf' END AS path FROM nation")
def cmp16(t):
    b = base(t)
    texts = t.nation.select(F.col("n_name").alias("path"), F.concat(F.lit("@article{N-"), "n_nationkey", F.lit(", title={T"), "n_nationkey", F.lit("}, year=2001, file={/old/"), "n_nationkey", F.lit(".pdf}}")).alias("text"))
    files = t.nation.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("/lib/"), "n_nationkey", F.lit(".pdf")).alias("path"))
    b.import_bibtex(texts, files)
    return b.import_bibtex(texts, files).select("entry_id", "was_new", "path")


@query("txn01_transaction", "SELECT 'tags' AS name, count(*) AS n FROM region UNION ALL SELECT 'topics', count(*) FROM region UNION ALL SELECT 'papers', 0")
def txn01(t):
    tables = base(t).tables
    tables.init()
    with tables.transaction(), tables.transaction():
        tables.append("tags", t.region.select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("canonical_name"), F.lit("region").alias("category")))
        tables.append("topics", t.region.select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name")))
    try:
        with tables.transaction():
            tables.append("tags", t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("canonical_name")))
            tables.append("papers", t.nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("paper_key")))
            raise InterruptedError("the caller gives up")
    except InterruptedError:
        pass
    counts = [tables.read(n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("tags", "topics", "papers")]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


@query("dml06_blind_appends", "SELECT n_regionkey AS part, count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT 99, count(*) FROM nation")
def dml06_blind(t):
    """A commit per region; each writes its own rows. Rows as of each commit, and in the end."""
    tables = base(t).tables
    before = tables.version("tags")
    for r in range(5):
        tables.append("tags", t.nation.filter(F.col("n_regionkey") == r).select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("canonical_name"), F.lit(f"{r}").alias("category")))
    out = tables.read("tags").agg(F.lit(99).alias("part"), F.count("*").alias("n"))
    for r in range(5):
        step = tables.read("tags", before + r + 1).join(tables.read("tags", before + r).select("id"), "id", "left_anti") if before + r else tables.read("tags", 1)
        out = out.unionAll(step.agg(F.lit(r).alias("part"), F.count("*").alias("n")))
    return out


@query("txn01_conflict", "SELECT 'first' AS writer, count(*) AS n FROM region UNION ALL SELECT 'second, refused', 0 UNION ALL SELECT 'second, after reading again', count(*) FROM nation")
def txn01_conflict(t):
    """Two writers that replace what both have read; the later one is refused, and goes on from what it reads then."""
    from tessera.catalog import Catalog
    from tessera.commits import Conflict

    first = base(t).tables
    second = Catalog(t.spark, first.root)
    rows = {"first": t.region.select(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("canonical_name"), F.lit("first").alias("category")), "second": t.nation.select((100 + F.col("n_nationkey")).cast("long").alias("id"), F.col("n_name").alias("canonical_name"), F.lit("second").alias("category"))}
    mine = second.read("tags")
    first.write("tags", first.read("tags").unionByName(rows["first"]))
    try:
        second.write("tags", mine.unionByName(rows["second"]))
        refused = False
    except Conflict:
        refused = True
    lost = second.read("tags").filter("category = 'second'").agg(F.lit("second, refused" if refused else "second").alias("writer"), F.count("*").alias("n"))
    second.write("tags", second.read("tags").unionByName(rows["second"]))
    now = first.read("tags")
    count = lambda name, kind: now.filter(F.col("category") == kind).agg(F.lit(name).alias("writer"), F.count("*").alias("n"))
    return count("first", "first").unionAll(lost).unionAll(count("second, after reading again", "second"))


@query("src06_sqlite", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey > 20 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def src06_sqlite(t):
    folder = storage.new_path(t.spark)
    sqlite.write_sqlite(t.customer.select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment").repartition(4, "c_custkey"), folder, "papers")
    return sqlite.sqlite_table(t.spark, f"{folder}/*/papers.db", "papers", rows=500).filter("c_custkey > 20 AND c_mktsegment IN ('BUILDING', 'MACHINERY')").drop("run")
