"""Code analytics on edges and lines derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import code as C
from tessera.operators import graphs
from tessera.operators import jobs as J
from tessera.registry import query

EDGES_SQL = "(SELECT DISTINCT s_suppkey AS src, (s_suppkey * 7 + 3) % 50 AS dst FROM supplier UNION SELECT DISTINCT s_suppkey, (s_suppkey * 3 + 1) % 90 FROM supplier)"


def edges(t):
    s = t.supplier.select(F.col("s_suppkey").alias("src"))
    return s.select("src", ((F.col("src") * 7 + 3) % 50).alias("dst")).union(s.select("src", ((F.col("src") * 3 + 1) % 90).alias("dst"))).distinct()


@query("grf01_closure", f"WITH RECURSIVE r AS (SELECT 5::BIGINT AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN {EDGES_SQL} e ON e.src = r.node WHERE r.depth < 40) SELECT node, min(depth) AS depth FROM r GROUP BY 1")
def grf01(t):
    return C.closure(edges(t), t.spark.range(5, 6).toDF("node"))


@query(
    "grf02_paths",
    f"""WITH RECURSIVE r AS (SELECT [1::BIGINT] AS p UNION ALL SELECT list_append(p, e.dst) FROM r JOIN {EDGES_SQL} e ON e.src = p[-1] WHERE len(p) < 5 AND NOT list_contains(p, e.dst)) SELECT array_to_string(p, '>') AS path FROM r""",
)
def grf02(t):
    found = C.paths(edges(t), t.spark.range(1, 2).toDF("node"), 4)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


_PARTS_SQL = f"""e AS (SELECT * FROM {EDGES_SQL}), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
p AS (SELECT n.node, least(n.node, coalesce(min(a.dst) FILTER (b.src IS NOT NULL), n.node)) AS component, coalesce(bool_or(a.dst = n.node), false) AS circular FROM n LEFT JOIN r a ON a.src = n.node LEFT JOIN r b ON b.src = a.dst AND b.dst = n.node GROUP BY n.node)"""


@query(
    "grf02_call_tree",
    f"""WITH RECURSIVE {_PARTS_SQL}, c AS (SELECT DISTINCT x.component AS a, y.component AS b FROM e JOIN p x ON x.node = e.src JOIN p y ON y.node = e.dst WHERE x.component <> y.component),
    l AS (SELECT DISTINCT component, 0 AS depth FROM p WHERE component NOT IN (SELECT b FROM c) UNION SELECT c.b, l.depth + 1 FROM l JOIN c ON c.a = l.component),
    d AS (SELECT component, min(depth) AS depth FROM l GROUP BY 1)
    SELECT p.node, p.component, p.circular, d.depth, (SELECT min(c.a) FROM c JOIN d up ON up.component = c.a WHERE c.b = p.component AND up.depth = d.depth - 1) AS parent FROM p JOIN d USING (component)""",
)
def grf02_tree(t):
    return graphs.call_tree(edges(t))


@query("grf03_scope_names", "SELECT n_nationkey, r_name || '::' || n_name AS full_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def grf03(t):
    regions = t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return J.scoped_names(t.nation, regions, "n_regionkey", "r_name", "n_name").select("n_nationkey", "full_name")


@query("grf04_bipartite_edges", "SELECT DISTINCT source AS src, lang AS dst FROM documents")
def grf04(t):
    return J.bipartite_edges(t.documents, "source", "lang")


@query("set04_undefined", "SELECT source, coalesce(array_to_string(list_sort(list(DISTINCT lang) FILTER (lang NOT IN ('en', 'fr'))), ','), '') AS missing FROM documents GROUP BY 1")
def set04(t):
    used = t.documents.groupBy("source").agg(F.collect_set("lang").alias("u"))
    return used.select("source", F.array_join(F.sort_array(C.undefined(F.col("u"), F.array(F.lit("fr")), ["en"])), ",").alias("missing"))


@query("src13_file_history", "SELECT user_id, min(ts) AS added, max(ts) AS changed, count(*) AS commits FROM events GROUP BY 1")
def src13(t):
    return C.file_history(t.events, "user_id", "ts")


@query(
    "tgf14_brace_depth",
    """WITH l AS (SELECT doc_id, part[i] AS line, i - 1 AS n FROM (SELECT doc_id, part, unnest(range(1, len(part) + 1)) AS i FROM (SELECT doc_id, string_split(replace(replace(text, '.', '{'), ',', '}'), chr(10)) AS part FROM documents)))
    SELECT doc_id, n, sum(length(regexp_replace(line, '[^{]', '', 'g')) - length(regexp_replace(line, '[^}]', '', 'g'))) OVER (PARTITION BY doc_id ORDER BY n)::BIGINT AS depth FROM l""",
)
def tgf14(t):
    code = t.documents.select("doc_id", F.posexplode(F.split(F.translate("text", ".,", "{}"), "\n")).alias("n", "line"))
    return C.brace_depth(code, "doc_id", "n", "line").select("doc_id", F.col("n").cast("long").alias("n"), F.col("depth").cast("long").alias("depth"))


@query("str21_calls", "SELECT doc_id, len(list_distinct(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*(?:(?:::|\\.)[A-Za-z_][A-Za-z0-9_]*)*)\\s*\\(', 1))) AS n FROM documents")
def str21(t):
    from tessera.functions.text import calls

    return t.documents.select("doc_id", F.size(calls(F.col("text"))).cast("long").alias("n"))


@query("str20_cpp_headers", "SELECT p_partkey, 'int' AS type, 'f' || p_partkey AS name, 'int a, double b' AS arguments FROM part")
def str20(t):
    code = F.concat(F.lit("int f"), "p_partkey", F.lit("(int a, double b) {\n  return a;\n}\nclass B"), "p_partkey", F.lit(" : public A, private C {\n};\n"))
    return t.part.select("p_partkey", F.explode(C.cpp_headers(code)).alias("h")).select("p_partkey", "h.*")


@query("tgf12_python_symbols", "SELECT p_name AS path, x[1] AS kind, replace(x[2], '#', p_partkey::VARCHAR) AS name, replace(x[3], '#', p_partkey::VARCHAR) AS parent, x[4]::INT AS line, x[5]::INT AS end_line, x[6] AS detail FROM part, (SELECT unnest([['import', 'o', '', '1', '1', 'os'], ['class', 'K#', '', '2', '4', ''], ['method', 'm', 'K#', '3', '4', 'self, x=1']]) AS x)")
def tgf12(t):
    code = F.concat(F.lit("import os as o\nclass K"), "p_partkey", F.lit(":\n    def m(self, x=1):\n        return x\n"))
    return C.python_symbols(t.part.select(F.col("p_name").alias("path"), code.alias("code")))
