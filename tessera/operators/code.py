"""Code-base analytics: symbols, calls, graphs, histories (TGF12-14, TGF18, GRF, JON24-25, SRC11-13)."""

from __future__ import annotations

import ast
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import storage
from tessera.operators import relational
from tessera.operators.cpp import cpp_constructs  # noqa: F401  one of the collectors here


def _symbols(code: str):
    """(kind, name, parent, line, end_line, detail) of a Python source; text that doesn't parse has none."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return
    stack = [(tree, "")]
    while stack:
        node, parent = stack.pop()
        for child in ast.iter_child_nodes(node):
            inner = parent
            if isinstance(child, ast.ClassDef):
                yield "class", child.name, parent, child.lineno, child.end_lineno, ",".join(map(ast.unparse, child.bases))
                inner = f"{parent}.{child.name}".strip(".")
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                yield "method" if isinstance(node, ast.ClassDef) else "function", child.name, parent, child.lineno, child.end_lineno, ast.unparse(child.args)
                inner = f"{parent}.{child.name}".strip(".")
            elif isinstance(child, ast.Import):
                for a in child.names:
                    yield "import", a.asname or a.name, parent, child.lineno, child.end_lineno, a.name
            elif isinstance(child, ast.ImportFrom):
                for a in child.names:
                    yield "import", a.asname or a.name, parent, child.lineno, child.end_lineno, f"{'.' * child.level}{child.module or ''}.{a.name}"
            stack.append((child, inner))


def python_symbols(files: DataFrame, path: str = "path", code: str = "code") -> DataFrame:
    """TGF12, TGF24, JON25: path, kind, name, parent, line, end_line, detail of the symbols and imports of Python files, which are spread over all tasks."""

    def parse(batches):
        for b in batches:
            rows = [(p, *s) for p, c in zip(b[path], b[code], strict=True) if c is not None for s in _symbols(c)]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "parent", "line", "end_line", "detail"])

    return storage.spread(files.select(path, code)).mapInPandas(parse, "path string, kind string, name string, parent string, line int, end_line int, detail string")


def cpp_headers(code: Column) -> Column:
    """STR20: array of (type, name, arguments) of function heads."""
    bare = F.regexp_replace(F.regexp_replace(code, r"/\*(?s:.*?)\*/", ""), r"//[^\n]*", "")
    head = r"(?m)^[ \t]*([A-Za-z_][\w:<>,*& ]*?)[ \t]+\*?([A-Za-z_~][\w:]*)\s*\(([^(){};]*)\)\s*(?:const\s*)?\{"
    parts = [F.regexp_extract_all(bare, F.lit(head), F.lit(i)) for i in (1, 2, 3)]
    found = F.arrays_zip(parts[0].alias("type"), parts[1].alias("name"), parts[2].alias("arguments"))
    return F.filter(found, lambda x: ~x["name"].isin("if", "for", "while", "switch", "return") & ~x["type"].isin("else", "return", "new"))


def includes(code: Column) -> Column:
    """STR20, GRF05: names in include lines with quotes; system headers are left out."""
    return F.regexp_extract_all(code, F.lit(r'(?m)^\s*#\s*include\s*"([^"]+)"'), F.lit(1))


def bases(code: Column) -> Column:
    """STR20: array of (class, list of bases)."""
    pattern = r"\b(?:class|struct)\s+(\w+)\s*:\s*([^{;]+)\{"
    found = F.arrays_zip(F.regexp_extract_all(code, F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all(code, F.lit(pattern), F.lit(2)).alias("bases"))
    return F.transform(found, lambda x: F.struct(x["name"].alias("name"), F.transform(F.split(x["bases"], ","), lambda b: F.trim(F.regexp_replace(b, r"\b(public|protected|private|virtual)\b", ""))).alias("bases")))


def symbols_by_language(files: DataFrame) -> DataFrame:
    """TGF13: path, kind, parent, name, detail of C++ and Python files, by their language. files: path, language, code."""
    cpp = cpp_constructs(files.filter(F.col("language").isin("cpp", "cpp_header", "c"))).select("path", "kind", "parent", "name", "detail")
    py = python_symbols(files.filter("language = 'python'")).select("path", "kind", "parent", "name", "detail")
    return cpp.unionByName(py)


def imports(files: DataFrame) -> DataFrame:
    """JON25, TGF24: path, local_name, target of each import; an imported item keeps its own name unless it is renamed."""
    return python_symbols(files).filter("kind = 'import'").select("path", F.col("name").alias("local_name"), F.col("detail").alias("target"))


def _bullets(constructs: str, kind: str, parent: Column | None = None) -> Column:
    chosen = F.filter(constructs, lambda x: (x["kind"] == kind) & (F.lit(True) if parent is None else x["parent"] == parent))
    return F.transform(F.array_distinct(F.transform(chosen, lambda x: x["name"])), lambda n: F.concat(F.lit("* `"), n, F.lit("`")))


def skeletons(constructs: DataFrame) -> DataFrame:
    """TGF21: path, page: a heading per class with its properties and methods, then the functions that belong to no class; names in order."""
    listed = constructs.groupBy("path").agg(F.sort_array(F.collect_set(F.struct("kind", "parent", "name"))).alias("s"))  # one file's constructs
    full = lambda x: F.when(x["parent"] == "", x["name"]).otherwise(F.concat_ws("::", x["parent"], x["name"]))
    of = lambda kind: F.array_distinct(F.transform(F.filter("s", lambda x: x["kind"] == kind), full))
    classes = F.transform(of("class"), lambda k: F.array_join(F.concat(F.array(F.concat(F.lit("### `"), F.regexp_extract(k, r"([^:]+)$", 1), F.lit("`"))), F.array(F.lit("##### Properties")), _bullets("s", "field", k), F.array(F.lit("##### Methods")), _bullets("s", "method", k)), "\n"))
    free = F.filter("s", lambda x: (x["kind"] == "function") & ((x["parent"] == "") | F.array_contains(of("namespace"), x["parent"])))
    free = F.transform(F.array_distinct(F.transform(free, lambda x: x["name"])), lambda n: F.concat(F.lit("* `"), n, F.lit("`")))
    part = lambda title, rows: F.when(F.size(rows) > 0, F.concat(F.array(F.lit(title)), rows)).otherwise(F.array().cast("array<string>"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return listed.select("path", F.array_join(F.concat(F.array(F.concat(F.lit("# `"), name, F.lit("`"))), part("# Classes", classes), part("# Free Functions", free)), "\n").alias("page"))


def documentation_pages(constructs: DataFrame) -> DataFrame:
    """TGF17: path, page: includes, classes with bases, and functions with their arguments, in order, with places for descriptions."""
    listed = constructs.groupBy("path").agg(F.sort_array(F.collect_set(F.struct("kind", "parent", "name", "detail"))).alias("s"))
    lines = lambda kind, f: F.transform(F.filter("s", lambda x: x["kind"] == kind), f)
    part = lambda title, rows: F.when(F.size(rows) > 0, F.concat(F.array(F.lit(title)), rows)).otherwise(F.array().cast("array<string>"))
    include = F.transform(F.filter("s", lambda x: (x["kind"] == "include") & (x["detail"] == "")), lambda x: F.concat(F.lit("- `"), x["name"], F.lit("`")))
    classes = lines("class", lambda x: F.concat(F.lit("- `"), x["name"], F.lit("`"), F.when(x["detail"] != "", F.concat(F.lit(" from `"), x["detail"], F.lit("`"))).otherwise("")))
    functions = lines("function", lambda x: F.concat(F.lit("- `"), F.when(x["parent"] != "", F.concat(x["parent"], F.lit("::"))).otherwise(""), x["name"], F.lit("("), x["detail"], F.lit(")`: [purpose]")))
    head = F.array(F.concat(F.lit("# "), "path"), F.lit("[purpose of the file]"))
    return listed.select("path", F.array_join(F.concat(head, part("## Includes", include), part("## Classes", classes), part("## Functions", functions)), "\n").alias("page"))


def commit_changes(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """SRC29: key, files (in order, with a comma between), diff of each commit."""
    names = F.sort_array(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^diff --git a/(\S+)"), F.lit(1))))
    return diffs.select(key, F.array_join(names, ",").alias("files"), F.col(text).alias("diff"))


def brace_depth(lines: DataFrame, group: str, order: str, line: str) -> DataFrame:
    """TGF14: depth of braces after each line, and the scope it stands in (lines since the last return to depth 0)."""
    delta = F.length(F.regexp_replace(line, r"[^{]", "")) - F.length(F.regexp_replace(line, r"[^}]", ""))
    w = Window.partitionBy(group).orderBy(order)
    deep = lines.withColumn("depth", F.sum(delta).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ended = F.when((F.lag("depth", 1, 0).over(w) > 0) & (F.col("depth") == 0), 1).otherwise(0)
    marked = deep.withColumn("_e", ended)
    return marked.withColumn("scope", F.coalesce(F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_e")


def closure(edges: DataFrame, start: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """GRF01, GRF05: node, depth of all nodes reachable from the start nodes, at the least depth.

    Rounds go on until one finds no new node; beyond most_rounds an error is raised, never a part of the closure returned. Each round joins only the nodes that are new, and is cut off from the rounds before by a table in the shared folder.
    """
    edges = edges.select("src", "dst").distinct()
    seen = new = storage.written(start.select(F.col("node")).distinct().withColumn("depth", F.lit(0)))
    for depth in count(1):
        new = storage.written(new.join(edges, new["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            return seen
        if depth == most_rounds:
            raise RuntimeError(f"new nodes are still found after {depth} rounds")
        seen = seen.unionByName(new)  # one table per round


def paths(edges: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """GRF02, GRF03: path (array of nodes) of each simple path from the roots with at most `most` edges; no node twice on a path."""
    found = level = roots.select(F.array("node").alias("path"))
    for _ in range(most):
        last = level.withColumn("src", F.element_at("path", -1))
        level = last.join(edges.select("src", "dst"), "src").filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        found = found.unionByName(level)
    return found


def attach(members: DataFrame, classes: DataFrame) -> DataFrame:
    """JON24: members (class, file, name) with the file of their class: the same file, else its header; else null."""
    c = classes.select("class", F.col("file").alias("class_file"))
    same = members.join(c, (members["class"] == c["class"]) & (members["file"] == c["class_file"]), "left").drop(c["class"]).withColumnRenamed("class_file", "own")
    h = c.withColumnRenamed("class_file", "head_file").withColumnRenamed("class", "head_class")
    header = F.regexp_replace("file", r"\.cpp$", ".h")
    both = same.join(h, (F.col("class") == F.col("head_class")) & (header == F.col("head_file")), "left")
    return both.select("class", "file", "name", F.coalesce("own", "head_file").alias("class_file"))


def file_history(commits: DataFrame, path: str, at: str) -> DataFrame:
    """SRC13: first and last date and number of commits of each file."""
    return commits.groupBy(path).agg(F.min(at).alias("added"), F.max(at).alias("changed"), F.count("*").alias("commits"))


def diff_files(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """TGF18: key, file, added, removed lines of each file in a diff."""
    parts = diffs.select(key, F.explode(F.slice(F.split(text, r"(?m)^diff --git "), 2, 1_000_000)).alias("part"))
    count = lambda sign: F.size(F.regexp_extract_all("part", F.lit(rf"(?m)^\{sign}(?!\{sign}\{sign})"), F.lit(0))).cast("long")
    return parts.select(key, F.regexp_extract("part", r"^a/(\S+)", 1).alias("file"), count("+").alias("added"), count("-").alias("removed"))


def undefined(used: Column, defined: Column, known: list[str]) -> Column:
    """SET04: symbols that are used but neither defined nor known."""
    return F.array_except(used, F.concat(defined, F.array(*map(F.lit, known))))


roots = relational.missing
