"""Further document and code parsers (TGF08-11, TGF17, TGF20-25, JON17, JON19, JON20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import equation_number, normalize_latex
from tessera.operators import sequences


def equations_in_context(rows: DataFrame, key: str, text: str = "text", least: int = 3, context: int = 200) -> DataFrame:
    """TGF08: key, line_no, latex, number, heading, before, after: equations on lines of their own, longer than `least`."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    headed = sequences.carried(lines, key, "line_no", F.nullif(F.regexp_extract("line", r"^#{1,6}\s+(.*)$", 1), F.lit("")), "heading")
    near = sequences.neighbours(headed, key, "line_no", "line", context)
    found = near.withColumn("raw", F.regexp_extract("line", r"^\s*\$\$(.+?)\$\$\s*(?:\(\d+(?:\.\d+)*\))?\s*$", 1)).filter(F.length(F.trim("raw")) > least)
    return found.select(key, "line_no", normalize_latex(F.col("raw")).alias("latex"), F.coalesce(equation_number(F.col("line")), equation_number(F.col("raw"))).alias("number"), "heading", "before", "after")


def algorithms(rows: DataFrame, key: str, text: str = "text", most_lines: int = 100) -> DataFrame:
    """TGF10: key, name, steps, confidence: blocks under an 'Algorithm' head with at least one numbered step, up to the next
    head or a blank line after steps, at most `most_lines` lines."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    head = F.nullif(F.regexp_extract("line", r"(?i)^\s*(?:#{1,6}\s*|\**)?(Algorithm\s+\d*[:.]?\s*.*)$", 1), F.lit(""))
    w = Window.partitionBy(key).orderBy("line_no")
    other = F.when(F.col("line").rlike(r"^#{1,6}\s"), F.lit("")).otherwise(F.lit(None))
    marked = lines.withColumn("_h", F.coalesce(head, other)).withColumn("_at", F.when(F.col("_h").isNotNull(), F.col("line_no")))
    block = marked.withColumn("name", F.last("_h", True).over(w)).withColumn("_start", F.last("_at", True).over(w))
    steps = block.filter((F.col("name") != "") & (F.col("line_no") - F.col("_start") <= most_lines) & F.col("line").rlike(r"^\s*(?:\d+[.):]|[-*])\s+\S"))
    listed = F.sort_array(F.collect_list(F.struct("line_no", F.trim(F.regexp_replace("line", r"^\s*(?:\d+[.):]|[-*])\s+", "")).alias("step"))))
    return steps.groupBy(key, "_start", "name").agg(listed.alias("s")).select(key, F.trim("name").alias("name"), F.transform("s", lambda x: x["step"]).alias("steps"), F.lit(0.9).alias("confidence"))


def method_rows(source: DataFrame, reconstructed: DataFrame) -> DataFrame:
    """TGF20: both kinds of methods as card rows; a missing name is 'unnamed', a missing confidence 0.5."""
    own = source.select("paper_id", "name", F.lit("source_algorithm").alias("method_type"), F.col("confidence").cast("double").alias("confidence"), F.to_json(F.struct("steps")).alias("card_json"))
    other = reconstructed.select("paper_id", "name", F.lit("reconstructed").alias("method_type"), F.col("confidence").cast("double").alias("confidence"), "card_json")
    both = own.unionByName(other)
    return both.withColumn("name", F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit("unnamed"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))


def by_suffix(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """JON17, JON19: each call with its target: the whole name, else the least qualified name that ends in it, else itself."""
    ends = functions.select("name", F.posexplode(F.split("name", "::")).alias("i", "_"), F.split("name", "::").alias("parts")).select("name", F.array_join(F.slice("parts", F.col("i") + 1, F.size("parts")), "::").alias("call"), "i")
    best = calls.select("call").distinct().join(ends, "call").groupBy("call").agg(F.min_by("name", F.struct("i", "name")).alias("target"))
    return calls.join(best, "call", "left").withColumn("target", F.coalesce("target", "call"))


def resolve_includes(edges: DataFrame, files: DataFrame, folders: tuple[str, ...] = ("include", "src", "common", "libs")) -> DataFrame:
    """JON20: (path, include) with the file it means: in its own folder, at the root, then in the usual folders; else null."""
    own = F.concat(F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), F.col("include"))
    tried = edges.select("path", "include", F.posexplode(F.array(own, F.col("include"), *(F.concat(F.lit(f"{d}/"), "include") for d in folders))).alias("turn", "file"))
    best = tried.join(files.select(F.col("path").alias("file")).distinct(), "file", "left_semi").groupBy("path", "include").agg(F.min_by("file", "turn").alias("file"))
    return edges.join(best, ["path", "include"], "left")


def kernel_headers(code: Column) -> Column:
    """TGF25: array of (name, arguments) of OpenCL kernels."""
    pattern = r"__kernel\s+void\s+(\w+)\s*\(([^)]*)\)"
    found = F.arrays_zip(F.regexp_extract_all(code, F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all(code, F.lit(pattern), F.lit(2)).alias("arguments"))
    return F.transform(found, lambda x: F.struct(x["name"].alias("name"), F.transform(F.split(x["arguments"], ","), lambda a: F.regexp_extract(a, r"(\w+)\s*$", 1)).alias("arguments")))


def within_folder_graph(symbols: DataFrame) -> DataFrame:
    """GRF05: (caller, callee) edges from arrays of called names to known functions."""
    return symbols.select(F.col("name").alias("caller"), F.explode("calls").alias("callee")).join(symbols.select(F.col("name").alias("callee")).distinct(), "callee", "left_semi").select("caller", "callee").distinct()


def function_context(lines: DataFrame, spans: DataFrame, group: str, order: str, text: str, most: int) -> DataFrame:
    """TGF22: per span the whole file if it has at most `most` characters, else the lines of the span."""
    size = lines.groupBy(group).agg(F.sum(F.length(text) + 1).alias("_chars"))
    sized = spans.join(size, group)
    wide = sized.withColumn("first", F.when(F.col("_chars") <= most, F.lit(0)).otherwise(F.col("first"))).withColumn("last", F.when(F.col("_chars") <= most, F.lit(2**31 - 1)).otherwise(F.col("last")))
    whole = lines.join(wide.filter(F.col("_chars") <= most).select(group, "name"), group)
    part = sequences.within(lines, wide.filter(F.col("_chars") > most).select(group, "name", "first", "last"), group, order)
    both = whole.select(group, "name", order, text).unionByName(part.select(group, "name", order, text))
    return both.groupBy(group, "name").agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("s")).select(group, "name", F.array_join(F.transform("s", lambda x: x[text]), "\n").alias("context"))


def insert_lines(lines: DataFrame, added: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """CMP17: lines with new ones inserted before given line numbers, numbered anew."""
    both = lines.select(group, (F.col(order) * 2).alias("_o"), text).unionByName(added.select(group, (F.col(order) * 2 - 1).alias("_o"), text))
    return both.withColumn(order, F.row_number().over(Window.partitionBy(group).orderBy("_o")) - 1).drop("_o")
