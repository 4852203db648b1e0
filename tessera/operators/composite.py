"""Composite jobs: migration of legacy runs, repository maps, the document pipeline, metadata refresh (CMP02, CMP07, CMP09, CMP11, CMP15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import hooks
from tessera.functions.text import first_rule, infer_backend, safe_filename
from tessera.operators import code, documents, relational, sequences

#: How good a converter's output is.
BACKENDS = {"docling_formulas": 5, "docling": 4, "vlm": 3, "pdfminer": 1}


def candidates(stems: DataFrame, files: DataFrame) -> DataFrame:
    """SRC23: stem, path of the files whose name holds the stem. Names are cut at their separators, so pairs meet on parts."""
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    parts = lambda c: F.explode(F.array_distinct(F.split(c, r"[^A-Za-z0-9]+")))
    f = files.select("path", name.alias("name"), parts(name).alias("part"))
    longest = F.array_max(F.transform(F.split("stem", r"[^A-Za-z0-9]+"), lambda p: F.struct(F.length(p), p.alias("p"))))["p"]
    return stems.select("stem", longest.alias("part")).join(f, "part").filter(F.col("name").contains(F.col("stem"))).select("stem", "path").distinct()


def repaired_path(path: Column, old: str, new: str, known: Column) -> Column:
    """STR15: the path under its new prefix, if that file is known."""
    moved = F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))
    return F.when(path.startswith(old) & F.array_contains(known, moved), moved).otherwise(path)


def owned_name(content: Column, path: Column) -> Column:
    """SRC24: the first 16 digits of the content's SHA-256 and the file's name."""
    return F.concat(F.substring(F.sha2(content, 256), 1, 16), F.lit("_"), F.regexp_extract(path, r"([^/]+)$", 1))


def migrate(legacy: DataFrame, tags: DataFrame, article_tags: DataFrame, rules: list[tuple[str, str]], done: DataFrame | None = None) -> dict[str, DataFrame]:
    """CMP07, WIN01-04, AGG18: papers, tags and runs from all runs of legacy tables.

    legacy: stem, run_name, md_path, doi, title, year (text), essence; tags: run_name, id, name, category; article_tags:
    run_name, article_id, tag_id. The last run with a value wins, the best backend's text is taken, a summary of a run named
    pipeline_new is preferred, tag names follow the rules. Stems that are done are left out, so a second run adds nothing.
    """
    rows = legacy if done is None else legacy.join(done.select("stem"), "stem", "left_anti")
    backend = infer_backend(F.concat_ws("/", "run_name", "md_path"))
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in BACKENDS.items() for x in kv)), backend), F.lit(0))
    newest = {c: F.max_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("run_name"))).alias(c) for c in ("doi", "title", "year")}
    essence = F.max_by("essence", F.when(F.col("essence").isNotNull(), F.struct(F.col("run_name").contains("pipeline_new").cast("int"), "run_name"))).alias("essence")
    papers = rows.groupBy("stem").agg(F.max_by("md_path", F.when(F.col("md_path").isNotNull(), F.struct(rank, "run_name"))).alias("md_path"), *newest.values(), essence)
    papers = papers.withColumn("year", F.trim("year").try_cast("int")).withColumn("paper_key", safe_filename(F.col("stem"), 120))
    named = article_tags.join(tags, (article_tags["tag_id"] == tags["id"]) & (article_tags["run_name"] == tags["run_name"])).select(F.col("article_id").alias("stem"), first_rule(F.lower(F.trim("name")), rules).alias("name"), F.coalesce("category", F.lit("uncategorized")).alias("category"))
    links = named.join(papers.select("stem"), "stem", "left_semi").distinct()
    runs = rows.select("stem", F.lit("convert").alias("operation"), backend.alias("backend"), "run_name", F.lit("ok").alias("status"))
    return {"papers": papers, "links": links, "runs": runs}


def repository_map(files: DataFrame) -> dict[str, DataFrame]:
    """CMP11: symbols (the last of a name in a file), edges, folders and languages of Python files (path, language, code)."""
    found = code.python_symbols(files.select("path", "code"))
    own = found.filter("kind <> 'import'")
    symbols = own.groupBy("path", F.concat_ws("::", "path", "name").alias("key")).agg(F.max_by(F.struct("kind", "name", "parent", "line"), "line").alias("s")).select("path", "key", "s.*")
    edges = found.filter("kind = 'import'").select(F.col("path").alias("src"), F.col("detail").alias("dst")).distinct()
    folder = F.coalesce(F.nullif(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))
    placed = files.withColumn("folder", folder)
    n = symbols.groupBy("path").agg(F.count("*").alias("symbols"))
    stats = placed.join(n, "path", "left").groupBy("folder").agg(F.count("*").alias("files"), F.sum(F.size(F.split("code", "\n"))).alias("lines"), F.sum(F.coalesce("symbols", F.lit(0))).alias("symbols"), F.sort_array(F.collect_set("language")).alias("languages"))
    return {"symbols": symbols, "edges": edges, "folders": stats}


def document_pipeline(pages: DataFrame) -> dict[str, DataFrame]:
    """CMP15: chunks, equations, summaries, concepts and vectors of Markdown texts (id, text)."""
    return {
        "chunks": documents.heading_chunks(pages, "id"),
        "equations": documents.equations(pages, "id"),
        "summaries": hooks.per_row(pages.select("id", "text"), "text", hooks.summarize, "summary").select("id", "summary"),
        "concepts": documents.keywords(pages, "id"),
        "vectors": pages.select("id", hooks.embed(F.col("text")).alias("embedding")),
    }


def refreshed(papers: DataFrame, found: DataFrame, key: str = "doi") -> DataFrame:
    """CMP09, SRC27: papers whose missing fields are taken from records; a journal may be a record's book title."""
    record = found.withColumn("journal", F.coalesce("journal", "booktitle")) if "booktitle" in found.columns else found
    return relational.upsert(record.select(*(F.col(c) if c in record.columns else F.lit(None).cast(t).alias(c) for c, t in papers.dtypes)), papers, key).join(papers.select(key), key, "left_semi").select(papers.columns)


def paper_sections(blocks: DataFrame, budget: int) -> DataFrame:
    """CMP02: paper_id, section: the blocks (paper_id, turn, text) of each paper that fit into a budget of characters, in order;
    papers without any are dropped."""
    taken = sequences.fill_budget(blocks, "paper_id", "turn", F.length("text") + 1, budget)
    kept = blocks.join(taken, ["paper_id", "turn"], "left_semi")
    listed = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return kept.groupBy("paper_id").agg(listed.alias("s")).select("paper_id", F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("section"))


def parser_sections(rows: DataFrame, key: str, json: str = "json") -> DataFrame:
    """TGF09, SRC25: key, ordinal, label, path, text of a parser's texts; a heading's path holds all its ancestors.

    The stack of headings is an array that is cut to the level above and grows by the heading; it is folded over the items.
    """
    items = F.from_json(json, "texts array<struct<label:string,level:int,text:string>>")["texts"]
    start = F.expr("named_struct('path', cast(array() AS array<string>), 'out', cast(array() AS array<struct<label:string,path:string,text:string>>))")

    def step(a, x):
        heading = x["label"] == "section_header"
        level = F.coalesce(x["level"], F.lit(1))
        path = F.when(heading, F.concat(F.slice(a["path"], F.lit(1), F.greatest(level - 1, F.lit(0))), F.array(x["text"]))).otherwise(a["path"])
        return F.struct(path.alias("path"), F.concat(a["out"], F.array(F.struct(x["label"].alias("label"), F.array_join(path, " > ").alias("path"), x["text"].alias("text")))).alias("out"))

    folded = F.aggregate(F.coalesce(items, F.expr("cast(array() AS array<struct<label:string,level:int,text:string>>)")), start, step, lambda a: a["out"])
    return rows.select(key, F.posexplode(folded).alias("ordinal", "x")).select(key, "ordinal", "x.*")


def vector_sum(a: Column, b: Column) -> Column:
    """MTH07: a + b, element by element."""
    return F.zip_with(a, b, lambda x, y: x + y)


def cross(a: Column, b: Column) -> Column:
    """MTH07: the cross product of two arrays of three numbers."""
    return F.array(*(a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)))


def power_steps(n: int, name: str = "x") -> list[tuple[str, str]]:
    """MTH08: assignments that give x^n by repeated squaring, for n of 1 or more."""
    steps, squares, at, parts = [], name, 1, []
    while at <= n:
        if at > 1:
            steps.append((f"{name}{at}", f"{squares} * {squares}"))
            squares = f"{name}{at}"
        if n & at:
            parts.append(squares)
        at *= 2
    return [*steps, (f"{name}_to_{n}", " * ".join(parts))]


def cutoff_fit(r: float, value: float, slope: float, cut: float) -> list[float]:
    """MTH06: the cubic that has a value and slope at r, and neither at the cut-off; coefficients from the highest power."""
    import numpy as np

    rows = [[r**3, r**2, r, 1], [3 * r**2, 2 * r, 1, 0], [cut**3, cut**2, cut, 1], [3 * cut**2, 2 * cut, 1, 0]]
    return np.linalg.solve(rows, [value, slope, 0, 0]).tolist()


def ctags_lines(rows: DataFrame, line: str = "value") -> DataFrame:
    """SRC28: name, path, pattern, kind of tab-separated tags; comment lines are left out."""
    parts = F.split(line, "\t")
    return rows.filter(~F.col(line).startswith("!") & (F.size(parts) >= 4)).select(parts[0].alias("name"), parts[1].alias("path"), parts[2].alias("pattern"), parts[3].alias("kind"))


def implementations(files: DataFrame) -> DataFrame:
    """SRC30: each header with the source file of the same stem, or null."""
    stem = F.regexp_extract("path", r"^(.*)\.[^.]+$", 1)
    heads = files.filter(F.col("path").rlike(r"\.(h|hpp)$")).select(F.col("path").alias("header"), stem.alias("stem"))
    sources = files.filter(F.col("path").rlike(r"\.(c|cc|cpp)$")).groupBy(stem.alias("stem")).agg(F.min("path").alias("implementation"))
    return heads.join(sources, "stem", "left").select("header", "implementation")
