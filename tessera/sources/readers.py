"""Readers (SRC): every one gives a DataFrame and reads through Spark, so paths may lie in any store."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import decode_latex, normalize_doi, safe_filename
from tessera.storage import written

#: Languages by file extension.
LANGUAGES = {
    "py": "python", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "cpp_header", "hpp": "cpp_header", "c": "c", "js": "javascript", "ts": "typescript", "jl": "julia", "f90": "fortran", "f": "fortran", "cl": "opencl", "cu": "cuda", "md": "markdown", "toml": "toml", "json": "json", "sh": "shell",
}
#: What a scan takes for code, and the paths it leaves out.
CODE = ("py", "cpp", "cc", "cxx", "h", "hpp", "c", "js", "ts", "jl", "f90", "cl", "cu")
IGNORED = ("*/__pycache__/*", "*/.git/*", "*/node_modules/*", "*/.venv/*", "*/venvs/*", "*/.shadow/*", "*/build/*", "*.pyc", "*.so", "*.o", "*/.aider*", "*/Build-*/*")


def files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """SRC01, SRC03, SRC18: path, modified, size, content of the files that match a pattern."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def ignored(path: Column, patterns=IGNORED) -> Column:
    """SRC05: whether a path matches one of the patterns, in which * stands for anything and ? for a character."""
    like = "|".join("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in p) for p in patterns)
    return path.rlike(f"(?s)^(?:{like})$") if patterns else F.lit(False)


def with_language(found: DataFrame, extensions=CODE, ignore=IGNORED, languages: dict[str, str] = LANGUAGES) -> DataFrame:
    """SRC04: the rows of paths with a wanted extension that no pattern ignores, with their language (else unknown)."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    names = F.create_map(*(F.lit(x) for kv in languages.items() for x in kv))
    return found.filter(extension.isin(*extensions) & ~ignored(F.col("path"), ignore)).withColumn("language", F.coalesce(F.try_element_at(names, extension), F.lit("unknown")))


def code_files(spark: SparkSession, folder: str, ignore=IGNORED, languages: dict[str, str] = LANGUAGES) -> DataFrame:
    """SRC04: path, language, code of source files."""
    return with_language(files(spark, folder), ignore=ignore, languages=languages).select("path", "language", F.decode("content", "utf-8").alias("code"))


def numbered(found: DataFrame) -> DataFrame:
    """SRC05: place (from 1), path of files in the order of their paths. Paths are sorted by ranges; only the ranges' sizes meet in one task."""
    ranged = found.select("path").repartitionByRange("path").sortWithinPartitions("path").select("path", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i"))
    ranged = written(ranged)
    before = ranged.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_b", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))
    return ranged.join(before, "_p").select((F.col("_b") + F.col("_i") + 1).alias("place"), "path")


def first_files(found: DataFrame, most: int, limit: int | None = None) -> DataFrame:
    """SRC03: of at most `most` PDF files by path (whatever the case of their ending) the first `limit`."""
    return found.filter(F.lower("path").endswith(".pdf")).orderBy("path").limit(most if limit is None else min(most, limit))


def with_hashes(found: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """HSH01, HSH03: path, size, modified, sha256; contents are hashed only where path, size and time aren't in the cache."""
    fresh = found if cache is None else found.join(cache.select("path", "size", "modified"), ["path", "size", "modified"], "left_anti")
    hashed = fresh.select("path", "size", "modified", F.sha2("content", 256).alias("sha256"))
    if cache is None:
        return hashed
    return cache.join(found.select("path", "size", "modified"), ["path", "size", "modified"], "left_semi").select(hashed.columns).unionByName(hashed)


def runs_in_order(spark: SparkSession, base: str, table: str) -> DataFrame:
    """SRC06, SRC07: a table exported once per run folder, with run_name taken from the path."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(base).withColumn("_p", F.input_file_name()).filter(F.col("_p").contains(f"/{table}")).withColumn("run_name", F.regexp_extract("_p", r"/([^/]+)/[^/]*[^/]$", 1)).drop("_p")


def _entries(text: str):
    """(type, id, fields) of BibTeX entries; values in braces or quotes, or bare."""
    at = 0
    while (m := re.compile(r"@(\w+)\s*\{\s*([^,\s]+)\s*,").search(text, at)) is not None:
        at, fields = m.end(), {}
        while (f := re.compile(r"\s*([A-Za-z-]+)\s*=\s*").match(text, at)) is not None:
            start = i = f.end()
            if text[i : i + 1] == "{":
                depth = 0
                while i < len(text):
                    depth += (text[i] == "{") - (text[i] == "}")
                    i += 1
                    if not depth:
                        break
                value = text[start + 1 : i - 1]
            elif text[i : i + 1] == '"':
                i = text.find('"', i + 1)
                i = len(text) if i < 0 else i + 1
                value = text[start + 1 : i - 1]
            else:
                i = re.compile(r"[^,}\n]*").match(text, i).end()
                value = text[start:i].strip()
            fields[f[1].lower()] = value
            at = re.compile(r"\s*,?").match(text, i).end()
        if m[1].lower() not in ("comment", "string", "preamble"):
            yield m[1].lower(), m[2], fields


BIB = "path string, ordinal int, entry_id string, entry_type string, title string, authors string, year string, doi string, journal string, keywords string, abstract string, file string, booktitle string"


def bibtex(texts: DataFrame) -> DataFrame:
    """SRC08: entries of BibTeX texts (path, text): accents decoded, DOI normalized, year an integer or null, authors joined by '; '."""
    names = ("title", "author", "year", "doi", "journal", "keywords", "abstract", "file", "booktitle")

    def parse(batches):
        for b in batches:
            rows = [(p, i, key, kind, *(fields.get(n) for n in names)) for p, t in zip(b["path"], b["text"], strict=True) if t for i, (kind, key, fields) in enumerate(_entries(t))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BIB.split(", ")])

    raw = texts.select("path", "text").mapInPandas(parse, BIB)
    plain = lambda c: F.trim(F.regexp_replace(decode_latex(F.col(c)), r"\s+", " "))
    out = raw.withColumn("title", F.regexp_replace(plain("title"), "[{}]", "")).withColumn("authors", F.regexp_replace(plain("authors"), r"\s+and\s+", "; "))
    return out.withColumn("year", F.trim("year").try_cast("int")).withColumn("doi", normalize_doi(F.col("doi")))


def first_entries(entries: DataFrame) -> DataFrame:
    """SRC27: of each text the fields of its first entry; a missing journal is the title of the book."""
    one = entries.filter("ordinal = 0")
    return one.select("path", "entry_id", "title", "authors", "year", "doi", F.coalesce(F.nullif("journal", F.lit("")), "booktitle").alias("journal"))


def entry_texts(entries: DataFrame, most: int | None = None) -> DataFrame:
    """SRC26: path, ordinal, text of the entries, up to `most` of each text."""
    out = entries if most is None else entries.filter(F.col("ordinal") < most)
    fields = ("title", "authors", "year", "doi", "journal")
    return out.select("path", "ordinal", F.concat_ws("\n", "entry_id", *(F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in fields)).alias("text"))


def bibtex_lookup(entries: DataFrame) -> DataFrame:
    """SRC09: key, entry_id: entries by the stem of their file and by the start of their title; the last entry of a key wins."""
    stem = F.regexp_extract("file", r"([^/:\\]+)\.pdf", 1)
    keyed = entries.select("entry_id", "ordinal", F.explode(F.array(stem, safe_filename(F.lower("title"), 80))).alias("key")).filter("key <> ''")
    return keyed.groupBy("key").agg(F.max_by("entry_id", "ordinal").alias("entry_id"))


CTAGS = "_type string, name string, path string, line long, kind string, scope string, scopeKind string, signature string, typeref string, access string, `end` long"


def ctags(spark: SparkSession, path: str) -> DataFrame:
    """SRC10: tags of a ctags JSON-lines file, without anonymous ones and lines that don't parse."""
    return spark.read.schema(CTAGS).option("mode", "DROPMALFORMED").json(path).filter((F.col("_type") == "tag") & ~F.col("name").startswith("__anon")).drop("_type")


def members_by_class(tags: DataFrame) -> DataFrame:
    """SRC11: each class with its functions and members in name order."""
    named = lambda kinds: F.array_join(F.sort_array(F.collect_set(F.when(F.col("kind").isin(*kinds), F.col("name")))), ",")
    return tags.filter(F.col("scopeKind").isin("class", "struct")).groupBy(F.col("scope").alias("class")).agg(named(("function", "method", "prototype")).alias("functions"), named(("member", "field", "variable")).alias("members"))


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """SRC12: hash, author, date, message of lines with bars between them; a message may hold bars."""
    parts = F.split("value", r"\|", 4)
    return spark.read.text(path).filter(F.size(parts) == 4).select(*(parts[i].alias(c) for i, c in enumerate(("hash", "author", "date", "message"))))


def dat(spark: SparkSession, path: str, ints: int, floats: int, remove: list[str] = ()) -> DataFrame:
    """SRC14: rows of white-space separated integers, numbers and a name; what a short row lacks is -1, NaN or null."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "").filter(~F.col("value").startswith("#"))
    columns = [F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(-1)).alias(f"i{i}") for i in range(ints)]
    columns += [F.coalesce(F.get(parts, F.lit(ints + i)).try_cast("double"), F.lit(float("nan"))).alias(f"f{i}") for i in range(floats)]
    out = rows.select(*columns, F.get(parts, F.lit(ints + floats)).alias("name"))
    return out.filter(F.col("name").isNull() | ~F.col("name").isin(*remove)) if remove else out


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, line: each file is split as one text, so line numbers need no shuffle."""
    whole = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def gnuplot_grid(spark: SparkSession, path: str) -> DataFrame:
    """SRC15: path, block, row, values: rows of numbers in blocks between blank lines."""
    w = Window.partitionBy("path").orderBy("line_no")
    rows = _numbered(spark, path).filter(~F.col("line").startswith("#")).withColumn("_b", (F.trim("line") == "").cast("int"))
    blocks = rows.withColumn("block", F.sum("_b").over(w)).filter("_b = 0")
    return blocks.select("path", "block", (F.row_number().over(Window.partitionBy("path", "block").orderBy("line_no")) - 1).alias("row"), F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.try_cast("double")).alias("values"))


def xyz(spark: SparkSession, path: str) -> DataFrame:
    """SRC16: path, atom, symbol, x, y, z of molecule files; the first two lines are a count and a comment."""
    parts = F.split(F.trim("line"), r"\s+")
    rows = _numbered(spark, path).filter((F.col("line_no") >= 2) & (F.size(parts) >= 4))
    return rows.select("path", (F.col("line_no") - 2).alias("atom"), parts[0].alias("symbol"), *(parts[i + 1].try_cast("double").alias(c) for i, c in enumerate("xyz")))


#: The elements by number, the last numbers of the periods, and the colours of some.
SYMBOLS = """H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe
Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og""".split()
PERIODS = (2, 10, 18, 36, 54, 86, 118)
COLORS = {"H": "#ffffff", "C": "#909090", "N": "#3050f8", "O": "#ff0d0d", "F": "#90e050", "P": "#ff8000", "S": "#ffff30", "Cl": "#1ff01f"}


def elements(spark: SparkSession) -> DataFrame:
    """SRC17: symbol, number, period, color of the chemical elements."""
    rows = [(s, n, 1 + sum(n > last for last in PERIODS), COLORS.get(s)) for n, s in enumerate(SYMBOLS, 1)]
    return spark.createDataFrame(rows, "symbol string, number int, period int, color string")


def crossref(column: Column) -> Column:
    """SRC20: the fields of a CrossRef answer; the year of print, online, issue or creation, whichever comes first."""
    date = "struct<`date-parts`:array<array<int>>>"
    schema = f"message struct<title:array<string>,DOI:string,`container-title`:array<string>,author:array<struct<given:string,family:string>>,`published-print`:{date},`published-online`:{date},issued:{date},created:{date}>"
    m = F.from_json(column, schema)["message"]
    year = F.coalesce(*(F.get(F.get(m[k]["date-parts"], F.lit(0)), F.lit(0)) for k in ("published-print", "published-online", "issued", "created")))
    authors = F.array_join(F.transform(m["author"], lambda a: F.concat_ws(", ", a["family"], a["given"])), "; ")
    return F.struct(F.get(m["title"], F.lit(0)).alias("title"), normalize_doi(m["DOI"]).alias("doi"), F.get(m["container-title"], F.lit(0)).alias("journal"), authors.alias("authors"), year.alias("year"))


def arxiv(column: Column) -> Column:
    """SRC20: the fields of an arXiv Atom answer."""
    one = lambda tag: F.trim(F.regexp_replace(F.regexp_extract(F.regexp_extract(column, r"(?s)<entry>(.*?)</entry>", 1), rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1), r"\s+", " "))
    names = F.regexp_extract_all(F.regexp_extract(column, r"(?s)<entry>(.*?)</entry>", 1), F.lit(r"(?s)<name>(.*?)</name>"), F.lit(1))
    return F.struct(one("title").alias("title"), one("summary").alias("abstract"), F.array_join(names, "; ").alias("authors"), F.substring(one("published"), 1, 4).try_cast("int").alias("year"), F.regexp_extract(one("id"), r"abs/(.+?)(?:v\d+)?$", 1).alias("arxiv_id"))


def page_text(text: Column) -> Column:
    """SRC31: what a PDF converter gave, without its link annotations ([text](target) keeps the text) and bare addresses."""
    return F.regexp_replace(F.regexp_replace(text, r"\[([^\]\n]*)\]\([^)\s]*\)", "$1"), r"<?https?://[^\s<>]+>?", "")


def import_entries(entries: DataFrame, papers: DataFrame, files: DataFrame) -> DataFrame:
    """SRC22: entry_id, paper_id (null: a new paper), was_new, path: entries of a reference manager with the paper they match, by DOI or
    else by key, and the file they name, by its path or else by its base name. papers: id, paper_key, doi; files: path."""
    base = lambda c: F.regexp_extract(c, r"([^/\\\\]+)$", 1)
    by_doi = papers.filter("doi IS NOT NULL").groupBy("doi").agg(F.min("id").alias("_a"))
    by_key = papers.groupBy(F.col("paper_key").alias("entry_id")).agg(F.min("id").alias("_b"))
    by_path = files.select(F.col("path").alias("file")).distinct().withColumn("_p", F.col("file"))
    by_base = files.groupBy(base("path").alias("_base")).agg(F.min("path").alias("_q"))
    out = entries.join(by_doi, "doi", "left").join(by_key, "entry_id", "left").join(by_path, "file", "left").withColumn("_base", base("file")).join(by_base, "_base", "left")
    found = F.coalesce("_a", "_b")
    return out.select("entry_id", found.alias("paper_id"), found.isNull().alias("was_new"), F.coalesce("_p", "_q").alias("path"))
