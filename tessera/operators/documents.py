"""Documents to rows: units, chunks, equations, concepts, code blocks (TGF)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_PARAGRAPH = 20


def paragraphs(rows: DataFrame, key: str, text: str = "text", mark: str = r"\n\s*\n", least: int = LEAST_PARAGRAPH) -> DataFrame:
    """TGF02: key, ordinal, content: parts between blank lines, stripped, of at least `least` characters."""
    parts = F.transform(F.split(text, mark), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return rows.select(key, F.posexplode(F.filter(parts, lambda p: F.length(p) >= least)).alias("ordinal", "content"))


def heading_chunks(rows: DataFrame, key: str, text: str = "text", longer: int = 50) -> DataFrame:
    """TGF05: key, ordinal, content: parts that start at a heading of level 1 to 3, of more than `longer` characters."""
    return rows.select(key, F.posexplode(F.filter(F.split(text, r"\n(?=#{1,3}\s)"), lambda p: F.length(F.trim(p)) > longer)).alias("ordinal", "content"))


def character_chunks(rows: DataFrame, key: str, text: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """TGF06: key, ordinal, content: windows of `size` characters that overlap; the last one ends with the text."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return rows.filter(F.length(text) > 0).select(key, F.posexplode(F.transform(starts, lambda s: F.substring(F.col(text), s + 1, F.lit(size)))).alias("ordinal", "content"))


def equations(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """TGF07: key, ordinal, latex: displayed equations, then inline ones."""
    shown = F.regexp_extract_all(text, F.lit(r"\$\$((?s:.+?))\$\$"), F.lit(1))
    rest = F.regexp_replace(text, r"\$\$(?s:.+?)\$\$", " ")
    inline = F.regexp_extract_all(rest, F.lit(r"\$([^$\n]+?)\$"), F.lit(1))
    return rows.select(key, F.posexplode(F.concat(shown, inline)).alias("ordinal", "latex"))


def definitions(text: Column) -> Column:
    """STR10: array of (symbol, meaning): 'x is the ...', 'x denotes ...', 'where x represents ...'."""
    pattern = r"\b([A-Za-z][A-Za-z0-9_]{0,19})\s+(?:is the|denotes|represents|stands for)\s+([^.,;\n]{3,200})"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("symbol"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("meaning"))
    return F.filter(pairs, lambda p: ~F.lower(p["symbol"]).isin("it", "this", "that", "which", "there", "what"))


def keywords(rows: DataFrame, key: str, text: str = "text", most: int = 15) -> DataFrame:
    """TGF11: key, concept: the words of a 'Keywords:' line, once each, longer than 2 characters, at most 15."""
    line = F.regexp_extract(text, r"(?im)^\W*keywords\W*:\s*(.+)$", 1)
    words = F.array_distinct(F.filter(F.transform(F.split(line, "[,;]"), lambda w: F.trim(w)), lambda w: F.length(w) > 2))
    return rows.select(key, F.explode(F.slice(words, 1, most)).alias("concept"))


def _units(text: str) -> list[tuple]:
    """(unit_type, section_path, content) of a Markdown text, in order."""
    out: list[tuple] = []
    body = re.sub(r"\A---\n.*?\n---\n", "", text, count=1, flags=re.S)
    state = {"path": "", "level": 0, "summary": False, "lines": []}

    def flush() -> None:
        content = "\n".join(state["lines"]).strip()
        state["lines"] = []
        if not content:
            return
        path = state["path"]
        kind = "summary" if state["summary"] and path else "method" if "method" in path.lower() else "section"
        out.append((kind, path, content))
        for p in re.split(r"\n\s*\n", content):
            if len(p.strip()) >= LEAST_PARAGRAPH:
                out.append(("summary" if state["summary"] else "method" if kind == "method" else "paragraph", path, p.strip()))

    held: list[str] | None = None
    for line in body.split("\n"):
        heading = re.match(r"(#{1,6})\s+(.*)", line)
        bare = line.strip()
        if held is not None:
            held.append(bare.removesuffix("$$"))
            if bare.endswith("$$"):
                out.append(("equation", state["path"], "\n".join(held).strip()))
                held = None
        elif heading:
            flush()
            level, title = len(heading[1]), heading[2].strip()
            if title.lower() in ("generated scientific summary", "extracted source text"):
                state.update(summary=title.lower().startswith("generated"), path="", level=0)
            else:
                state["path"] = f"{state['path']} > {title}" if state["path"] and level > state["level"] else title
                state["level"] = level
        elif bare.startswith("$$"):
            flush()
            if len(bare) > 4 and bare.endswith("$$"):
                out.append(("equation", state["path"], bare[2:-2].strip()))
            else:
                held = [bare[2:]]
        else:
            state["lines"].append(line)
    flush()
    return out


def search_units(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """TGF01, TGF03: key, ordinal, unit_type, section_path, content.

    A heading no deeper than the one before replaces the whole path, a deeper one is appended. Each section is a unit, and so
    are its paragraphs. The state runs along a document, so documents are handled one by one, in Arrow batches.
    """
    kind = dict(rows.dtypes)[key]

    def split(batches):
        for b in batches:
            found = [(k, i, *u) for k, x in zip(b[key], b[text], strict=True) if x is not None for i, u in enumerate(_units(x))]
            yield pd.DataFrame(found, columns=[key, "ordinal", "unit_type", "section_path", "content"])

    return rows.select(key, text).mapInPandas(split, f"{key} {kind}, ordinal int, unit_type string, section_path string, content string")


def unit_type(path: Column, in_summary: Column) -> Column:
    """TGF03: what a section's unit is: part of a summary (with a heading above it), a method by its path, or a section."""
    return F.when(in_summary & (F.coalesce(path, F.lit("")) != ""), "summary").when(F.lower(path).contains("method"), "method").otherwise("section")


def with_structured(units: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """TGF04: units with the extracted equations of a document in place of those in its text, where it has any."""
    has = found.select(key).distinct().withColumn("_has", F.lit(True))
    kept = units.join(has, key, "left").filter((F.col("unit_type") != "equation") | F.col("_has").isNull()).drop("_has")
    return kept.unionByName(found.select(key, F.lit(None).cast("int").alias("ordinal"), F.lit("equation").alias("unit_type"), F.lit("").alias("section_path"), F.col("latex").alias("content")))


def tag_rows(tagged: DataFrame, aliases: DataFrame) -> DataFrame:
    """TGF19: (paper_id, category, raw_name) resolved to all tags of its alias (0.8), else a new tag of the name itself (0.7)."""
    named = tagged.withColumn("normalized_alias", F.lower(F.trim("raw_name")))
    return named.join(aliases, ["normalized_alias", "category"], "left").select("paper_id", "category", "raw_name", F.coalesce("tag", "normalized_alias").alias("tag"), F.when(F.col("tag").isNotNull(), 0.8).otherwise(0.7).alias("confidence"))


def html_text(html: Column) -> Column:
    """SRC19: the text of a web page, without scripts, styles and tags."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
