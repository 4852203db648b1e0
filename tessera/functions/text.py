"""Scalar text functions as Column expressions (STR, AGG12, AGG19). Null in, null out, unless a docstring says otherwise."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks from these blocks are folded; the table follows from the Unicode decomposition.
_FOLDED = {chr(c): d for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(d := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) == 1 and d != chr(c)}


def fold(text: Column) -> Column:
    """Without diacritics. A text of one byte a character has none."""
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, "".join(_FOLDED), "".join(_FOLDED.values())))


def tokens(text: Column) -> Column:
    """FTS: folded, lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(fold(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def normalize_doi(doi: Column) -> Column:
    """STR01: without resolver or scheme in front, trimmed, in lower case; nothing left gives null."""
    bare = F.trim(F.regexp_replace(F.lower(F.trim(doi)), r"^(https?://)?(dx\.)?doi\.org/|^doi:\s*", ""))
    return F.nullif(bare, F.lit(""))


def find_doi(text: Column) -> Column:
    """STR02: the first DOI in a text, or null."""
    return F.nullif(F.regexp_extract(text, r"(?i)\b(10\.\d{4,9}/[-._;()/:A-Z0-9]+)", 1), F.lit(""))


def source_kind(text: Column) -> Column:
    """SRC21: path, doi, arxiv or url, in this order."""
    return F.when(text.rlike(r"(?i)\.pdf$") & ~text.rlike("^https?://"), "path").when(text.rlike(r"(?i)10\.\d{4,9}/"), "doi").when(text.rlike(r"(?i)(arxiv[:./]|^\d{4}\.\d{4,5}(v\d+)?$)"), "arxiv").otherwise("url")


#: Accent commands of LaTeX and the combining marks they stand for.
LATEX_MARKS = {"'": "́", "`": "̀", "^": "̂", '"': "̈", "~": "̃"}


def decode_latex(text: Column) -> Column:
    """STR03: accent commands over a letter become the letter with its mark; braces around text go."""
    pairs = [(f"\\{c}{{{x}}}", f"\\{c}{x}", unicodedata.normalize("NFC", x + m)) for c, m in LATEX_MARKS.items() for x in "aeiounAEIOUN" if len(unicodedata.normalize("NFC", x + m)) == 1]
    plain = reduce(lambda t, p: F.replace(F.replace(t, F.lit(p[0]), F.lit(p[2])), F.lit(p[1]), F.lit(p[2])), pairs, text)
    return F.regexp_replace(plain, r"\{([^{}]+)\}", "$1")


#: Words that carry no meaning in a title.
STOPWORDS = ("the", "a", "an", "of", "for", "and", "on", "in", "with", "to", "from", "by", "via", "using")


def paper_key(authors: Column, year: Column, title: Column) -> Column:
    """STR04: Lastname_Year_Keyword, in letters, digits and underscores. No author: Unknown; no year: 0000; a title without a
    meaningful word: its first word; no title: Untitled."""
    first = F.trim(F.split(F.split(authors, ";").getItem(0), " and ").getItem(0))
    last = F.when(first.contains(","), F.trim(F.split(first, ",").getItem(0))).otherwise(F.element_at(F.split(first, r"\s+"), -1))
    last = F.regexp_replace(F.when(F.coalesce(authors, F.lit("")) == "", "Unknown").otherwise(last), "[^A-Za-z0-9_]", "")
    words = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    telling = F.filter(words, lambda w: (F.length(w) > 1) & ~F.lower(w).isin(*STOPWORDS))
    word = F.coalesce(F.get(telling, F.lit(0)), F.get(words, F.lit(0)), F.lit("Untitled"))
    return F.concat_ws("_", last, F.when(F.coalesce(year, F.lit(0)) == 0, "0000").otherwise(year.cast("string")), word)


def file_metadata(stem: Column) -> Column:
    """STR17: struct(authors, year, title) as a file's name tells them: the first part, the first year, and the other parts."""
    parts = F.filter(F.split(stem, r"[_\-]+"), lambda t: t != "")
    is_year = lambda t: t.rlike(r"^(?:19|20)\d{2}$")
    rest = F.array_join(F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), lambda t: ~is_year(t)), " ")
    return F.struct(F.get(parts, F.lit(0)).alias("authors"), F.get(F.filter(parts, is_year), F.lit(0)).try_cast("int").alias("year"), F.when(rest == "", stem).otherwise(rest).alias("title"))


def tag_reference(text: Column) -> Column:
    """FIL21: struct(category, name) of category:name (underscores of the name are spaces) or of a bare name."""
    t = F.trim(text)
    pair = t.contains(":")
    return F.struct(F.when(pair, F.trim(F.substring_index(t, ":", 1))).alias("category"), F.when(pair, F.replace(F.trim(F.regexp_replace(t, "^[^:]*:", "")), F.lit("_"), F.lit(" "))).otherwise(t).alias("name"))


def query_terms(text: Column) -> Column:
    """FTS01: the phrases of a query, one for each term between spaces, as arrays of tokens; terms without tokens are left out."""
    terms = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    return F.filter(F.transform(terms, tokens), lambda p: F.size(p) > 0)


def axis_value(card: Column, axis: str, own: Column | None = None) -> Column:
    """JSN03: what a card says on an axis, in lower case; lists are joined by "; "; else the method's own column, else N/A."""
    raw = F.get_json_object(card, f"$.{axis.lower()}")
    items = F.from_json(raw, "array<string>")
    value = F.when(raw.startswith("["), F.array_join(items, "; ")).otherwise(raw)
    return F.coalesce(F.nullif(value, F.lit("")), *([F.nullif(own, F.lit(""))] if own is not None else []), F.lit("N/A"))


def normalize_title(text: Column) -> Column:
    """STR06: lower case letters, digits and spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", ""))


def normalize_alias(text: Column) -> Column:
    """STR06: word characters, spaces and hyphens in lower case, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\w -]", ""), " +", " "))


def safe_filename(text: Column, limit: int = 160) -> Column:
    """STR07: word characters joined by single underscores."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9.-]+", "_"), "^_+|_+$", ""), 1, limit)


def normalize_latex(text: Column) -> Column:
    """STR08: without dollar signs and a number at the end, single spaces."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^\$+|\$+$", ""), r"\s*\(\d+(\.\d+)*\)\s*$", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def equation_number(text: Column) -> Column:
    """STR09: the number in brackets at the end, or null."""
    return F.nullif(F.regexp_extract(text, r"\((\d+(?:\.\d+)*)\)\s*$", 1), F.lit(""))


def excerpt(text: Column, limit: int, marker: str = " ...") -> Column:
    """STR11: at most limit characters, cut at the last paragraph, line or sentence end in the second half, else hard."""
    head = F.substring(text, 1, limit)

    def last(mark: str) -> Column:
        turned = F.locate(mark[::-1], F.reverse(head))
        return F.when(turned > 0, F.lit(limit) - turned - len(mark) + 2)

    cuts = [F.when(last(m) - 1 >= limit // 2, last(m) - 1) for m in ("\n\n", "\n", ". ")]
    cut = F.coalesce(*cuts, F.lit(limit))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(head, F.lit(1), cut)), F.lit(marker)))


def strip_front_matter(text: Column) -> Column:
    """STR12: without a leading block between lines of three dashes."""
    return F.regexp_replace(text, r"^---\n(?s:.*?)\n---\n", "")


def section(text: Column, start: str, stop: str) -> Column:
    """STR12: what stands between two headings, or null."""
    return F.when(text.contains(start), F.substring_index(F.substring(text, F.locate(start, text) + len(start), F.length(text)), stop, 1))


def compile_markdown(summary: Column, source: Column, marker: str = "# Extracted source text") -> Column:
    """STR13: summary, marker, source; a source that already holds the marker counts from behind it."""
    bare = F.when(source.contains(marker), F.substring_index(source, marker, -1)).otherwise(source)
    return F.concat(F.trim(summary), F.lit(f"\n\n{marker}\n\n"), F.ltrim(F.regexp_replace(bare, r"^\s+", "")))


def first_rule(text: Column, rules: list[tuple[str, str]]) -> Column:
    """STR14: the name of the first rule whose pattern is found, in any case; else the text itself."""
    out = F.when(F.lit(False), text)
    for name, pattern in rules:
        out = out.when(text.rlike(f"(?i){pattern}"), F.lit(name))
    return out.otherwise(text)


def infer_backend(path: Column) -> Column:
    """STR16: the converter that a path speaks of."""
    return F.when(F.lower(path).contains("vlm"), "vlm").when(F.lower(path).contains("pdfminer"), "pdfminer").otherwise("legacy_docling")


def find_year(text: Column) -> Column:
    """STR17: the first year from 1900 to 2099, or null."""
    return F.nullif(F.regexp_extract(text, r"((?:19|20)\d{2})", 1), F.lit("")).try_cast("int")


def json_in(text: Column) -> Column:
    """STR18: the content of a fenced block, else from the first to the last brace, else null."""
    fenced = F.regexp_extract(text, r"```(?:json)?\s*(\{(?s:.*?)\})\s*```", 1)
    bare = F.regexp_extract(text, r"(\{(?s:.*)\})", 1)
    return F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(bare, F.lit("")))


def without_comments(text: Column, language: str) -> Column:
    """STR19: code without comments."""
    return F.regexp_replace(text, r"#[^\n]*", "") if language == "python" else F.regexp_replace(F.regexp_replace(text, r"/\*(?s:.*?)\*/", ""), r"//[^\n]*", "")


def without_fences(text: Column) -> Column:
    """STR19: without the lines that open and close code blocks."""
    return F.regexp_replace(text, r"(?m)^```[^\n]*\n?", "")


def calls(text: Column) -> Column:
    """STR21: names before an opening bracket, once each, keywords left out."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*(?:(?:::|\.)[A-Za-z_][A-Za-z0-9_]*)*)\s*\("), F.lit(1)))
    return F.filter(names, lambda n: ~n.isin("if", "for", "while", "switch", "return", "sizeof"))


def clean_path(text: Column) -> Column:
    """STR22: a path from a reference manager's file field."""
    return F.regexp_replace(F.regexp_replace(text, r"\\:", ":"), r"^:|:pdf$", "")


def rgb(text: Column) -> Column:
    """STR23: #rrggbb as an array of three numbers from 0 to 1."""
    return F.array(*(F.conv(F.substring(text, 2 + 2 * i, 2), 16, 10).cast("double") / 255 for i in range(3)))


#: The price of an operator.
OPERATOR_COST = {"^": 20, "/": 3, "*": 1, "+": 1, "-": 1}


def count_of(text: Column, what: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("long")


def operator_cost(text: Column) -> Column:
    """AGG12: the weighted number of operators."""
    return reduce(lambda a, b: a + b, (count_of(text, o) * w for o, w in OPERATOR_COST.items()))


def estimated_tokens(text: Column) -> Column:
    """AGG19: a quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4)


def floor_tokens(text: Column) -> Column:
    """AGG19: a quarter of the characters, rounded down, at least 1."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(text) / 4))


def prompt(template: str, **parts: Column) -> Column:
    """STR24: a template with {names} filled in; a missing part is empty."""
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def config_hash(config: dict) -> str:
    """The first 16 hexadecimal digits of the SHA-256 of canonical JSON."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]
