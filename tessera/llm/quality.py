"""Quality rules: figures of each text, then line frequency across the documents of a host. DataFrame functions only.

A host is a source. Lines are normalised and hashed; a line is over the limit if more distinct documents of its host hold it
than max(min_documents, share * distinct documents of the host). Such lines are removed. A document whose words are mostly in
removed lines is depleted and rejected, as are documents that fail the base rules.

Null texts are empty (and fail the base rules, having no words). A null source is a host like any other. Rows with the same
doc_id and text are one document and get the same verdict each; rows with different ids are documents of their own, also
with equal texts. A line that is exactly at the limit stays. Empty tables give no rows, very long texts are read whole. Columns of
docs that carry the names of the results are replaced, all others kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import inside, outside, written
from tessera.llm.lines import hashed_lines, lines, without, words

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
FIGURES = (*BASE, "kept", "clean_text")


def figures(docs: DataFrame) -> DataFrame:
    """docs, of renamed columns, with the base figures and base_failed."""
    text = F.coalesce(F.col("in_text"), F.lit(""))
    with_word = F.filter(lines(text), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    df = docs.withColumn("_w", words(text)).withColumn("_l", with_word)
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    w = F.col("_w")
    df = df.withColumn("_h", F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0))))
    df = df.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")).drop("_w", "_l")
    df = with_repeats(df).drop("_h").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    # through a generator, as a filter on a figure would else be pushed down with all arrays written into its lambdas
    own = [c for c in df.columns if c not in BASE]
    return df.select(*own, F.explode(F.array(F.struct(*BASE))).alias("_x")).select(*own, "_x.*")


def with_repeats(df: DataFrame) -> DataFrame:
    """df with n_repeat_words: words in windows (_h: their hashes, in order) that occur twice or more.

    A window's position replaces the lowest bits of its hash, as many as positions need, so that a plain sort of longs brings
    equal windows together; then the full hashes of neighbours are compared. Where different windows share the bits that are
    left, the text's windows are sorted by full hash and position instead, which takes longer. Each step is a column, as an
    array that a lambda reads must not be computed anew for each element.
    """
    h, low = F.col("_h"), F.col("_low")
    bits = F.ceil(F.log2(F.size(h) + 1)).cast("int")
    df = df.withColumn("_low", F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
    placed = F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("_o", F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(F.sort_array(placed)))
    df = df.withColumn("_f", F.transform("_o", lambda x: F.get(h, x.bitwiseAND(low).cast("int"))))
    top = lambda x: x.bitwiseAND(F.bitwise_not(low))
    mixed = F.filter("_o", lambda x, j: F.coalesce((top(x) == top(F.get(F.col("_o"), j - 1))) & (F.get(F.col("_f"), j) != F.get(F.col("_f"), j - 1)), F.lit(False)))
    df = df.withColumn("_p", F.when(F.size(mixed) > 0, F.transform(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i")))), lambda s: s["i"])))
    df = df.withColumn("_f", F.when(F.col("_p").isNull(), F.col("_f")).otherwise(F.transform("_p", lambda i: F.get(h, i.cast("int")))))
    df = df.withColumn("_o", F.coalesce("_p", F.transform("_o", lambda x: x.bitwiseAND(low))))
    twice = F.filter("_o", lambda x, j: F.coalesce((F.get(F.col("_f"), j) == F.get(F.col("_f"), j - 1)) | (F.get(F.col("_f"), j) == F.get(F.col("_f"), j + 1)), F.lit(False)))
    starts = F.sort_array(twice)
    first = F.struct(F.lit(-3).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
    n = F.aggregate(starts, first, lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(3).cast("long"), x - a["at"])).alias("n")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", n).drop("_low", "_o", "_f", "_p")


def over_limit(docs: DataFrame, share: float, min_documents: int) -> DataFrame:
    """host, t, gone (hashes of the lines to remove), lost (their words) for documents with lines over the limit.

    A row of a null hash, which counts a document's rows, stands for each document, so the documents of a host are counted in the
    same pass. A line that very
    many documents hold is combined within each task before any row is shuffled.
    """
    rows = docs.select("host", "t", F.explode(F.concat(F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(1).alias("words"))), F.filter(hashed_lines(F.coalesce("in_text", F.lit(""))), lambda x: x["h"].isNotNull()))).alias("x"))
    held = written(rows.groupBy("host", F.col("x.h").alias("h"), "t").agg(F.sum("x.words").alias("words")))
    counts = held.groupBy("host", "h").count()
    limits = counts.filter("h IS NULL").select("host", F.greatest(F.lit(float(min_documents)), share * F.col("count")).alias("most"))
    often = counts.filter(F.col("h").isNotNull() & (F.col("count") > min_documents)).join(limits, "host").filter(F.col("count") > F.col("most")).select("host", "h")
    lost = held.join(often, ["host", "h"]).groupBy("host", "t").agg(F.collect_set("h").alias("gone"), F.sum("words").alias("lost"))
    repeated = held.filter("h IS NULL AND words > 1").select("host", "t", F.col("words").alias("rows"))
    return lost.join(repeated, ["host", "t"], "left").select("host", "t", "gone", (F.col("lost") / F.coalesce("rows", F.lit(1))).alias("lost"))


def quality_rules(docs: DataFrame, share: float = 0.02, min_documents: int = 5, depleted: float = 0.5) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and clean_text (without removed lines)."""
    text = F.coalesce("in_text", F.lit(""))
    own = inside(docs, *FIGURES)
    keyed = own.withColumns({"host": F.xxhash64("in_source"), "t": F.xxhash64("in_doc_id", text)})
    joined = figures(keyed).join(over_limit(keyed, share, min_documents), ["host", "t"], "left")
    verdict = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce("lost", F.lit(0)) <= depleted * F.col("n_words"))
    out = joined.select(*own.columns, *BASE, verdict.alias("kept"), without(text, F.col("gone")).alias("clean_text"))
    return out.select(*outside(own), *FIGURES)


QUALITY_ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, host, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM d),
pos AS (SELECT doc_id, i, w[i] || chr(31) || w[i + 1] || chr(31) || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT doc_id, g FROM pos GROUP BY doc_id, g HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM pos JOIN twice USING (doc_id, g)) GROUP BY doc_id),
ln AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln
  WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY doc_id),
nl AS (SELECT doc_id, host, text, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[ \t\x0B\f\r]+', ' ', 'g')) AS n FROM ln),
used AS (SELECT * FROM nl WHERE n <> ''),
freq AS (SELECT host, n, count(DISTINCT doc_id) AS c FROM used GROUP BY host, n),
hosts AS (SELECT host, count(DISTINCT doc_id) AS docs FROM d GROUP BY host),
often AS (SELECT host, n FROM freq JOIN hosts USING (host) WHERE c > greatest(5, 0.02 * docs)),
lost AS (SELECT doc_id, sum(len(string_split(n, ' '))) AS lost FROM used JOIN often USING (host, n) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(length(array_to_string(w.w, '')), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND lost <= 0.5 * n_words AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
"""
