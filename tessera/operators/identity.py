"""Identity of papers: fuzzy matches, cascades of lookups, name resolution (JON11-20, STR05, CMP12)."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import normalize_title

LEAST_TITLE, LEAST_SCORE = 0.6, 0.7


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; only pairs that passed the cheaper tests come here."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def match_score(title_a: Column, title_b: Column, authors_a: Column, authors_b: Column, year_a: Column, year_b: Column) -> Column:
    """STR05: 0.6 of the titles' likeness, 0.2 of the authors' (0.5 where one has none) and 0.2 for equal years; null for titles under 0.6."""
    ts = similarity(normalize_title(title_a), normalize_title(title_b))
    authors = F.when(F.coalesce(authors_a, F.lit("")).eqNullSafe("") | F.coalesce(authors_b, F.lit("")).eqNullSafe(""), 0.5).otherwise(similarity(F.lower(authors_a), F.lower(authors_b)))
    return F.when(ts >= LEAST_TITLE, 0.6 * ts + 0.2 * authors + F.when(year_a == year_b, 0.2).otherwise(0.0))


def fuzzy_matches(probes: DataFrame, papers: DataFrame) -> DataFrame:
    """JON11, STR05: probe_id, paper_id, score of the best paper for each probe, if it reaches 0.7.

    Both have title, authors and year. 0.6 of the score is the title, 0.2 the authors (0.5 where one has none), 0.2 the year;
    a title under 0.6 can't match. Titles that are 0.6 alike share words unless they are very short, so pairs meet on words
    (each pair once, the most frequent words only where a title has no other), and pass a bound from their lengths first.
    """

    def worded(df: DataFrame, id_: str) -> DataFrame:
        t = df.select(F.col(id_), normalize_title(F.col("title")).alias("t"), F.lower("authors").alias("au"), "year")
        return t.withColumn("w", F.array_distinct(F.split("t", " +")))

    p, q = worded(papers, "paper_id"), worded(probes, "probe_id")
    words = p.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    keyed = q.select("probe_id", F.explode("w").alias("word")).join(words, "word")
    rare = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("probe_id").orderBy("df", "word"))).withColumn("_n", F.count("*").over(Window.partitionBy("probe_id")))
    # of n words at least 0.3 n are shared at a ratio of 0.6, so the rarest 0.7 n and one more hold a shared one
    probing = rare.filter(F.col("_r") <= F.ceil(0.7 * F.col("_n")) + 1).select("probe_id", "word")
    pairs = probing.join(p.select("paper_id", F.explode("w").alias("word")), "word").select("probe_id", "paper_id").distinct()
    both = pairs.join(q.select("probe_id", F.col("t").alias("qt"), F.col("au").alias("qa"), F.col("year").alias("qy")), "probe_id").join(p.drop("w"), "paper_id")
    la, lb = F.length("qt"), F.length("t")
    close = both.filter(2 * F.least(la, lb) >= LEAST_TITLE * (la + lb)).withColumn("ts", similarity("qt", "t")).filter(F.col("ts") >= LEAST_TITLE)
    authors = F.when(F.col("qa").isNull() | F.col("au").isNull() | (F.col("qa") == "") | (F.col("au") == ""), 0.5).otherwise(similarity("qa", "au"))
    scored = close.withColumn("score", 0.6 * F.col("ts") + 0.2 * authors + F.when(F.col("qy") == F.col("year"), 0.2).otherwise(0.0))
    return scored.filter(F.col("score") >= LEAST_SCORE).groupBy("probe_id").agg(F.max_by(F.struct("paper_id", "score"), F.struct("score", -F.col("paper_id"))).alias("b")).select("probe_id", "b.paper_id", "b.score")


def edit_matches(probes: DataFrame, papers: DataFrame, key: str, most: int) -> DataFrame:
    """Pairs of one block whose titles are within an edit distance. Only different titles are compared; rows alike take what was found."""
    named = lambda df, c: df.select(key, F.col("title").alias(c))
    pairs = named(probes, "_q").distinct().join(named(papers, "_p").distinct(), key).withColumn("distance", F.levenshtein("_q", "_p", most).cast("long"))
    found = pairs.filter("distance >= 0")
    rows = found.join(probes.select(key, F.col("title").alias("_q"), "probe_id"), [key, "_q"]).join(papers.select(key, F.col("title").alias("_p"), "paper_id"), [key, "_p"])
    return rows.select("probe_id", "paper_id", "distance")


def cascade(probes: DataFrame, key: str, steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """JON12-14, SRC02, CMP12: the match of the first step that has one, and the step's name; without any, null and 'created'.

    Each step is a table of the key and match, one row per key at most.
    """
    out = probes.select(key)
    for name, table in steps:
        out = out.join(table.select(key, F.col("match").alias(f"_{name}")), key, "left")
    names = F.lit("created")
    for name, _ in reversed(steps):
        names = F.when(F.col(f"_{name}").isNotNull(), name).otherwise(names)
    return out.select(key, F.coalesce(*(F.col(f"_{n}") for n, _ in steps)).alias("match"), names.alias("outcome"))


def resolve(calls: DataFrame, candidates: list[Column], functions: DataFrame, name: str = "call") -> DataFrame:
    """JON16-20: each call with the function its first resolvable candidate name stands for, else itself.

    Candidate names are exploded with their priority and joined once by equality.
    """
    tried = calls.select(name, F.posexplode(F.array(*candidates)).alias("priority", "full"))
    found = tried.join(functions.select(F.col("name").alias("full")).distinct(), "full").groupBy(name).agg(F.min_by("full", "priority").alias("target"))
    return calls.join(found, name, "left").withColumn("target", F.coalesce("target", name))


def by_containment(probes: DataFrame, keys: DataFrame, width: int = 30) -> DataFrame:
    """JON12: stem, match: the first key (by ordinal) that equals the stem, else one whose first `width` characters the stem
    holds, or that holds the stem's. Pairs meet on equal starts of `width` or, for shorter ones, on their whole. Of the keys with
    one start, and of those that hold one text, only the first is kept: a stem's windows meet a row each, whatever the copies."""
    firsts = lambda df, c: df.groupBy(c).agg(F.min(F.struct("ordinal", "key")).alias("_k"))
    keys = keys.filter("key IS NOT NULL AND ordinal IS NOT NULL").groupBy("key").agg(F.min("ordinal").alias("ordinal"))
    exact = probes.join(keys, probes["stem"] == keys["key"]).select("stem", F.col("key").alias("match"))
    head = lambda c: F.substring(c, 1, width)
    spots = lambda df, c: df.withColumn("_w", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - width + 1, F.lit(1))), lambda i: F.substring(F.col(c), i, F.lit(width))))))
    a = spots(probes.select("stem"), "stem").join(firsts(keys.withColumn("_w", head("key")), "_w"), "_w")
    b = probes.select("stem", head("stem").alias("_w")).join(firsts(spots(keys, "key"), "_w"), "_w")
    part = a.select("stem", "_k").unionByName(b.select("stem", "_k")).groupBy("stem").agg(F.min("_k")["key"].alias("match"))
    return cascade(probes, "stem", [("exact", exact), ("part", part)])
