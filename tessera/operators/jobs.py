"""Small jobs of a knowledge base: updates, listings, matrices and maps (DML02, DML07, JON18, WIN04, FTS08-09, CMP, TGF15-16, GRF03-04, AGG11, MTH02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conditional_update(rows: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """DML02: the rows with new values where the condition holds; where it is null they stay."""
    return rows.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def folded_runs(events: DataFrame, key: str, kind: str, at: str, states: dict[str, str], otherwise: str) -> DataFrame:
    """DML07: key, status, started_at, finished_at of each run from its events; of the given kinds the first that occurs tells the status."""
    flags = {f"_f{i}": F.bool_or(F.coalesce(F.col(kind) == k, F.lit(False))) for i, k in enumerate(states)}
    seen = events.groupBy(key).agg(*(v.alias(c) for c, v in flags.items()), F.min(at).alias("started_at"), F.max(at).alias("finished_at"))
    status = F.lit(otherwise)
    for c, s in reversed(list(zip(flags, states.values(), strict=True))):
        status = F.when(F.col(c), s).otherwise(status)
    return seen.select(key, status.alias("status"), "started_at", "finished_at")


def user_tag(text: Column) -> Column:
    """DML22: struct(category, name) of a tag a user writes: category:name, or a bare name of the category "user"; underscores are spaces."""
    parts = F.split(text, ":", 2)
    return F.struct(F.when(F.size(parts) == 2, parts[0]).otherwise("user").alias("category"), F.replace(F.element_at(parts, -1), F.lit("_"), F.lit(" ")).alias("name"))


def import_targets(uses: DataFrame, modules: DataFrame, module: str) -> DataFrame:
    """JON18: file, local_name, target of each import, once; imports of unknown modules are left out."""
    return uses.join(modules, module).select("file", "local_name", "target").distinct()


def preferred_run(runs: DataFrame, key: str, run: str, preferred: Column) -> DataFrame:
    """WIN04: of each key the first preferred run, else its first."""
    return runs.groupBy(key).agg(F.max_by(run, F.struct(F.coalesce(preferred, F.lit(False)).cast("int"), -F.col(run))).alias(run))


def tag_ids(tags: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """FTS08: ids of tags whose name, or one of whose other names, a text spells, whatever its case. Both: id, name."""
    return tags.select("id", "name").unionByName(names.select("id", "name")).filter(F.lower("name") == text.lower()).select("id").distinct()


def papers_of_tags(links: DataFrame, names: list[str]) -> DataFrame:
    """FTS09: papers with one of the tags."""
    return links.filter(F.lower("name").isin([n.lower() for n in names])).select("paper_id").distinct()


def imported_modules(files: DataFrame, file: str, module: str) -> DataFrame:
    """TGF15: file, module: each import of a file once."""
    return files.select(F.col(file).alias("file"), F.col(module).alias("module")).distinct()


def bipartite_edges(rows: DataFrame, left: str, right: str) -> DataFrame:
    """GRF04: src, dst: each pair of values that occur together, once."""
    return rows.select(F.col(left).alias("src"), F.col(right).alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL").distinct()


def scoped_names(rows: DataFrame, scopes: DataFrame, scope_key: str, scope: str, name: str, separator: str = "::") -> DataFrame:
    """GRF03: the rows with full_name, their scope's name before their own; without a scope it is their own."""
    return rows.join(scopes.select(scope_key, scope), scope_key, "left").withColumn("full_name", F.concat_ws(separator, scope, name))


def listed(rows: DataFrame, group: str, order: list[str], item: Column, name: str, separator: str = "\n") -> DataFrame:
    """TGF16, CMP06, CMP10: the items of each group in order as one text. A group is a thing of bounded size: a file, a paper, an order."""
    kept = rows.select(group, F.struct(*order, item.alias("_item")).alias("_x")).groupBy(group).agg(F.sort_array(F.collect_list("_x")).alias("_s"))
    return kept.select(group, F.array_join(F.transform("_s", lambda x: x["_item"]), separator).alias(name))


def first_method(methods: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    """CMP03: the first method of each paper, and how many it has."""
    return methods.groupBy(key).agg(F.min_by(value, order).alias(value), F.count("*").alias("methods"))


def axis_matrix(rows: DataFrame, key: str, axis: str, value: str, axes: list[str], none: str = "N/A") -> DataFrame:
    """CMP04: a row per key with the greatest value on each given axis as text, N/A where there is none."""
    return rows.groupBy(key).agg(*(F.coalesce(F.max(F.when(F.col(axis) == a, F.col(value))).cast("string"), F.lit(none)).alias(a) for a in axes))


def described(rows: DataFrame, tags: DataFrame, key: str, order: list[str], item: Column) -> DataFrame:
    """CMP06: the rows with their tags as one text, empty where there are none."""
    return rows.join(listed(tags, key, order, item, "tags", ";"), key, "left").withColumn("tags", F.coalesce("tags", F.lit("")))


def without_equivalent(runs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """CMP08: runs that no finished run equals in all keys."""
    return runs.join(done.select(*keys).distinct(), keys, "left_anti")


def concept_map(rows: DataFrame, group: str, concept: str) -> DataFrame:
    """CMP10: group, line: a group's concepts with their counts, the most frequent first."""
    n = rows.groupBy(group, concept).agg(F.count("*").alias("n"))
    return listed(n.withColumn("_o", -F.col("n")), group, ["_o", concept], F.concat(concept, F.lit(" ("), F.col("n").cast("string"), F.lit(")")), "line", ", ")


def match_scores(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """CMP05: the first rows of an order with match_score, one over their place."""
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))  # at most `limit` rows
    return rows.orderBy(*order).limit(limit).withColumn("match_score", 1 / place)


def named_steps(rows: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """MTH02: the rows with a column for each assignment, which may use the ones before."""
    for name, expression in steps:
        rows = rows.withColumn(name, F.expr(expression))
    return rows


def bigrams(texts: DataFrame, text: str, least: int) -> DataFrame:
    """AGG11: bigram, n: neighbouring words (two or more letters, digits or underscores, in lower case) that occur at least so often."""
    w = texts.select(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{2,}"), F.lit(0)).alias("w"))
    ends = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = w.select(F.explode(F.zip_with(F.slice("w", F.lit(1), ends), F.slice("w", F.lit(2), ends), lambda a, b: F.concat_ws(" ", a, b))).alias("bigram"))
    return pairs.groupBy("bigram").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
