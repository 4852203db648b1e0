"""Visibility, filters, joins, set algebra and roll-ups on tables of papers, tags and runs (FIL, JON, SET, AGG).

Nulls follow SQL: a null never equals, and a row whose predicate is null is dropped, unless a function says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active(rows: DataFrame, runs: DataFrame, run: str = "run_id") -> DataFrame:
    """FIL08, JON06: rows without a run or whose run ended ok. One join for any number of papers."""
    ok = runs.filter(F.col("status") == "ok").select(F.col("id").alias(run)).distinct()
    return rows.filter(F.col(run).isNull()).unionByName(rows.join(ok, run, "left_semi").select(rows.columns))


def equivalent_runs(runs: DataFrame, operation=None, event_type=None) -> DataFrame:
    """FIL05: the newest ok run of each paper and operation; a filter that isn't given matches all."""
    wanted = [F.lit(v).isNull() | F.col(c).eqNullSafe(F.lit(v)) for c, v in (("operation", operation), ("event_type", event_type))]
    ok = runs.filter(reduce(lambda a, b: a & b, wanted, F.col("status") == "ok"))
    return ok.groupBy("paper_id", "operation").agg(F.max("id").alias("run_id"))


def year_range(rows: DataFrame, year: Column, low: int, high: int) -> DataFrame:
    """FIL06: years from low to high; rows without a year are left out."""
    return rows.filter(year.between(low, high))


def contains_any(rows: DataFrame, text: Column, terms: list[str]) -> DataFrame:
    """FIL07: rows whose lower-cased text holds one of the terms; % and _ in a term are wildcards."""
    return rows.filter(reduce(lambda a, b: a | b, (F.lower(text).like(f"%{t.lower()}%") for t in terms), F.lit(False)))


def missing(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """FIL11: rows without a partner."""
    return rows.join(others.select(key).distinct(), key, "left_anti")


def present(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """JON07: rows with a partner, once each."""
    return rows.join(others.select(key).distinct(), key, "left_semi")


def blank(rows: DataFrame, column: str) -> DataFrame:
    """FIL11: rows whose column is null or empty."""
    return rows.filter(F.col(column).isNull() | (F.col(column) == ""))


def needs_reprocessing(runs: DataFrame, operation: int) -> DataFrame:
    """FIL12: papers without an ok run of the operation, or with a failed run of any operation and no newer ok one.

    Two aggregations instead of a correlated search: the newest failed and the newest ok run of each paper and operation.
    """
    latest = runs.groupBy("paper_id", "operation").agg(F.max(F.when(F.col("status") == "failed", F.col("id"))).alias("failed"), F.max(F.when(F.col("status") == "ok", F.col("id"))).alias("ok"))
    due = F.max(F.col("failed").isNotNull() & (F.col("ok").isNull() | (F.col("ok") < F.col("failed"))))
    done = F.max((F.col("operation") == operation) & F.col("ok").isNotNull())
    return latest.groupBy("paper_id").agg(due.alias("due"), done.alias("done")).filter(F.col("due") | ~F.col("done")).select("paper_id")


def with_any_tag(papers: DataFrame, links: DataFrame, tag: str, tags: list[str], key: str) -> DataFrame:
    """FIL13, FTS09: papers with at least one of the tags."""
    return papers.join(links.filter(F.col(tag).isin(tags)).select(key).distinct(), key, "left_semi")


def with_all_tags(papers: DataFrame, links: DataFrame, tag: str, tags: list[str], key: str) -> DataFrame:
    """FIL13, JON09: papers with all tags (relational division). One aggregation, whatever the number of tags."""
    full = links.filter(F.col(tag).isin(tags)).groupBy(key).agg(F.count_distinct(tag).alias("_n")).filter(F.col("_n") == len(set(tags)))
    return papers.join(full.select(key), key, "left_semi")


def subset_of(rows: DataFrame, key: str, item: str, wanted: list) -> DataFrame:
    """FIL16: keys whose items hold all wanted ones."""
    return rows.filter(F.col(item).isin(wanted)).groupBy(key).agg(F.count_distinct(item).alias("_n")).filter(F.col("_n") == len(set(wanted))).select(key)


def page(rows: DataFrame, key: str, limit: int, offset: int) -> DataFrame:
    """FIL18: a page of rows in the order of a unique key."""
    return rows.orderBy(F.col(key).asc_nulls_first()).offset(offset).limit(limit)


def latest(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """AGG06, WIN01: the value of the row with the greatest order in each group."""
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def first_with_override(rows: DataFrame, key: str, first: str, override: str, order: str) -> DataFrame:
    """WIN02: the first row's value and the last non-empty override of each group."""
    filled = F.when(F.col(override).isNotNull() & (F.col(override) != ""), F.col(order))
    return rows.groupBy(key).agg(F.min_by(first, order).alias(first), F.max_by(override, filled).alias(override))


def best_by_priority(rows: DataFrame, key: str, kind: str, priority: dict[str, int], order: str) -> DataFrame:
    """WIN03: the row whose kind has the highest priority (unknown kinds: 0); of equals the first."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in priority.items() for x in kv)), F.col(kind)), F.lit(0))
    return rows.groupBy(key).agg(F.max_by(F.struct(kind, order), F.struct(rank, -F.col(order))).alias("_b")).select(key, f"_b.{kind}", f"_b.{order}")


def numbered_collisions(rows: DataFrame, base: str, order: str) -> DataFrame:
    """WIN05: base, base_2, base_3, ... in order within equal bases."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return rows.withColumn("paper_key", F.when(n == 1, F.col(base)).otherwise(F.concat(base, F.lit("_"), n)))


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """SRT04: the first k rows of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def distribution(tags: DataFrame, links: DataFrame) -> DataFrame:
    """AGG03: the number of links of each tag; tags without links have 0."""
    n = links.groupBy("name", "category").agg(F.count("*").alias("freq"))
    return tags.join(n, ["name", "category"], "left").select("name", "category", F.coalesce("freq", F.lit(0)).cast("long").alias("freq"))


def orphans(tags: DataFrame, links: DataFrame) -> DataFrame:
    """AGG03: tags (name, category) without a link."""
    return tags.select("name", "category").distinct().join(links.select("name", "category").distinct(), ["name", "category"], "left_anti")


def folder_stats(files: DataFrame, folder: str, lines: Column, language: str) -> DataFrame:
    """AGG07: files, lines and the sorted distinct languages of each folder."""
    return files.groupBy(folder).agg(F.count("*").alias("files"), F.sum(lines).alias("lines"), F.array_join(F.sort_array(F.collect_set(language)), ",").alias("languages"))


def matrix(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """AGG08: counts by row and column value, 0 where there is none. The values are given, so no pass is spent to find them."""
    return rows.groupBy(row).agg(*(F.count_if(F.col(column) == v).cast("long").alias(v) for v in values))


def visible_links(assertions: DataFrame, runs: DataFrame) -> DataFrame:
    """DML13, AGG05: links of ok runs with the greatest run, confidence and raw name of each (independently of each other)."""
    ok = runs.filter(F.col("status") == "ok").select(F.col("id").alias("run_id"))
    return assertions.join(ok, "run_id").groupBy("paper_id", "tag_id", "source").agg(F.max("run_id").alias("run_id"), F.max("confidence").alias("confidence"), F.max("raw_name").alias("raw_name"))


def first_links(links: DataFrame, order: str) -> DataFrame:
    """DML12: one visible row per paper, tag and source, the first to arrive; a missing source is one source."""
    return links.groupBy("paper_id", "tag_id", F.coalesce("source", F.lit("")).alias("source")).agg(F.min_by("confidence", order).alias("confidence"), F.min(order).alias(order))


def upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """DML01: rows of both; where both have a row, a null of the source never erases a value."""
    t, s = target.alias("t"), source.alias("s")
    return t.join(s, key, "full_outer").select(key, *(F.coalesce(f"s.{c}", f"t.{c}").alias(c) for c in target.columns if c != key))


def overwrite(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """DML21: rows of both; where both have a row, the source's is taken as it is."""
    return target.join(source.select(key), key, "left_anti").unionByName(source)


def replace_group(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """DML05: all rows of the source's keys are replaced."""
    return target.join(source.select(key).distinct(), key, "left_anti").select(target.columns).unionByName(source)


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """DML10, DML11, DML17, DML20: source rows whose keys are new, once each, are added."""
    fresh = source.dropDuplicates(keys).join(target.select(*keys).distinct(), keys, "left_anti").select(target.columns)
    return target.unionByName(fresh)


def merge_tags(links: DataFrame, tag: str, old, new, identity: list[str]) -> DataFrame:
    """DML14, DML16: links of one tag move to another; a link that is there already stays one."""
    if old == new:
        raise ValueError("a tag can't be merged with itself")
    return links.withColumn(tag, F.when(F.col(tag) == old, F.lit(new)).otherwise(F.col(tag))).dropDuplicates(identity)


def supersede(runs: DataFrame) -> DataFrame:
    """DML08, DML09: ok runs of each paper and operation from new to old; the newest is active and points to the one before."""
    w = Window.partitionBy("paper_id", "operation").orderBy(F.desc("id"))
    return runs.filter("status = 'ok'").select("id", "paper_id", "operation", (F.row_number().over(w) == 1).alias("is_active"), F.lead("id").over(w).alias("supersedes_run_id"))


def active_summaries(summaries: DataFrame, runs: DataFrame) -> DataFrame:
    """DML18, DML19: the newest summary of each paper whose run is ok or missing."""
    return active(summaries, runs).groupBy("paper_id").agg(F.max("id").alias("id"))


def preferred_file(files: DataFrame, chosen: DataFrame) -> DataFrame:
    """DML04: is_preferred is 1 for the chosen file of each paper and 0 for its others; papers without a choice stay."""
    c = chosen.select("paper_id", F.col("file_id").alias("_c"))
    return files.join(c, "paper_id", "left").withColumn("is_preferred", F.when(F.col("_c").isNotNull(), (F.col("id") == F.col("_c")).cast("int")).otherwise(F.col("is_preferred"))).drop("_c")


def start_ids(rows: DataFrame, order: str, last: int) -> DataFrame:
    """Surrogate ids after `last` in a stable order. Counts of key ranges come first, so no single task sees all rows."""
    ranged = rows.withColumn("_b", F.floor(F.col(order) / 4096))
    w = Window.partitionBy("_b").orderBy(order)
    sizes = ranged.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_s", F.floor(F.col("_b") / 4096))
    outer = before.groupBy("_s").agg(F.sum("_n").alias("_m"))
    starts = before.withColumn("_in", F.sum("_n").over(Window.partitionBy("_s").orderBy("_b")) - F.col("_n")).join(outer.withColumn("_out", F.sum("_m").over(Window.orderBy("_s")) - F.col("_m")), "_s")
    return ranged.withColumn("_k", F.row_number().over(w)).join(starts.select("_b", "_in", "_out"), "_b").withColumn("id", (last + F.col("_out") + F.col("_in") + F.col("_k")).cast("long")).drop("_b", "_k", "_in", "_out")


def set_bibtex(papers: DataFrame, entries: DataFrame, folder: str) -> DataFrame:
    """DML03: papers with the path under which the entry (id, bibtex) of each is stored; papers without an entry keep theirs."""
    has = entries.filter("bibtex <> ''").select("id").distinct().withColumn("_has", F.lit(True))
    path = F.concat(F.lit(f"{folder}/"), "paper_key", F.lit(".bib"))
    return papers.join(has, "id", "left").withColumn("bibtex_path", F.when(F.col("_has"), path).otherwise(F.col("bibtex_path"))).select(papers.columns)


def append(target: DataFrame, source: DataFrame) -> DataFrame:
    """DML06: the rows of both; what the source lacks is null."""
    return target.unionByName(source, allowMissingColumns=True).select(target.columns)


def staged_summaries(summaries: DataFrame, runs: DataFrame) -> DataFrame:
    """DML18: id, paper_id, is_active of all summaries: the newest of each paper whose run is ok or missing."""
    best = active_summaries(summaries, runs).select("paper_id", F.col("id").alias("_best"))
    return summaries.join(best, "paper_id", "left").select("id", "paper_id", F.coalesce(F.col("id") == F.col("_best"), F.lit(False)).alias("is_active"))


def with_manual_tags(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """DML23: links with tags (paper_id, name) of the category "manual" added, trimmed and in lower case, each once."""
    own = wanted.select("paper_id", F.lower(F.trim("name")).alias("name"), F.lit("manual").alias("category"))
    return insert_ignore(links, own, ["paper_id", "name", "category"])


def without_tag(links: DataFrame, name: str) -> DataFrame:
    """DML23: links but those of a tag's name."""
    return links.filter(F.lower(F.trim("name")) != name.strip().lower())


def matched(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """JON01: rows of both sides with equal keys."""
    return left.join(right, left[left_key] == right[right_key])


def placed(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """SRT01, SRT03: the first rows of an order, null places stated in it, with their place from 1."""
    first = rows.orderBy(*order).limit(limit)
    return first.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))  # at most `limit` rows
