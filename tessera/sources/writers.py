"""Writers (SNK): reports and files as DataFrames of lines or texts, written by Spark's committers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import safe_filename


def non_empty(rows: DataFrame, text: str) -> DataFrame:
    """SNK01: fails on an empty content when it is written."""
    return rows.withColumn(text, F.when(F.length(F.trim(text)) > 0, F.col(text)).otherwise(F.raise_error(F.lit("empty content")).cast("string")))


def companions(papers: DataFrame, tags: DataFrame) -> DataFrame:
    """SNK02, AGG17: paper_id, json: a paper's fields and its tags by category."""
    by_category = tags.groupBy("paper_id", "category").agg(F.sort_array(F.collect_set("name")).alias("names"))
    grouped = by_category.groupBy("paper_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "names")))).alias("tags"))
    return papers.join(grouped, "paper_id", "left").select("paper_id", F.to_json(F.struct(*papers.columns, "tags")).alias("json"))


def bibtex_entry(key: Column, **fields: Column) -> Column:
    """SNK03: an article entry; empty fields are left out."""
    lines = [F.when(v.isNotNull() & (v.cast("string") != ""), F.concat(F.lit(f"  {k} = {{"), v.cast("string"), F.lit("}"))) for k, v in fields.items()]
    return F.concat(F.lit("@article{"), key, F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}\n"))


def write_table(rows: DataFrame, path: str, separator: str = "\t") -> None:
    """SNK04: a table with a header; nulls are empty."""
    rows.na.fill("").write.mode("overwrite").option("sep", separator).option("header", True).option("emptyValue", "").csv(path)


def report(rows: DataFrame, title: str, name: str, facts: dict[str, Column]) -> DataFrame:
    """SNK05: part, text: a head with aggregates, then a table line per row."""
    head = rows.agg(*(v.cast("string").alias(k) for k, v in facts.items()))
    text = F.concat_ws("\n", F.lit(f"# {title}"), F.lit(""), *(F.concat(F.lit(f"- {k}: "), F.col(k)) for k in facts))
    lines = rows.select(F.lit(1).alias("part"), F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns)), F.lit(" |")).alias("text"))
    return head.select(F.lit(0).alias("part"), text.alias("text")).unionByName(lines).orderBy("part", "text")


def vault(links: DataFrame) -> DataFrame:
    """SNK06: name, page: one page per tag with its papers in order, and an index page with the counts."""
    papers = links.groupBy("category", "name").agg(F.sort_array(F.collect_set("paper_key")).alias("p"))
    pages = papers.select("name", F.concat(F.lit("# "), "name", F.lit("\n\n"), F.array_join(F.transform("p", lambda k: F.concat(F.lit("- [["), k, F.lit("]]"))), "\n")).alias("page"))
    entries = F.sort_array(F.collect_list(F.struct("category", (-F.size("p")).alias("o"), "name")))
    index = papers.agg(entries.alias("e")).select(F.lit("index").alias("name"), F.array_join(F.transform("e", lambda e: F.concat(e["category"], F.lit(": [["), e["name"], F.lit("]] ("), (-e["o"]).cast("string"), F.lit(")"))), "\n").alias("page"))
    return pages.unionByName(index)


def vault_by_category(links: DataFrame) -> DataFrame:
    """SNK06 for a large vault: name, page: one page per tag, an index page per category, and an index of the categories.

    No page holds more than one category's tags, or one tag's papers; what is counted is combined before it is shuffled.
    """
    papers = links.groupBy("category", "name").agg(F.sort_array(F.collect_set("paper_key")).alias("p"))
    pages = papers.select("name", F.concat(F.lit("# "), "name", F.lit("\n\n"), F.array_join(F.transform("p", lambda k: F.concat(F.lit("- [["), k, F.lit("]]"))), "\n")).alias("page"))
    counted = links.select("category", "name", "paper_key").distinct().groupBy("category", "name").agg(F.count("*").alias("n"))
    entries = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "name")))
    of_category = counted.groupBy("category").agg(entries.alias("e")).select(F.concat(F.lit("index/"), "category").alias("name"), F.array_join(F.transform("e", lambda e: F.concat(F.lit("[["), e["name"], F.lit("]] ("), (-e["o"]).cast("string"), F.lit(")"))), "\n").alias("page"))
    all_ = counted.groupBy("category").agg(F.count("*").alias("n")).agg(F.sort_array(F.collect_list(F.struct("category", "n"))).alias("e"))
    index = all_.select(F.lit("index").alias("name"), F.array_join(F.transform("e", lambda e: F.concat(F.lit("[[index/"), e["category"], F.lit("]] ("), e["n"].cast("string"), F.lit(")"))), "\n").alias("page"))
    return pages.unionByName(of_category).unionByName(index)


def commit_pages(commits: DataFrame) -> DataFrame:
    """SNK07: hash, page of each commit."""
    return commits.select("hash", F.concat(F.lit("# Commit "), "hash", F.lit("\n\nAuthor: "), "author", F.lit("\nDate: "), "date", F.lit("\n\n"), "message", F.lit("\n")).alias("page"))


def rename_proposal(author: Column, year: Column, title: Column) -> Column:
    """SNK08: Author_Year_Title as a file name."""
    return safe_filename(F.concat_ws("_", author, year.cast("string"), title))


def bundle(fields: dict[str, Column], summary: Column, source: Column) -> Column:
    """SNK10: front matter (empty keys left out, values as JSON), summary and source as one Markdown text."""
    front = [F.when(v.isNotNull() & (v.cast("string") != ""), F.concat(F.lit(f'{k}: "'), F.replace(F.replace(v.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *front), F.lit("\n---\n\n# Generated scientific summary\n\n"), F.coalesce(summary, F.lit("")), F.lit("\n\n# Extracted source text\n\n"), F.coalesce(source, F.lit("")))


def write_vectors(chunks: DataFrame, path: str) -> None:
    """SNK09: chunk_id, text, embedding; each chunk once."""
    chunks.dropDuplicates(["chunk_id"]).write.mode("overwrite").parquet(path)
