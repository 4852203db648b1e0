"""The corpus pipeline: quality rules, line dedup, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns of
documents. Rows go from stage to stage as Parquet tables in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, mixing, near_text, packing, quality
from tessera.llm._common import documents, forget, written

COLUMNS = ("doc_id", "text", "lang", "source")
#: Stands for a missing doc_id in joins; the least long, which no document has.
NO_ID = -(1 << 63)


def _as_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of documents, with text taken from another column and n_chars counted anew."""
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that are over their host's limit."""
    return _as_documents(quality.quality_rules(docs.select(*COLUMNS)).filter("kept"), "clean_text")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without cross-site boilerplate; near-duplicates that mostly consist of it are left to the next stage."""
    return _as_documents(line_dedup.line_dedup(docs.select(*COLUMNS), copies=near_text.copies), "clean_text")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the one row with the least doc_id, then the least hash of the text; null ids come last.

    Texts are linked if the Jaccard similarity of their five-word shingles is 0.8 or more.
    """
    groups = near_text.near_texts(docs).withColumn("_none", F.col("doc_id").isNull())
    first = groups.groupBy("component").agg(F.min(F.struct("_none", F.coalesce("doc_id", F.lit(NO_ID)).alias("_k"), F.col("t").alias("_t"))).alias("_first")).select("_first._k", "_first._t")
    # plain keys, so that the join and the repeated rows share a shuffle
    kept = docs.select(*COLUMNS, F.coalesce("doc_id", F.lit(NO_ID)).alias("_k"), F.xxhash64("text").alias("_t")).join(first, ["_k", "_t"], "left_semi")
    return _as_documents(kept.dropDuplicates(["_k", "_t"]))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says, in the order of a global shuffle."""
    return mixing.mix(docs).select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("near-duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: Token ids and fingerprints have no counterpart in SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of sf_dir."""
    docs, before = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
