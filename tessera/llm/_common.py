"""Helpers that the operators of this package share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import drop, forget, new_path, shared_dir, written  # noqa: F401  the operators take them from here

#: Code points that count as white space in the contracts; all other characters make words.
SPACE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed_texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text only (a null text is empty), so that other columns, whatever their names, can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def _quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def inside(docs: DataFrame, *replaced: str) -> DataFrame:
    """docs without the columns that an operator replaces, all others as in_<name>: no name an operator uses inside can clash."""
    lost = {c.lower() for c in replaced}
    return docs.select(*(_quoted(c).alias(f"in_{c}") for c in docs.columns if c.lower() not in lost))


def outside(df: DataFrame) -> list:
    """The columns that inside() renamed, under their own names."""
    return [_quoted(c).alias(c[3:]) for c in df.columns if c.startswith("in_")]


def slices(batches, rows: int = 256):
    """Small pieces of Arrow batches: what a worker holds at once stays bounded."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def row_key():
    """128 bits of a row's identity and text; equal rows share it, null ids are a value like any other."""
    return (F.xxhash64(F.lit(1), "doc_id", "text").alias("k1"), F.xxhash64(F.lit(2), "text", "doc_id").alias("k2"))
