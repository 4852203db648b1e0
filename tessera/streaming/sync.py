"""Incremental ingest (§2.11): a folder as a stream of files, each content once, in batches that can be repeated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sync(spark: SparkSession, folder: str, target: str, checkpoint: str, pattern: str = "*", process: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Processes the files that are new since the last call, then stops.

    A batch writes to a folder of its own number, so a repeated batch replaces itself; files whose content is in the target
    already are skipped.
    """
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.withColumn("sha256", F.sha2("content", 256)).dropDuplicates(["sha256"])
        known = _known(spark, target, number)
        if known is not None:
            fresh = fresh.join(known, "sha256", "left_anti")
        out = fresh.select("path", "sha256", F.decode("content", "utf-8").alias("text"))
        (out if process is None else process(out)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _known(spark: SparkSession, target: str, number: int) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not any(s.getPath().getName().startswith("batch=") for s in fs.listStatus(path)):
        return None
    return spark.read.parquet(target).filter(F.col("batch") != number).select("sha256").distinct()


def registry_skip(found: DataFrame, registry: DataFrame) -> DataFrame:
    """Resumable registry: files that were converted, or failed, before are left out."""
    return found.join(registry.filter(F.col("status").isin("ok", "failed")).select("path"), "path", "left_anti")
