"""Tables that a plan writes and reads again: in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local session, whose executors are the driver, may do without."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that is deleted when the session ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    atexit.register(drop, spark, path)
    return path


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: later plans start from it, also when an executor is lost."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over the session's tasks, for work that costs far more than moving them: a small file is one task otherwise."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def forget(table: DataFrame) -> None:
    """Deletes a written table that no later plan reads; the disk is free before the session ends."""
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        drop(table.sparkSession, path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a path; does nothing once the session has ended."""
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stamp(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a table's files: another text once the table is written anew."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}")
    return "\n".join(sorted(out))
