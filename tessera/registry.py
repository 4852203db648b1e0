"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "fts06_rank"


class Tables:
    """The tables of a directory as attributes; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def runs(self) -> DataFrame:
        """events in the role of processing runs."""
        status = "CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'failed' ELSE 'running' END"
        return self.events.selectExpr("event_id AS id", "user_id AS paper_id", "event_type", "pmod(user_id, 3) AS operation", f"{status} AS status", "value", "props", "ts")


#: The same role in SQL.
RUNS_SQL = """(SELECT event_id AS id, user_id AS paper_id, event_type, user_id % 3 AS operation,
  CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, value, props, ts FROM events)"""


def query(name: str, sql: str | None = None):
    """Registers a function of Tables as a query, with its SQL where there is one."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return register


def load() -> None:
    """Imports all modules that register queries."""
    from tessera.plans import code_queries, composite_queries, document_queries, further_queries, identity_queries, inventory_queries, relational_queries, search_queries, sequence_queries, source_queries, text_queries, vector_queries  # noqa: F401
