"""Tables of SQLite files as a data source (SRC06, SRC07), and a writer of such files.

`spark.read.format("sqlite_table").option("path", glob).option("table", name)` reads a table of one or many files. A file is cut
by ranges of rowids, a range is a task; filters are tried in SQLite first and again by Spark, and a given schema says which columns
are read at all. The files lie in a folder that the driver and all executors see, as SQLite itself opens them.

Without a schema it is that of all files: INTEGER is long, REAL double, BLOB binary, all else string; a column that a file lacks
is null there. SQLite may keep any value in any column: one that can't be read as the column's type is null. `run` is the name of
the folder that a file lies in. A table that no file has is an error, one that some lack has no rows of theirs.
"""

from __future__ import annotations

import glob
import os
import re
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

COMPARISONS = {D.EqualTo: "=", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    """A file as it is: nothing is created or changed."""
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def columns_of(db: sqlite3.Connection, table: str) -> dict[str, str]:
    return {name: kind.upper() for _, name, kind, *_ in db.execute(f"PRAGMA table_info({quoted(table)})")}


def type_of(declared: str):
    return LongType() if "INT" in declared else DoubleType() if re.search("REAL|FLOA|DOUB", declared) else BinaryType() if "BLOB" in declared else StringType()


def as_type(value, kind):
    """A stored value as a column's type, or None."""
    if value is None:
        return None
    try:
        if isinstance(kind, LongType | IntegerType | BooleanType):
            n = int(value)
            return None if isinstance(value, float) and n != value else bool(n) if isinstance(kind, BooleanType) else n
        if isinstance(kind, DoubleType):
            return float(value)
    except (ValueError, OverflowError):
        return None
    if isinstance(kind, BinaryType):
        return value if isinstance(value, bytes) else str(value).encode()
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)


@dataclass
class Range(D.InputPartition):
    path: str
    low: int | None
    high: int | None


@dataclass
class Reader(D.DataSourceReader):
    paths: list[str]
    table: str
    schema: StructType
    rows: int
    conditions: list[tuple[str, str, list]] = field(default_factory=list)

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        """Takes comparisons of a column with values of its own type as SQL; Spark tests all filters again."""
        kinds = {f.name: f.dataType for f in self.schema}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind = kinds.get(column)
            plain = lambda v, kind=kind: isinstance(v, int) and isinstance(kind, LongType | IntegerType) and not isinstance(v, bool) or isinstance(v, str) and isinstance(kind, StringType)
            if column == "run" or kind is None:
                pass
            elif type(f) in COMPARISONS and plain(f.value):
                self.conditions.append((column, f"{quoted(column)} {COMPARISONS[type(f)]} ?", [f.value]))
            elif isinstance(f, D.In) and f.value and len(f.value) <= 500 and all(map(plain, f.value)):
                self.conditions.append((column, f"{quoted(column)} IN ({', '.join('?' * len(f.value))})", list(f.value)))
            yield f

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            with opened(path) as db:
                if not columns_of(db, self.table):
                    continue
                try:
                    low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
                except sqlite3.OperationalError:  # a table without rowids
                    out.append(Range(path, None, None))
                    continue
            out += [Range(path, at, min(at + self.rows - 1, high)) for at in range(low, high + 1, self.rows)] if low is not None else []
        return out or [Range("", None, None)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with opened(partition.path) as db:
            there = columns_of(db, self.table)
            wanted = [f.name for f in self.schema if f.name in there]
            where, values = ([f"rowid BETWEEN {partition.low} AND {partition.high}"] if partition.low is not None else []), []
            for column, sql, v in self.conditions:
                if column in there and isinstance(next(f.dataType for f in self.schema if f.name == column), type(type_of(there[column]))):
                    where.append(sql)
                    values += v
            cursor = db.execute(f"SELECT {', '.join(map(quoted, wanted)) or '1'} FROM {quoted(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else ""), values)
            run = os.path.basename(os.path.dirname(partition.path))
            while rows := cursor.fetchmany(4096):
                found = dict(zip(wanted, zip(*rows, strict=True), strict=False))
                data = [[run] * len(rows) if f.name == "run" and "run" not in there else [as_type(v, f.dataType) for v in found.get(f.name, [None] * len(rows))] for f in self.schema]
                yield pa.RecordBatch.from_arrays([pa.array(c, _arrow(f.dataType)) for c, f in zip(data, self.schema, strict=True)], names=self.schema.names)


def _arrow(kind) -> pa.DataType:
    return {LongType: pa.int64(), IntegerType: pa.int32(), DoubleType: pa.float64(), BinaryType: pa.binary(), BooleanType: pa.bool_()}.get(type(kind), pa.string())


class SqliteTable(D.DataSource):
    """Options: path (a glob), table, rows (rowids of a task, 100,000 by default)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def _paths(self) -> list[str]:
        return sorted(glob.glob(self.options["path"].removeprefix("file://").removeprefix("file:")))

    def schema(self) -> StructType:
        found: dict[str, str] = {}
        for path in self._paths():
            with opened(path) as db:
                found = columns_of(db, self.options["table"]) | found
        if not found:
            raise ValueError(f"no file of {self.options['path']} has a table {self.options['table']}")
        more = [] if "run" in found else [StructField("run", StringType())]
        return StructType([StructField(name, type_of(kind)) for name, kind in found.items()] + more)

    def reader(self, schema: StructType) -> Reader:
        return Reader(self._paths(), self.options["table"], schema, int(self.options.get("rows", 100_000)))


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str | None = None, rows: int = 100_000) -> DataFrame:
    """SRC06, SRC07: a table of all SQLite files that a glob names."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteTable)
    reader = spark.read.format("sqlite_table").option("path", path).option("table", table).option("rows", rows)
    return (reader.schema(schema) if schema else reader).load()


def write_sqlite(df: DataFrame, folder: str, table: str) -> list[str]:
    """A SQLite file per task, <folder>/<number>/papers.db; a file appears whole, and again if its task is repeated. Returns the paths."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "binary": "BLOB"}
    names, head = df.columns, ", ".join(f"{quoted(c)} {kinds.get(k, 'TEXT')}" for c, k in df.dtypes)
    to = folder.removeprefix("file://").removeprefix("file:")

    def store(batches):
        from pyspark import TaskContext

        path = f"{to}/{TaskContext.get().partitionId():05}/papers.db"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with tempfile.TemporaryDirectory() as own:
            db = sqlite3.connect(f"{own}/papers.db")
            db.execute(f"CREATE TABLE {quoted(table)} ({head})")
            for b in batches:
                db.executemany(f"INSERT INTO {quoted(table)} VALUES ({', '.join('?' * len(names))})", zip(*(c.to_pylist() for c in b.columns), strict=True))
            db.commit()
            db.close()
            with open(f"{own}/papers.db", "rb") as f, open(once := f"{path}.{uuid.uuid4().hex}", "wb") as g:
                while part := f.read(1 << 20):
                    g.write(part)
        os.replace(once, path)
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    return sorted(r.path for r in df.mapInArrow(store, "path string").collect())  # a row per file
