"""SQLite files as a data source."""

import sqlite3

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from tessera.sources import sqlite
from tessera.storage import new_path


@pytest.fixture
def runs(spark, tmp_path):
    for run, rows in (("2023", [(1, "a", 1.5, b"x"), (2, None, None, None), (300, "c", 2.0, b"")]), ("2024", [(3, "d", 1e300, b"\xff")])):
        (tmp_path / run).mkdir()
        with sqlite3.connect(tmp_path / run / "papers.db") as db:
            db.execute('CREATE TABLE papers (id INTEGER PRIMARY KEY, title TEXT, "a score" REAL, body BLOB' + (", more INT)" if run == "2024" else ")"))
            db.executemany(f"INSERT INTO papers VALUES (?, ?, ?, ?{', 9' if run == '2024' else ''})", rows)
            db.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, v) WITHOUT ROWID")
            db.executemany("INSERT INTO keyed VALUES (?, ?)", [("x", 5), ("y", "text")])
            if run == "2024":
                db.execute("CREATE TABLE late (n INT)")
                db.executemany("INSERT INTO late VALUES (?)", [(5,), ("many",), (2.5,), (None,), (2**40,)])
    return f"{tmp_path}/20*/papers.db"


def test_tables_of_all_files(spark, runs):
    df = sqlite.sqlite_table(spark, runs, "papers", rows=2)
    assert df.dtypes == [("id", "bigint"), ("title", "string"), ("a score", "double"), ("body", "binary"), ("more", "bigint"), ("run", "string")]
    got = sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect())
    assert got == [(1, "a", 1.5, b"x", None, "2023"), (2, None, None, None, None, "2023"), (3, "d", 1e300, b"\xff", 9, "2024"), (300, "c", 2.0, b"", None, "2023")]
    assert df.rdd.getNumPartitions() > 100  # ranges of two rowids each, of 1 to 300


def test_filters_and_columns(spark, runs):
    df = sqlite.sqlite_table(spark, runs, "papers", "id long, title string, run string")
    assert [r.id for r in df.filter("id >= 2 AND title IN ('c', 'd') AND run = '2024'").collect()] == [3]
    assert df.filter("title IS NULL").count() == 1 and df.groupBy("run").count().count() == 2
    reader = sqlite.Reader([], "papers", df.schema, 10)
    kept = list(reader.pushFilters([D.EqualTo(("id",), 3), D.In(("title",), ("c", "d")), D.EqualTo(("id",), "3"), D.EqualTo(("run",), "2024"), D.IsNull(("title",))]))
    assert len(kept) == 5 and [c[1:] for c in reader.conditions] == [('"id" = ?', [3]), ('"title" IN (?, ?)', ["c", "d"])]
    assert "2024" in df.filter("id = 3").first().run and "pushFilters" not in df._jdf.queryExecution().toString()


def test_values_of_other_types_and_missing_tables(spark, runs):
    assert sorted(r.n or 0 for r in sqlite.sqlite_table(spark, runs, "late").collect()) == [0, 0, 0, 5, 2**40]
    assert sorted(tuple(r)[:2] for r in sqlite.sqlite_table(spark, runs, "keyed").collect()) == [("x", "5")] * 2 + [("y", "text")] * 2
    with pytest.raises(Exception, match="no file of"):
        sqlite.sqlite_table(spark, runs, "nothing").count()


def test_round_trip(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("é'\""), "id")).alias("t"), (F.col("id") / 7).alias("x"))
    folder = new_path(spark)
    assert len(sqlite.write_sqlite(df.repartition(3), folder, "t")) == 3
    assert sorted(map(tuple, sqlite.sqlite_table(spark, f"{folder}/*/papers.db", "t", rows=50).drop("run").collect())) == sorted(map(tuple, df.collect()))
