import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.api import PaperBase
from tessera.sources import readers, writers
from tessera.streaming.sync import sync


def test_bibtex(spark):
    text = '@article{k1, title = {The {Big} {\\"O}}, author = "A and B", year = 20x, doi={https://doi.org/10.1/A}}\n@comment{x}\n@book{k2, title={B}, year=1999}'
    rows = readers.bibtex(spark.createDataFrame([("p", text), ("q", None)], "path string, text string")).orderBy("ordinal").collect()
    assert [(r.entry_id, r.title, r.authors, r.year, r.doi) for r in rows] == [("k1", "The Big Ö", "A; B", None, "10.1/a"), ("k2", "B", None, 1999, None)]


def test_text_readers(spark, tmp_path):
    (tmp_path / "a.dat").write_text("1 2 0.5 x\n3\n\n# c\n7 8 9.5 gone\n")
    assert [(r.i0, r.i1, r.name) for r in readers.dat(spark, str(tmp_path / "a.dat"), 2, 1, ["gone"]).orderBy("i0").collect()] == [(1, 2, "x"), (3, -1, None)]
    (tmp_path / "m.xyz").write_text("2\nwater\nH 0 0 0\nO 1 0 0.5\n")
    assert [(r.atom, r.symbol, r.z) for r in readers.xyz(spark, str(tmp_path / "m.xyz")).orderBy("atom").collect()] == [(0, "H", 0.0), (1, "O", 0.5)]
    (tmp_path / "g.txt").write_text("1 2\n3 4\n\n5 6\n")
    assert [(r.block, r.row, r["values"]) for r in readers.gnuplot_grid(spark, str(tmp_path / "g.txt")).orderBy("block", "row").collect()] == [(0, 0, [1.0, 2.0]), (0, 1, [3.0, 4.0]), (1, 0, [5.0, 6.0])]
    (tmp_path / "log").write_text("h1|me|2020|fix a|b\nbroken\n")
    assert [tuple(r) for r in readers.git_log(spark, str(tmp_path / "log")).collect()] == [("h1", "me", "2020", "fix a|b")]
    (tmp_path / "tags").write_text('{"_type":"tag","name":"f","path":"a.cpp","kind":"function","scope":"K","scopeKind":"class"}\nnot json\n{"_type":"tag","name":"__anon1"}\n')
    assert [tuple(r) for r in readers.members_by_class(readers.ctags(spark, str(tmp_path / "tags"))).collect()] == [("K", "f", "")]


def test_writers(spark, tmp_path):
    writers.write_table(spark.createDataFrame([("a", None)], "x string, y string"), str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).first().x == "a"
    with pytest.raises(Exception, match="empty content"):
        writers.non_empty(spark.createDataFrame([("",)], "x string"), "x").collect()


def test_arxiv(spark):
    xml = "<feed><entry><id>http://arxiv.org/abs/1234.5678v2</id><published>2012-01-01</published><title>A\n b</title><summary>s</summary><author><name>X Y</name></author></entry></feed>"
    r = spark.createDataFrame([(xml,)], "x string").select(readers.arxiv(F.col("x")).alias("a")).first().a
    assert (r.title, r.year, r.arxiv_id, r.authors) == ("A b", 2012, "1234.5678", "X Y")


def test_knowledge_base(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "one.md").write_text("# Spin waves\n\nA text on spin waves in thin films, 2004.\n\n$$E = m c^2 (1)$$\n")
    (tmp_path / "docs" / "two.md").write_text("# Phase field\n\nA text on the phase field method for spin glasses.\n")
    base = PaperBase(spark, str(tmp_path / "kb"))
    assert {r.outcome for r in base.ingest_folder(str(tmp_path / "docs")).collect()} == {"created"}
    assert {r.outcome for r in base.scan_folder(str(tmp_path / "docs")).collect()} == {"existing_path"}
    found = {r.title: r.paper_id for r in base.search("spin").collect()}
    assert set(found) == {"Spin waves", "Phase field"}
    base.add_user_tags(found["Spin waves"], ["domain:magnets", "todo"])
    base.add_user_tags(found["Phase field"], ["domain:magnet"])
    assert [r.title for r in base.search("spin domain:magnets").collect()] == ["Spin waves"]
    ids = {r.canonical_name: r.id for r in base.list_tags().collect()}
    base.merge_tags(ids["magnets"], ids["magnet"])
    assert base.search("spin domain:magnets").count() == 2
    assert base.resolve_tag("magnet").first().canonical_name == "magnets"
    assert base.get_related(found["Spin waves"]).first().paper_id == found["Phase field"]
    assert base.get_equations(found["Spin waves"]).first().latex_normalized == "E = m c^2"
    assert base.retrieve_context("spin", 1000).count() > 0
    assert base.find_missing("bibtex").count() == 2
    assert base.build_topic("spins", "spin").count() == 2
    assert base.tables.violations().filter("n > 0").count() == 0
    assert {r.metric: r.n for r in base.status().collect()}["papers"] == 2
    assert cli.main([str(tmp_path / "kb"), "search", "spin", "--limit", "1"], spark).count() == 1
    assert cli.year_range("2015-2020") == (2015, 2020)


def test_sync(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    sync(*args).awaitTermination()
    (tmp_path / "in" / "b.txt").write_text("one")
    (tmp_path / "in" / "c.txt").write_text("two")
    sync(*args).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["one", "two"]
