import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.functions import hooks
from tessera.functions import text as X
from tessera.operators import code, documents, identity, relational, search, sequences, vectors


def value(spark, column, text, kind="string"):
    return spark.createDataFrame([(text,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_bm25_equals_sqlite(spark):
    rng = random.Random(5)
    words = ["spin", "phase", "lattice", "pi", "café", "monte", "carlo", "x_1"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(80)] + ["", "Monte-Carlo spin"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(content)")
    con.executemany("INSERT INTO t(rowid, content) VALUES (?, ?)", enumerate(texts, 1))
    units = spark.createDataFrame([(i, i % 7, t) for i, t in enumerate(texts, 1)], "unit_id long, paper_id long, content string")
    for query in ("spin", "cafe spin", "monte-carlo", "monte-carlo pi", "nothing"):
        match = " ".join(f'"{q}"' for q in query.split())
        want = dict(con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,)))
        got = {r.unit_id: r.rank for r in search.bm25(units, search.query_phrases(spark, query)).collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_split_query():
    assert search.split_query("monte carlo solver:phase_field doi:10.1/x") == ("monte carlo doi:10.1/x", [("solver", "phase field")])


def test_ranking_points(spark):
    papers = spark.createDataFrame([(1, "a", "Spin waves", "", 2000), (2, "b", "Other", "a spin", 2010), (3, "c", "None", "", None)], "paper_id long, paper_key string, title string, body string, year int")
    tags = spark.createDataFrame([(1, "magnets", "domain", "llm"), (2, "magnets", "domain", "user"), (3, "magnets", "domain", "user")], "paper_id long, name string, category string, source string")
    units = spark.createDataFrame([(i, 2, -1.0) for i in range(5)], "unit_id long, paper_id long, rank double")
    got = {r.paper_id: r.score for r in search.rank_papers(papers, tags, units, "spin", required=[("domain", "magnets")]).collect()}
    assert got == {1: 15, 2: 2 + 6 + 3 + 10, 3: 6 + 10}
    assert [r.paper_id for r in search.rank_papers(papers, tags, units, "spin", years=(1990, 2005)).collect()] == [1]
    assert search.rank_papers(papers, tags, units, "", excluded=[(None, "magnets")]).count() == 0


def test_folds_equal_plain_loops(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.randrange(0, 60)) for g in range(6) for i in range(rng.randrange(1, 25))]
    df = spark.createDataFrame(rows, "g int, i long, s int")
    packed = {(r.g, r.i): r.batch for r in sequences.pack_batches(df, "g", "i", F.col("s"), 100).collect()}
    filled = {(r.g, r.i) for r in sequences.fill_budget(df, "g", "i", F.col("s"), 100).collect()}
    for g in range(6):
        used, batch, budget = 0, 0, 0
        for _, i, s in sorted(r for r in rows if r[0] == g):
            if used and used + s > 100:
                used, batch = 0, batch + 1
            used += s
            assert packed[g, i] == batch
            assert ((g, i) in filled) == (budget + s <= 100)
            budget += s if budget + s <= 100 else 0


def test_active_and_supersede(spark):
    runs = spark.createDataFrame([(1, 7, "tag", "ok"), (2, 7, "tag", "failed"), (3, 7, "tag", "ok")], "id long, paper_id long, operation string, status string")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", 9)], "x string, run_id long")
    assert {r.x for r in relational.active(rows, runs).collect()} == {"a", "c"}
    assert {(r.id, r.is_active, r.supersedes_run_id) for r in relational.supersede(runs).collect()} == {(3, True, 1), (1, False, None)}
    with pytest.raises(ValueError):
        relational.merge_tags(rows, "x", "a", "a", ["x"])


def test_text_functions(spark):
    assert value(spark, X.normalize_doi, "https://doi.org/10.1000/ABC") == "10.1000/abc"
    assert value(spark, X.normalize_doi, "  ") is None
    assert value(spark, X.decode_latex, "M{\\\"u}ller and {\\'e}") == "Müller and é"
    assert value(spark, X.normalize_latex, "$$ E = m  c^2 (3.1) $$") == "E = m c^2"
    assert value(spark, X.equation_number, "E = m (3.1)") == "3.1"
    assert value(spark, X.json_in, 'x ```json\n{"a": 1}\n``` y') == '{"a": 1}'
    assert value(spark, X.safe_filename, " a/b: c ") == "a_b_c"
    assert value(spark, lambda c: X.paper_key(F.lit("Müller, Jan; B"), F.lit(None).cast("int"), c), "The Quantum of Solace") == "Mller_0000_Quantum"
    assert value(spark, lambda c: X.excerpt(c, 24), "Short. A longer text. It ends.") == "Short. A longer text ..."
    assert value(spark, lambda c: X.section(c, "## A\n", "## B"), "x\n## A\nin\n## B\nout") == "in\n"
    assert value(spark, X.rgb, "#ff0000") == [1.0, 0.0, 0.0]
    assert X.config_hash({"b": 1, "a": 2}) == X.config_hash({"a": 2, "b": 1})


def test_search_units(spark):
    md = "---\nx: 1\n---\n# Generated scientific summary\nfirst line of a summary text\n# Extracted source text\n# Intro\ntext long enough to be a paragraph\n## Methods\n$$\na = b\n$$\nmore text that is long enough\n"
    rows = [(r.unit_type, r.section_path, r.content) for r in documents.search_units(spark.createDataFrame([(1, md), (2, None), (3, "")], "id long, text string"), "id").orderBy("ordinal").collect()]
    assert ("summary", "", "first line of a summary text") in rows
    assert ("section", "Intro", "text long enough to be a paragraph") in rows
    assert ("equation", "Intro > Methods", "a = b") in rows
    assert ("method", "Intro > Methods", "more text that is long enough") in rows


def test_chunks_and_equations(spark):
    df = spark.createDataFrame([(1, "ab" * 1000), (2, ""), (3, None)], "id long, text string")
    assert [len(r.content) for r in documents.character_chunks(df, "id").orderBy("ordinal").collect()] == [1000, 1000, 400]
    eq = spark.createDataFrame([(1, "a $$x$$ b $y$ $$z\nw$$")], "id long, text string")
    assert [r.latex for r in documents.equations(eq, "id").orderBy("ordinal").collect()] == ["x", "z\nw", "y"]


def test_fuzzy_cascade_and_containment(spark):
    schema = "{} long, title string, authors string, year int"
    papers = spark.createDataFrame([(1, "Spin waves in thin films", "A. Bloch", 2001), (2, "Spin waves in thick films", "A. Bloch", 2001), (3, "Unrelated", None, None)], schema.format("paper_id"))
    probes = spark.createDataFrame([(9, "Spin wave in thin films", "A. Bloch", 2001), (8, "Nothing alike", "X", 1990)], schema.format("probe_id"))
    assert [(r.probe_id, r.paper_id) for r in identity.fuzzy_matches(probes, papers).collect()] == [(9, 1)]
    stems = spark.createDataFrame([("a" * 40,), ("b",), ("zz",)], "stem string")
    keys = spark.createDataFrame([("a" * 35, 1), ("b", 2), ("q", 3)], "key string, ordinal int")
    assert {(r.stem, r.match) for r in identity.by_containment(stems, keys).collect()} == {("a" * 40, "a" * 35), ("b", "b"), ("zz", None)}


def test_closure_is_whole_or_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(4)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "node long")
    with pytest.raises(RuntimeError):
        code.closure(edges, start, most_rounds=2)
    assert code.closure(edges, start, most_rounds=5).count() == 5 == code.closure(edges, start).count()


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (8, 9)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "node long")
    assert {(r.node, r.depth) for r in code.closure(edges, start).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert {tuple(r.path) for r in code.paths(edges, start, 9).collect()} == {(1,), (1, 2), (1, 2, 3), (1, 2, 3, 4)}


def test_code(spark):
    src = spark.createDataFrame([("a.py", "from m import f as g\nclass A(B):\n  def h(self): pass\n"), ("b.py", "not python (")], "path string, code string")
    assert {(r.kind, r.name, r.detail) for r in code.python_symbols(src).collect()} == {("import", "g", "m.f"), ("class", "A", "B"), ("method", "h", "self")}
    assert [tuple(h) for h in value(spark, code.cpp_headers, "int f(int a) {\n if (a) { }\n}\nvoid K::g() const {\n}")] == [("int", "f", "int a"), ("void", "K::g", "")]
    assert value(spark, code.includes, '#include <a>\n#include "b.h"\n') == ["b.h"]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    q = v.filter("vec_id = 1").withColumnRenamed("vec_id", "query_id")
    assert [r.vec_id for r in vectors.nearest(v, q, 2).orderBy(F.desc("score")).collect()] == [1, 3]
    assert [r.vec_id for r in vectors.nearest(v, q, 2, most_numbers=1).orderBy(F.desc("score")).collect()] == [1, 3]  # an answer, in blocks
    ring = vectors.ring(spark, 200)
    at = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    kernel = lambda dx, dy, dz: vectors.biot_savart(dx, dy, dz, F.col("jx"), F.col("jy"), F.col("jz"))
    assert math.isclose(vectors.pairwise_sums(at, ring, kernel, skip_self=False).first().bz, 200, rel_tol=1e-6)


def test_hooks(spark):
    def add(a: int, b: int = 2) -> int:
        """Adds."""
        return a + b

    assert hooks.register_tool(spark, add)["required"] == ["a"]
    assert spark.sql("SELECT add(1, 4)").first()[0] == 5
    assert hooks.call_tool(add, {"a": 1}) == 3
    with pytest.raises(TypeError):
        hooks.call_tool(add, {"a": "x"})
    rows = hooks.per_row(spark.createDataFrame([("1",), ("x",)], "t string"), "t", lambda t: str(1 / int(t))).collect()
    assert rows[0].result == "1.0" and rows[1].error.startswith("ValueError")
