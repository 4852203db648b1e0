import random
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import near_text, simhash
from tessera.llm._common import shared_dir, written
from tests.conftest import DATA
from tests.llm.test_llm import SCHEMA, hard_texts, word


def brute_groups(texts, limit=0.8):
    sets = [frozenset(near_text.shingles(t or "", 5)) for t in texts]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= limit * len(a | b):
                up[find(i)] = find(j)
    groups = {}
    for i in range(len(sets)):
        groups.setdefault(find(i), set()).add(i)
    return sorted(map(sorted, groups.values()))


def near_copies():
    """Chains and stars of copies with one to six changed words, around the limit."""
    rng = random.Random(12)
    out = hard_texts()
    for n in (30, 60, 120, 300):
        for _ in range(3):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            for k in range(12):
                copy = list(base)
                for _ in range(rng.randrange(1 + n // 30)):
                    copy[rng.randrange(n)] = f"new{rng.randrange(10**6)}"
                out.append(" ".join(copy))
                base = copy if k % 3 == 2 else base
    return out


@pytest.mark.parametrize("most_pairs, most", [(1e9, 256), (0.0, 256), (1e9, 3), (0.0, 3)])
def test_groups_are_those_of_all_pairs(spark, most_pairs, most):
    texts = near_copies()
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    rows = written(near_text.sets(docs, 5, 42))
    root = {r.a: r.b for r in near_text.links(docs, rows, 0.8, 5, 42, most_pairs=most_pairs, most=most).collect()}
    groups = {}
    for r in rows.select("doc_id", "c").collect():
        groups.setdefault(root.get(r.c, r.c), set()).add(r.doc_id)
    assert sorted(map(sorted, groups.values())) == brute_groups(texts)


def test_copies_are_the_rows_of_larger_groups(spark):
    texts = near_copies()
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in near_text.copies(docs).collect()) == sorted(i for g in brute_groups(texts) if len(g) > 1 for i in g)


def test_tables_of_past_rounds_are_deleted(spark):
    """Before, each round left its tables until the session ended; now the sets and the groups stay, which the result reads."""
    texts = near_copies()[:60]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    tables = lambda: set(Path(shared_dir(spark).removeprefix("file:")).glob("**/tessera-*"))
    before = tables()
    assert near_text.near_texts(docs).count() == len(texts) and len(tables() - before) == 2


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    for width, radius in ((1, 2), (1, 9), (4, 64), (2, 31)):
        base = rng.integers(0, 2**64, (1, width), np.uint64)
        values = np.repeat(base, 150, 0)
        for row in values:
            for bit in rng.integers(0, 64 * width, rng.integers(0, 2 * radius)):
                row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        ends = np.repeat([70, 150], [70, 80])
        far = [[sum(int(x ^ y).bit_count() for x, y in zip(a, b)) for b in values] for a in values]
        got = sorted((int(i), int(j)) for a, b in simhash.near_pairs(values, ends, radius, chunk=100) for i, j in zip(a, b))
        assert got == [(i, j) for i in range(150) for j in range(i + 1, ends[i]) if far[i][j] <= radius]


def test_common_passages_crowd_no_signature(spark):
    """Texts that share more than half of their words without being alike, and some pairs that are."""
    rng = random.Random(7)
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join(passage + [f"o{rng.randrange(10**6)}" for _ in range(30)]) for _ in range(400)]
    texts += [t.replace("p30 ", "q30 ") for t in texts[:20]]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], SCHEMA)
    groups = {}
    for r in near_text.near_texts(docs).collect():
        groups.setdefault(r.component, set()).add(r.doc_id)
    assert sorted(map(sorted, groups.values())) == brute_groups(texts)


def test_stage_drops_near_copies_of_ordinary_length(spark):
    """Copies with some changed words, which differ in more than 2 bits of a SimHash."""
    rng = random.Random(5)
    rows = []
    for g in range(10):
        words = [f"w{rng.randrange(9999)}" for _ in range(150)]
        rows.append((2 * g, " ".join(words), None, "s", 0))
        for at in (30, 90):
            words[at] = "changed"
        rows.append((2 * g + 1, " ".join(words), None, "s", 0))
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, SCHEMA), DATA).collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 20, 2))


def test_smoke_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter(F.length("text") > 200)
    ids, texts = zip(*sorted((r.doc_id, r.text) for r in docs.collect()))
    groups = {}
    for r in near_text.near_texts(docs).collect():
        groups.setdefault(r.component, set()).add(r.doc_id)
    assert sorted(map(sorted, groups.values())) == [[ids[i] for i in g] for g in brute_groups(texts)]


def test_one_row_of_each_group_stays_with_null_and_repeated_ids(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(9999)}" for _ in range(100)] for _ in range(4)]
    near = [" ".join(["other", *w[1:]]) for w in base]
    text = list(map(" ".join, base))
    rows = [(None, text[0]), (None, near[0]), (None, text[1]), (3, near[1]), (5, text[2]), (5, near[2]), (5, text[3]), (4, near[3])]
    rows = [(d, t, None, "s", 0) for d, t in rows]
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, SCHEMA), DATA).collect()
    groups = [{text[i], near[i]} for i in range(4)]
    assert sorted(i for r in kept for i in range(4) if r.text in groups[i]) == [0, 1, 2, 3]
    assert {r.doc_id for r in kept if r.text in groups[1] | groups[3]} == {3, 4}


def test_line_stage_removes_boilerplate_from_all_but_copies(spark):
    passage = " ".join(word(7, k) for k in range(80))
    page = "\n".join(" ".join(word(8, j, k) for k in range(40)) for j in range(2))
    own = [" ".join(word(i, k) for k in range(60)) for i in range(12)]
    rows = [(i, f"{passage}\n{own[i]}", None, f"s{i}", 0) for i in range(12)] + [(100 + i, page, None, f"s{i}", 0) for i in range(11)]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, spark.createDataFrame(rows, SCHEMA), DATA).collect()}
    assert all(got[100 + i] == page for i in range(11))  # copies, of which the next stage keeps one
    assert [got[i] for i in range(12)] == own
