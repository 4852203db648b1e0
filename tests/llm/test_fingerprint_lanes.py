"""Fingerprints and likenesses against exact multisets, and documents in order, on hard tables."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import fingerprints
from tests.conftest import DATA


def clauses(text):
    return Counter(re.findall(r"(?:[^ \n]{1,40}+ ?+){1,5}+", text))


def exact(a, b):
    x, y = clauses(a), clauses(b)
    if x == y and Counter(a.split("\n")) == Counter(b.split("\n")):
        return 1.0
    total = sum(v * v for v in x.values()) + sum(v * v for v in y.values())
    return 2 * sum(v * y[k] for k, v in x.items()) / total if total else 0.0


def test_long_repetitive_texts(spark):
    line = "the same line again\n"
    texts = [line * 20_000, line * 15_000, line * 20_000 + "more\n" * 3, "other words in here\n" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprint_report(df).collect()}
    for i, t in enumerate(texts):
        n = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edit = t[: len(t) - half] + n[:half]
        assert abs(got[i].near_next - exact(t, n)) < 0.25 and abs(got[i].near_edited - exact(t, edit)) < 0.25
    assert got[0].near_next > 0.9 and got[3].near_next < 0.3


def test_likeness_is_that_of_the_multisets(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in df.collect())
    got = {r.doc_id: r for r in fingerprints.fingerprint_report(df).collect()}
    off = []
    for i, (d, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        off += [abs(got[d].near_next - exact(t, n)), abs(got[d].near_edited - exact(t, t[: len(t) - half] + n[:half]))]
    assert sum(off) / len(off) < 0.07 and max(off) < 0.4


def test_insertion_and_deletion_beyond_small_lanes(spark):
    df = spark.createDataFrame([("a b\n" * 40_000, "c d\n" * 30_000)], "x string, y string")
    x, y = (fingerprints.fingerprint(F.concat(F.col(c), F.lit("z"))) for c in "xy")
    both = fingerprints.fingerprint(F.concat("x", F.lit("z\n"), "y", F.lit("z")))
    r = df.select(both.alias("both"), fingerprints.insert(x, F.concat("y", F.lit("z"))).alias("grown"), fingerprints.delete(both, F.concat("x", F.lit("z"))).alias("cut"), y.alias("y")).first()
    assert r.both == r.grown and r.cut == r.y


def test_followers_of_hot_and_missing_ids(spark):
    rng = random.Random(5)
    ids = [None] * 300 + [7] * 300 + [rng.randrange(10_000) for _ in range(300)]
    rows = [(d, f"text {i}") for i, d in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", F.lit("x"))
    for buckets in (1, 7, 40):
        seated = fingerprints.with_next(df, buckets).filter("NOT guest").collect()
        assert Counter(r.text for r in seated) == Counter(t for _, t in rows)
        follower = {r.text: r.next_text for r in seated}
        assert Counter(follower.values()) == Counter(follower.keys())  # one cycle
        at, seen = "text 0", set()
        while at not in seen:
            seen.add(at)
            at = follower[at]
        assert len(seen) == len(rows)
        id_of = {t: d for d, t in rows}
        steps = [(id_of[a], id_of[b]) for a, b in follower.items()]
        key = lambda d: (d is None, d or 0)
        assert sum(key(a) > key(b) for a, b in steps) == 1  # only the last one goes back
        sizes = Counter(r.range for r in seated)
        assert buckets == 1 or max(sizes.values()) <= 4 * 900 / buckets + 20
