"""The prefix trie against a plain version."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import prefix_trie, queries
from tests.conftest import DATA

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own, members, ends, below = defaultdict(list), defaultdict(list), defaultdict(list), defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        turns = tuple(said.get(base, [])[:h] + said[c][h:])
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for n in members:
        if n:
            below[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in below[n]) or 1
        saved[n] = sum(saved[k] for k in below[n]) + ((len(members[n]) - 1) * len(n[-1][1]) if n else 0)
    digest = lambda n: hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(below[n]), leaves[n], saved[n], digest(n)) for n, m in members.items()), key=repr)


def got(df):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df).collect()), key=repr)


def test_smoke_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op11_prefix_trie(spark, DATA).collect()), key=repr) == plain(rows)


def hard_rows():
    rng = random.Random(5)
    rows = [(None, 0, "user", "no conversation"), (None, None, None, None), (7, None, None, None), (7, None, "user", ""), (7, 3, "user", "é😀"), (7, 3, "assistant", "tie"), (7, 3, "user", "é😀"), (-5, 1, "user", "below zero"), (-105, 1, "user", "below zero"), (-100, 0, "user", "below zero")]
    rows += [(c, t, "user" if t % 2 else "system", f"turn {t} {'x' * t}") for c in range(300, 330) for t in range(8)]  # copies
    rows += [(c, t, "user", rng.choice("ab")) for c in range(400, 460) for t in range(rng.randrange(1, 12))]
    rows += [(c, 9, "user", "only turn") for c in range(1000, 1040)]  # conversations that lose their turns
    rng.shuffle(rows)
    return rows


def test_hard_rows(spark):
    rows = hard_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("conv", "depth", "part", "rank", "p1", "path", "len")})
    assert got(df) == plain(rows)


def test_sums_by_blocks(spark, monkeypatch):
    """Running sums and digests whose blocks hold three turns or conversations."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = hard_rows()
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_a_branch_at_every_turn_takes_few_rounds(spark, monkeypatch):
    """One conversation of 60 turns and one that leaves it at each of them."""
    rows = [(c, t, "user", f"t{t}" if t < c or c == 99 else f"other {c}") for c in range(6, 66) for t in range(c + 1)]
    rounds = []
    monkeypatch.setattr(prefix_trie, "written", lambda df, f=prefix_trie.written: rounds.append("open" in df.columns) or f(df))
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    assert sum(rounds) <= 15


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")]])
def test_no_conversation(spark, rows):
    assert got(spark.createDataFrame(rows, SCHEMA)) == []
