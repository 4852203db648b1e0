"""Greedy batches and budgets of large groups against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import sequences

SCHEMA = "g long, o long, s long"


def packed(sizes, most):
    out, batch, used = [], 0, 0
    for s in sizes:
        if used > 0 and used + s > most:
            batch, used = batch + 1, 0
        used += s
        out.append(batch)
    return out


def filled(sizes, most):
    out, used = [], 0
    for i, s in enumerate(sizes):
        if used + s <= most:
            used += s
            out.append(i)
    return out


def groups(seed):
    rng = random.Random(seed)
    found = {None: [rng.randrange(9) for _ in range(40)], 1: [], 2: [100], 3: [0] * 30 + [99] + [0] * 5, 4: [0, 0, 50, 0, 60, 1]}
    found |= {g: [rng.choice([0, 1, 2, 5, rng.randrange(30), rng.randrange(60)]) for _ in range(rng.randrange(1, 200))] for g in range(5, 20)}
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_equal_the_fold(spark, monkeypatch, seed):
    """Blocks of eight rows, so that each group spans many; limits from less than an item to more than a group."""
    monkeypatch.setattr(sequences, "BLOCK_BITS", 3)
    found = groups(seed)
    df = spark.createDataFrame([(g, i, s) for g, sizes in found.items() for i, s in enumerate(sizes)], SCHEMA).repartition(5)
    for most in (17, 40) if seed == 1 else (1, 1000):
        got = sorted(((r.g or 0, r.o, r.batch) for r in sequences.pack_batches(df, "g", "o", F.col("s"), most, most_rows=3).collect()))
        assert got == sorted((g or 0, i, b) for g, sizes in found.items() for i, b in enumerate(packed(sizes, most)))
        got = sorted((r.g or 0, r.o) for r in sequences.fill_budget(df, "g", "o", F.col("s"), most, most_rows=3).collect())
        assert got == sorted((g or 0, i) for g, sizes in found.items() for i in filled(sizes, most))


@pytest.mark.parametrize("seed", range(300))
def test_a_block_from_any_beginning(seed):
    """The summary of a block and its batches, for all that an open batch can hold."""
    rng = random.Random(seed)
    sizes, most = [rng.choice([0, 0, 1, 3, rng.randrange(20)]) for _ in range(rng.randrange(1, 25))], rng.randrange(1, 25)
    import numpy as np

    fold = sequences._Fold(np.array(sizes), most)
    for used in range(0, most + 5):
        want = packed([used, *sizes], most)[1:] if used else packed(sizes, most)
        assert fold.batches(used, 0).tolist() == want


def test_one_group_of_millions(spark):
    n = 2_000_000
    df = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("o"), (F.col("id") * 7919 % 100).alias("s"))
    start = time.perf_counter()
    got = sequences.pack_batches(df, "g", "o", F.col("s"), 10_000).groupBy("batch").agg(F.min("o").alias("o")).orderBy("batch").collect()
    want = packed([i * 7919 % 100 for i in range(n)], 10_000)
    assert len(got) == want[-1] + 1 and all(want[r.o] == r.batch and (not r.o or want[r.o - 1] == r.batch - 1) for r in got)
    taken = sequences.fill_budget(df, "g", "o", F.col("s"), 24_000 * 4)
    assert sorted(r.o for r in taken.collect()) == filled([i * 7919 % 100 for i in range(n)], 24_000 * 4)
    assert time.perf_counter() - start < 200
