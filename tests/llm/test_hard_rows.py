"""Ties, repeated rows, very long texts and clashing names, operator by operator."""

import hashlib
import random
import time

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessera.llm import packing, quality, queries, secret_scan, simhash, suffix_dedup, token_counts
from tests.llm.test_llm import JSON, MODEL, SCHEMA, brute_figures, brute_repeats


def test_many_repeated_rows_take_linear_time(spark):
    rng = random.Random(1)
    text = " ".join(f"{rng.random()}" for _ in range(300))
    times = []
    for n in (500, 10_000):
        rows = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text"), F.lit(0).alias("gone"), F.lit("x").alias("data"))
        start = time.perf_counter()
        got = suffix_dedup.repeats(rows).collect()
        times.append(time.perf_counter() - start)
        assert len(got) == n and {r.n_removed for r in got} == {len(text)}
    assert times[1] < 20 * times[0] + 20


def test_anchors_in_many_contexts_are_anchored_again(spark):
    """A passage in more contexts than are compared at once, at all levels."""
    rng = random.Random(2)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(70))  # over 400 bytes
    short = passage[:380]
    texts = [f"{rng.random()} " * 8 + (passage if i % 3 else short) + f" {rng.random()}" * 8 for i in range(90)]
    texts += [texts[1][:600], texts[1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (1000, 5):
        got = sorted(tuple(r) for r in suffix_dedup.repeats(df, most=most, shard_rows=50).collect())
        assert got == [(i, *r) for i, r in enumerate(brute_repeats(texts, 400))]


def test_windows_that_share_the_bits_beside_their_places(spark):
    """Different windows whose hashes differ in the bits only that positions replace."""
    base = [1 << 40, (1 << 40) + 1, 1 << 40, (1 << 40) + 1, 5 << 50, (1 << 40) + 2, 1 << 40]
    rows = spark.createDataFrame([(base,), ([7, 8, 9],), ([],), ([3 << 20] * 6,)], "_h array<long>")

    def plain(h):
        return len({j for i in range(len(h)) if h.count(h[i]) > 1 for j in (i, i + 1, i + 2)})

    assert [r.n_repeat_words for r in quality.with_repeats(rows).collect()] == [plain(r._h) for r in rows.collect()]


def test_quality_counts_documents_and_repeated_rows_once(spark):
    line = "menu of the site with all its entries here and there"
    own = ["\n".join(" ".join(f"{chr(97 + i)}{chr(97 + j)}{chr(97 + k)}word" for k in range(12)) for j in range(6)) for i in range(20)]
    rows = [(i, f"{own[i]}\n{line}" if i < 8 else own[i], "en", "h", 0) for i in range(20)]
    again = rows + rows[:3] * 4
    df = spark.createDataFrame(again, SCHEMA).withColumn("host", F.lit(1)).withColumn("t", F.lit(2)).withColumn("lost", F.lit(3))
    got = quality.quality_rules(df).collect()
    assert all(r.kept and line not in r.clean_text and r.host == 1 and r.lost == 3 for r in got) and len(got) == len(again)
    copies = spark.createDataFrame([(i, own[0], "en", "h", 0) for i in range(7)] + [(100 + i, own[i], "en", "h", 0) for i in range(1, 20)], SCHEMA)
    kept = {r.doc_id: r.kept for r in quality.quality_rules(copies).collect()}
    assert not any(kept[i] for i in range(7)) and all(kept[100 + i] for i in range(1, 20))
    assert [brute_figures(own[0])[0]] == [72]


def test_long_unbroken_texts_count_as_the_library_counts(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(4)
    pieces = [sp.id_to_piece(i).replace("▁", "") for i in range(300, sp.get_piece_size())]
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000)), "".join(rng.choice("ab=-1é漢😀") for _ in range(20_000)), "=" * 9000 + "-" * 9000]
    texts += ["".join(rng.choice(pieces) for _ in range(3000)), "x" * 257, "the" * 4000 + " " + "ing" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(df, MODEL).collect()} == {i: len(sp.encode(t)) for i, t in enumerate(texts)}


def test_unbroken_texts_take_linear_time():
    m = token_counts.Merger(MODEL)
    rng = random.Random(6)
    times = []
    for n in (100_000, 800_000):
        text = "".join(rng.choice("abcdefghij") for _ in range(n))
        start = time.perf_counter()
        m.count_texts([text], {"": 0})
        times.append(time.perf_counter() - start)
    assert times[1] < 8 * 2.5 * times[0] + 1


@pytest.mark.parametrize("operator", [secret_scan.secret_scan, lambda d: packing.pack(d, JSON), simhash.near_duplicates, suffix_dedup.repeats])
def test_other_columns_are_not_read(spark, operator):
    df = spark.createDataFrame([(1, "token = abcdef1234 " * 40, "x"), (None, None, "y"), (1, "token = abcdef1234 " * 40, "z")], "doc_id long, text string, k string")
    clash = df.withColumns({c: F.lit("clash") for c in ("fp", "t", "data", "first", "n", "shard", "length", "spans", "component_id", "c", "sh", "h")})
    plain = lambda d: sorted(map(repr, (tuple(r) for r in operator(d).collect())))
    assert plain(clash) == plain(df)


def test_removed_bytes_are_those_of_the_text():
    assert suffix_dedup.kept_bytes(b"abcdef", [(1, 2), (4, 6)]) == b"acd" and hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def test_many_base_spans_in_a_text_take_linear_time():
    from tessera.llm import secret_model

    model = secret_model.trained(500, 7, recall=0.99)
    times = []
    for n in (5_000, 50_000):
        text = "\n".join(f"password = value{i:06} and AKIA{i:016}" for i in range(n))
        start = time.perf_counter()
        secret_scan.scan_texts([text], model)
        times.append(time.perf_counter() - start)
    assert times[1] < 25 * times[0] + 5


def test_repeats_leave_the_texts_that_are_kept(spark, tmp_path):
    """Also where a removed run begins and ends inside a character, and where nothing or all is removed."""
    passage = "è" + "".join(f"p{i}é" for i in range(110)) + "ĩ"  # the second bytes of è and Ȩ, and the first ones of ĩ and Ĩ, are equal
    texts = [f"one {passage} end", f"other Ȩ{passage[1:-1]}Ĩ here", "alone " * 20, passage[5:] + "x" * 500, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    data = [(t or "").encode() for t in texts]
    got = sorted(suffix_dedup.without_repeats(df).collect())
    for r, x in zip(got, data, strict=True):
        assert bytes(r.kept) == suffix_dedup.kept_bytes(x, [tuple(s) for s in r.spans])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(queries.op10_suffix_dedup(spark, str(tmp_path)).collect())
    assert [tuple(r)[:5] for r in rows] == [(i, *r) for i, r in enumerate(brute_repeats([t or "" for t in texts], 400))]
    assert [r.clean_text for r in rows] == [bytes(r.kept).decode(errors="replace") for r in got]
    assert len(rows[0].clean_text) < 20 and "\ufffd" in rows[0].clean_text and rows[2].clean_text == texts[2] and rows[4].clean_text == ""


def brute_passages(rows, words):
    holders = {}
    split = [(doc, (t or "").encode().split()) for doc, t in rows]
    for doc, w in split:
        for i in range(len(w) - words + 1):
            holders.setdefault(tuple(w[i : i + words]), set()).add(doc)
    found = [[i for i in range(len(w) - words + 1) if len(holders[tuple(w[i : i + words])]) > 1] for _, w in split]
    return [suffix_dedup.spans([(i, i) for i in starts], words) for starts in found]


@pytest.mark.parametrize("most", [1000, 3])
def test_passages_of_over_50_words_are_found_across_documents(spark, tmp_path, most):
    """Also shorter than 400 bytes, with other white space, at a text's ends, in many contexts; not 50 words, and not within one document."""
    rng = random.Random(5)
    new = lambda n: [f"w{rng.randrange(10**4)}" for _ in range(n)]
    passage, line, common = new(53), new(50), new(60)
    texts = [" ".join([*new(30), *passage, *new(30)]), "\n".join(passage), " ".join([*passage[:52], *new(9), *passage[1:]]), " \t".join([*new(5), *passage[2:], *new(3)])]
    texts += [" ".join(new(20) + line + new(20)) for _ in range(2)] + [" ".join([*(own := new(70)), "and", *own]), None, "", " ".join(["a"] * 60), " ".join(["a"] * 55)]
    texts += [" ".join([*new(i % 7), *common[i % 11 :], *new(9)]) for i in range(40)] + ["x" * 3000 + " " + " ".join(passage) + "é"]
    rows = [*enumerate(texts), (1, texts[1]), (6, texts[6])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, [tuple(x) for x in r.passages]) for r in suffix_dedup.without_repeats(df, words=51, most=most, shard_rows=20).collect())
    assert got == sorted((doc, p) for (doc, _), p in zip(rows, brute_passages(rows, 51), strict=True))
    assert [len(dict(got)[i]) for i in range(11)] == [1, 1, 2, 1, 0, 0, 0, 0, 0, 1, 1]
    df.write.parquet(f"{tmp_path}/documents.parquet")
    figures = {r.doc_id: (r.n_removed, r.n_passages, r.n_passage_words) for r in queries.op10_suffix_dedup(spark, str(tmp_path)).collect()}
    assert figures[0] == (0, 1, 53) and figures[3] == (0, 1, 51) and figures[4] == (0, 0, 0) and figures[6][1:] == (0, 0) and figures[7] == (0, 0, 0)


def test_words_are_hashed_in_blocks(monkeypatch):
    rng = random.Random(4)
    data = "".join(rng.choice(["ab", "c", "é", " ", "\n", "x" * 300]) for _ in range(9000)).encode()
    whole = suffix_dedup.word_segments(data, 51, 16)
    starts, ends = suffix_dedup.word_places(data)
    assert [data[a:b] for a, b in zip(starts, ends, strict=True)] == data.split()
    assert sorted(x for _, _, f, n, _, _ in whole.tolist() for x in range(f, f + n)) == list(range(len(starts) - 50))
    assert all(data[c : c + z].split() == data.split()[f : f + n + 50] for _, _, f, n, c, z in whole.tolist())
    monkeypatch.setattr(suffix_dedup, "BLOCK", 500)
    hashes = suffix_dedup.word_hashes(data, starts, ends)
    by_word = {}
    assert all(by_word.setdefault(w, h) == h for w, h in zip(data.split(), hashes.tolist(), strict=True)) and len(set(by_word.values())) == len(by_word)
    parts = suffix_dedup.word_segments(data, 51, 16)
    assert sorted(x for _, _, f, n, _, _ in parts.tolist() for x in range(f, f + n)) == list(range(len(starts) - 50))


def test_order_of_more_symbols_than_16_bits_hold():
    words = [f"{i}".encode() for i in range(70_000)]
    ids = np.arange(3)
    found = suffix_dedup.shared_starts([words, words[100:60_000] + words[:60], words[69_930:]], ids, ids, 51)
    assert [int(f.sum()) for f in found] == [59_850 + 10 + 20, 59_850 + 10, 20]
