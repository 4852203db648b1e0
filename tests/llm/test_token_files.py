"""Files of token ids against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import queries, token_files
from tessera.storage import new_path
from tests.conftest import DATA
from tests.llm.test_llm import hard_texts

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def plain(rows, json_path, end_id):
    """Texts go to the library whole; order among equal ids is left open."""
    library, start, out = Tokenizer.from_file(json_path), 0, []
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def read(spark, path):
    return [tuple(r) for r in token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids")).orderBy("start").collect()]


def test_smoke_table(spark):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    assert [tuple(r) for r in queries.op12_token_files(spark, DATA).orderBy("start").collect()] == plain(rows, WORDS, 2)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1))))
def test_blocks_come_back(numbers):
    assert token_files.decode(token_files.encode(np.array(numbers, "<u4"))).tolist() == numbers


def test_bytes_of_a_block():
    """Two bits a number, the first in the lowest; then the data bytes, least first."""
    assert token_files.encode(np.array([1, 0x203, 0x40506, 0x708090A, 255], "<u4"))[12:] == bytes([0b11100100, 0, 1, 3, 2, 6, 5, 4, 10, 9, 8, 7, 255])


def test_damaged_blocks_are_refused():
    payload = bytearray(token_files.encode(np.arange(1000, dtype="<u4")))
    payload[500] ^= 1
    for bad in (bytes(payload), b"", b"TID1", bytes(payload[:40])):
        with pytest.raises(ValueError, match="damaged"):
            token_files.decode(bad)


@pytest.mark.parametrize("json_path,runs", [(WORDS, True), (BYTES, False)])
def test_hard_rows(spark, json_path, runs):
    texts = [*hard_texts(), "a<|endoftext|>b <|startoftext|>", "É ́x ΑΣ ΣΑΣ Σ​ it's 12  \x85\x1c'S", "z" * 300 + " " + "😀" * 90]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("ids", "row", "hash", "file", "start")})
    token_files.write_token_files(df, path := new_path(spark), json_path, 2, runs)
    assert read(spark, path) == plain(rows, json_path, 2)


def test_repeated_and_missing_ids(spark):
    rows = [(None, "no id")] * 3 + [(None, "another")] + [(5, "same")] * 40 + [(5, "b"), (4, None), (6, "")]
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path := new_path(spark), WORDS, 2)
    found = read(spark, path)
    assert [r[0] for r in found] == [None] * 4 + [4] + [5] * 41 + [6]
    assert [r[1] for r in found] == np.cumsum([0, *(r[2] for r in found)])[:-1].tolist()
    assert sorted((r[0] or 0, r[2], r[3]) for r in found) == sorted((r[0] or 0, r[2], r[3]) for r in plain(rows, WORDS, 2))


def test_many_blocks_and_a_short_memory(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 50)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["spin", "wave", f"w{rng.randrange(50)}", "y" * 70]) for _ in range(rng.randrange(40)))) for i in range(200)]
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path := new_path(spark), WORDS, 2)
    assert read(spark, path) == plain(rows, WORDS, 2)
    monkeypatch.setattr(token_files, "REMEMBERED", 5)
    encoder = token_files.Encoder(WORDS, "<u2", True)
    assert [encoder(t) for _, t in rows] == [encoder.whole(t) for _, t in rows] and len(encoder.known) <= 5


def test_words_are_cut_as_the_library_cuts():
    """Runs of all plain characters, beside each other in many ways."""
    rng = random.Random(9)
    plain = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x180))]
    encoder = token_files.Encoder(WORDS, "<u2", True)
    runs = [*plain, *(a + b for a in plain for b in "a'1.Äß¼İ\xad" for a, b in ((a, b), (b, a)))]
    runs += ["".join(rng.choice(plain if rng.random() < 0.5 else "the'sreVEmlLd0") for _ in range(rng.randrange(1, 12))) for _ in range(20_000)]
    runs += ["it's", "'sun", "''s", "x'S", ".'ll", "<|endoftext|>", "a<|startoftext|>b", "<|", "ﬁ", "É", "ǅ"]
    assert [encoder.run(r.encode()) for r in runs] == [encoder.whole(r) for r in runs]


def test_frequent_ids_are_small_numbers(spark):
    df = spark.createDataFrame([(1, "b b b b a a a c")], "doc_id long, text string")
    token_files.write_token_files(df, path := new_path(spark), WORDS, 2)
    library = Tokenizer.from_file(WORDS)
    a, b, c = (library.encode(x, add_special_tokens=False).ids[0] for x in "abc")
    assert [r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()] == [b, a, *sorted([2, c])]


def test_no_documents(spark):
    token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), path := new_path(spark), WORDS, 2)
    assert read(spark, path) == []
