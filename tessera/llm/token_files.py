"""Token ids in binary files: ids ranked by frequency, in variable-length bytes with the control bytes apart.

A corpus is tokenized once, its ids are counted, and each id is written as its rank, so that frequent ids are small numbers. A
number takes one to four bytes; two bits say how many, four of these make a control byte, and the control bytes of a block
stand before all its data bytes. So a block is decoded without a loop: the control bytes look up the lengths in a table of 256
rows, their running sums are the places, and four bytes from each place, masked by length, are the number.

A written corpus is a folder of two Parquet tables in any store that Spark reads. `ids` holds blocks: file and block number,
the ids before the block in its file, the documents' ids and lengths, and a payload of its own format (magic, number of
ids, CRC-32 of the rest, control bytes, data bytes), which is checked when it is read. `ranks` holds the id of each rank; both
are bounded by the vocabulary. A file is a range of doc_id in ascending order; the ids before a file are summed over the files.

The tokenizer is asked once for each distinct run of characters between white space (ASCII's): its pre-tokenizer removes
white space and its normalizer doesn't look beyond it, so a text's ids are those of its runs. A run of plain Latin characters
is cut into words by the pre-tokenizer's own pattern, and only the library's merges are asked, for each distinct word; all
other runs go through the whole library. Workers remember runs and words up to a bound. This holds for the vocabulary
`word_bpe_49k.json`; pass `runs=False` for a tokenizer that isn't so.

Null texts are empty and have the end id alone. A null doc_id comes before all others and stays null. Rows of one doc_id follow
each other by a hash of their ids, equal rows in any order, which changes no value; a doc_id with any share of the rows
spreads over files. Texts of any length are taken whole, a block ends with a document. Empty tables give empty files.
Other columns of docs, whatever their names, aren't read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm._common import drop, keyed_texts, new_path, record_batch, slices

MAGIC = b"TID1"
#: A block is closed by the document that fills it.
BLOCK_IDS = 1 << 18
#: Distinct runs, and distinct words, that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 1_000_000, 64
#: Characters that may change under NFC, or in lower case become two, or aren't Latin; and what may be a special token.
OTHER = re.compile("[^!-~¡-¬®-įı-ſ]|<\\|")
#: Fixed value: the pre-tokenizer's pattern, with the letters and digits that are left, in lower case.
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿā-ſ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿā-ſ0-9²³¹¼½¾]+")
#: Bytes of the four numbers that a control byte stands for.
SIZES = np.array([[1 + (c >> 2 * i & 3) for i in range(4)] for c in range(256)], np.int64)
MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], "<u4")
BLOCK_COLUMNS = "file int, block int, before long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"
BLOCKS = pa.schema([("file", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def encode(numbers: np.ndarray) -> bytes:
    """A block's payload; numbers of up to 32 bits."""
    v = np.ascontiguousarray(numbers, "<u4")
    more = (v >= 1 << 8).astype(np.uint8) + (v >= 1 << 16) + (v >= 1 << 24)
    fours = np.zeros(-len(v) % 4 + len(v), np.uint8)
    fours[: len(v)] = more
    control = (fours.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= more[:, None]]
    rest = control.tobytes() + data.tobytes()
    return MAGIC + np.array([len(v), zlib.crc32(rest)], "<u4").tobytes() + rest


def decode(payload: bytes) -> np.ndarray:
    """The numbers of a payload; an error if it isn't what encode() wrote."""
    head, rest = payload[:12], memoryview(payload)[12:]
    if len(head) < 12 or head[:4] != MAGIC or zlib.crc32(rest) != np.frombuffer(head, "<u4")[2]:
        raise ValueError("a block of token ids is damaged")
    n = int(np.frombuffer(head, "<u4")[1])
    controls = -(-n // 4)
    sizes = SIZES[np.frombuffer(rest, np.uint8, controls)].reshape(-1)[:n]
    places = np.cumsum(sizes) - sizes
    data = bytes(rest[controls:]) + b"\0\0\0"
    return np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))[places] & MASK[sizes]


class Memory(dict):
    """Remembers what make gives, up to a bound of entries, after which it starts anew."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Texts to ids as little-endian bytes."""

    def __init__(self, json_path: str, kind: str, runs: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(json_path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.runs, self.letter = self.library.model, runs, {"<u2": "H", "<u4": "I"}[kind]
        self.known, self.words = Memory(self.run), Memory(self.word)
        # bytes as the characters that byte-level vocabularies spell them with: printable ones stand for themselves
        own = [b for b in range(256) if chr(b).isprintable() and chr(b) not in " "]
        self.spelled = {b: chr(b) if b in own else chr(256 + sum(o not in own for o in range(b))) for b in range(256)}

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def word(self, word: str) -> bytes:
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.spelled)
        return self.packed([t.id for t in self.model.tokenize(spelled)])

    def run(self, run: bytes) -> bytes:
        """The ids of a run; its words are looked up if it is plain."""
        text = run.decode()
        return self.whole(text) if OTHER.search(text) else b"".join(map(self.words.__getitem__, WORD.findall(text.lower())))

    def whole(self, text: str) -> bytes:
        return self.packed(self.library.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, text.encode().split())) if self.runs else self.whole(text)


@lru_cache(2)
def encoder(json_path: str, kind: str, runs: bool) -> Encoder:
    return Encoder(json_path, kind, runs)


def tokens(docs: DataFrame, json_path: str, end_id: int, kind: str, runs: bool) -> DataFrame:
    """doc_id and ids, with the end id, as bytes of the numpy type kind."""

    def cut(batches):
        ids_of, end = encoder(json_path, kind, runs), np.array([end_id], kind).tobytes()
        for b in slices(batches):
            yield record_batch(TOKENS, [b.column(0), [ids_of(text) + end for text in b.column(1).to_pylist()]])

    return keyed_texts(docs).mapInArrow(cut, "doc_id long, ids binary")


def frequency_order(found: DataFrame, kind: str, size: int) -> np.ndarray:
    """The ids that occur, the most frequent first, then by number: at most the vocabulary."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def count(batches):
        n = np.zeros(size, np.int64)
        for b in batches:
            column = b.column(0)
            _, offsets, values = column.buffers()
            if values is not None and len(column):  # the column's bytes as one array of ids
                first, last = np.frombuffer(offsets, "<i4")[[column.offset, column.offset + len(column)]]
                n += np.bincount(np.frombuffer(values, np.uint8)[first:last].view(kind), minlength=size)
        has = np.flatnonzero(n)
        yield record_batch(schema, [has, n[has]])

    rows = found.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r.id for r in sorted(rows, key=lambda r: (-r.n, r.id))], "<u4")


def write_token_files(docs: DataFrame, path: str, json_path: str, end_id: int, runs: bool = True) -> None:
    """Writes the ids of all texts, each with end_id behind it, in ascending doc_id order to the folder path."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = max([end_id, *Tokenizer.from_file(json_path).get_vocab(with_added_tokens=True).values()]) + 1
    kind = "<u2" if size <= 1 << 16 else "<u4"
    numbered = tokens(docs, json_path, end_id, kind, runs).withColumn("row", F.monotonically_increasing_id())
    numbered.write.option("compression", "zstd").parquet(once := new_path(spark))
    found = spark.read.schema(numbered.schema).parquet(once)
    order = frequency_order(found, kind, size)
    rank = np.zeros(size, "<u4")
    rank[order] = np.arange(len(order))

    def blocks(batches):
        file, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, parts, held = [], [], 0

        def closed():
            numbers = rank[np.frombuffer(b"".join(parts), kind)]
            lengths = [len(p) // np.dtype(kind).itemsize for p in parts]
            return record_batch(BLOCKS, [[x] for x in (file, block, before, held, doc_ids, lengths, encode(numbers))])

        for b in slices(batches):
            for doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                doc_ids.append(doc)
                parts.append(ids)
                held += len(ids) // np.dtype(kind).itemsize
                if held >= BLOCK_IDS:
                    yield closed()
                    block, before = block + 1, before + held
                    doc_ids, parts, held = [], [], 0
        if parts:
            yield closed()

    keys = [F.col("doc_id").asc_nulls_first(), "hash", "row"]
    ordered = found.withColumn("hash", F.xxhash64("ids")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.select("doc_id", "ids").mapInArrow(blocks, BLOCK_COLUMNS).write.option("compression", "zstd").parquet(f"{path}/ids")
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(order)], "rank int, id int").write.parquet(f"{path}/ranks")
    drop(spark, once)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian, 32 bits each) of every document."""
    found = spark.read.schema("rank int, id int").parquet(f"{path}/ranks").orderBy("rank").collect()  # at most the vocabulary
    by_rank = np.array([r.id for r in found], "<u4")
    table = spark.read.schema(BLOCK_COLUMNS).parquet(f"{path}/ids")
    # a row per file; there are as many as the writer had partitions
    files = table.groupBy("file").agg(F.sum("n_ids").alias("n")).select("file", (F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("base"))
    placed = table.join(F.broadcast(files), "file").select((F.col("base") + F.col("before")).alias("first"), "doc_ids", "lengths", "payload")

    def documents(batches):
        for b in batches:
            for i in range(b.num_rows):
                first, doc_ids, lengths, payload = (c[i].as_py() for c in b.columns)
                ids = by_rank[decode(payload)].tobytes()
                n = np.array(lengths, np.int64)
                ends = np.cumsum(n)
                texts = [ids[4 * s : 4 * e] for s, e in zip((ends - n).tolist(), ends.tolist(), strict=True)]
                yield record_batch(READ, [doc_ids, first + ends - n, n, texts])

    return placed.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")
