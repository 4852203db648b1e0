"""Packing by minimum bin slack.

Every text is tokenized and cut into pieces of a window's length and a rest. Rests are packed within shards (a hash of the
piece, so a shard's size follows from the number of rows, not from any key): the longest rest left opens a window, then a
bitset of reachable sums over the multiset of lengths left picks what fills the window closest to its capacity; the sums
are backtracked to counts, and the pattern found is used as often as the counts allow.

Null texts are empty: one piece, the closing id alone. Repeated rows, also of one doc_id, are packed each for itself; of
rests of one length any may go first. Empty tables give no rows. Very long texts give as many full windows as they hold.
Other columns of docs, whatever their names, aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import keyed_texts, record_batch, slices

PIECES = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
PIECE_COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: The tokenizer libraries may differ in their Unicode tables; beyond these characters the slower one, which defines the ids, is asked.
OTHER = re.compile("[^\t\n\r -~¡-¬®-ſ]|<\\|")


@lru_cache(2)
def encoder(json_path: str, ranks_path: str | None):
    """A function from a list of texts to arrays of ids."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(json_path)
    whole.no_truncation()
    whole.no_padding()
    fast = None
    if ranks_path:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> np.ndarray:
        if fast is None or OTHER.search(text):
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4")
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), "<u4")

    return ids


def pattern(lengths: list[int], counts: dict[int, int], room: int) -> tuple[Counter, int]:
    """The multiset of lengths (at most counts of each) whose sum comes closest to room from below, and that sum.

    Bit s of a reach is set if s is a sum of the lengths taken so far. A count c enters as 1, 2, 4, ... copies and a rest, so
    that every number up to c is possible. Going back through the reaches tells which of these were needed.
    """
    full, reach, steps = (1 << room + 1) - 1, 1, []
    for n in lengths:
        left, k = min(counts[n], room // n), 1
        while left > 0:
            k = min(k, left)
            steps.append((reach, n, k))
            reach |= reach << n * k & full
            left, k = left - k, 2 * k
        if reach >> room & 1:
            break
    best = s = reach.bit_length() - 1
    used: Counter = Counter()
    for before, n, k in reversed(steps):
        if not before >> s & 1:
            used[n] += k
            s -= n * k
    return used, best


def windows(counts: dict[int, int], capacity: int):
    """Patterns and how often each is used, until all lengths are used up."""
    counts = {n: c for n, c in counts.items() if c}
    order = sorted(counts, reverse=True)
    while order:
        top = order[0]
        counts[top] -= 1
        used, _ = pattern([n for n in order if n <= capacity - top and counts[n]], counts, capacity - top)
        counts[top] += 1
        used[top] += 1
        times = min(counts[n] // k for n, k in used.items())
        for n, k in used.items():
            counts[n] -= k * times
        order = [n for n in order if counts[n]]
        yield used, times


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length its window (from 0) and its offset there. Lengths of 1 to capacity."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_length = np.argsort(lengths, kind="stable")
    sizes, first = np.unique(lengths[by_length], return_index=True)
    queue = {int(n): part.tolist() for n, part in zip(sizes, np.split(by_length, first[1:]), strict=True)} if len(lengths) else {}
    at = 0
    for used, times in windows({n: len(q) for n, q in queue.items()}, capacity):
        for _ in range(times):
            offset = 0
            for n, k in used.items():
                for _ in range(k):
                    row = queue[n].pop()
                    bins[row], offsets[row] = at, offset
                    offset += n
            at += 1
    return bins, offsets


def token_pieces(docs: DataFrame, json_path: str, ranks_path: str | None, capacity: int, end_id: int) -> DataFrame:
    def cut(batches):
        ids_of = encoder(json_path, ranks_path)
        for b in slices(batches):
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(ids_of(text), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    for column, value in zip(rows, (doc, start, len(part), zlib.crc32(part.tobytes()), len(ids)), strict=True):
                        column.append(value)
            yield record_batch(PIECES, rows)

    return keyed_texts(docs).mapInArrow(cut, PIECE_COLUMNS)


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, capacity: int = 2048, end_id: int = 1, shard_docs: int = 12_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ranks_path: the same vocabulary as ranks, for speed; without it all texts go through the tokenizers library. Shards hold
    about shard_docs pieces, as their number follows from the documents and their lengths; a shard's last windows alone are
    not full, so larger shards pad less.
    """
    size = docs.agg(F.count("*"), F.sum(F.length("text"))).first()
    shards = max(1, -(-(size[0] + (size[1] or 0) // (2 * capacity)) // shard_docs))
    pieces = token_pieces(docs, json_path, ranks_path, capacity, end_id)
    key = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards))

    def fill(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32"], ignore_index=True)
        bins, rows["offset"] = pack_lengths(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = (int(key[0]) << 32) + bins
        return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    out = f"{PIECE_COLUMNS}, sequence_id long, offset long"
    return pieces.withColumn("shard", key).groupBy("shard").applyInPandas(lambda k, rows: fill(k, rows.drop(columns="shard")), out)
