"""Secret scans: fixed patterns find the base spans, a character network adds spans that the patterns miss.

Candidates are runs of key-like characters that aren't plain words: with a digit, with a capital after a small letter, 16
characters or longer, or, from 6 characters on, after an assignment or a word that announces a secret. Each is scored whole, window by
window, with the text around it, and so is the value of each base span. Candidates that overlap a base span are the base's;
others are added if their calibrated probability reaches the threshold. Base spans stay whatever their probability.

Null texts are empty and give zero counts and empty digests. Repeated rows are scanned row by row, empty tables give no
rows, whole texts are scanned whatever their length. Spans of one start are ordered by kind, equal ones can't arise; a
probability at the threshold adds the span. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import secret_model
from tessera.llm._common import keyed_texts, record_batch, slices

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long, n_confirmed long"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_model", pa.int64()), ("n_confirmed", pa.int64())])
#: Fixed patterns. Maximal runs, so the least length can stand in the pattern where nothing else may match inside a run.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words after which a run may be a secret whatever it looks like.
ANNOUNCED = re.compile(r"(?:bearer|basic|pwd|pass|auth|key|credential|token|password|secret)[\"']?\s+[\"']?\Z", re.I)
#: Classes of characters: 1 small letter, 2 capital, 3 digit, 4 another that keys hold; = only closes a run.
_CLASS = np.zeros(129, np.uint8)
for _chars, _class in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), ("+/_.-", 4)):
    _CLASS[[ord(c) for c in _chars]] = _class
SHORT, PLAIN, LONG = 6, 8, 16
KINDS = ("assign", "access", "hex", "model")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans that might be secrets."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _CLASS[np.minimum(points, 128)]
    edge = np.flatnonzero(np.diff(np.r_[False, kind > 0, False]))
    start, end = edge[::2], edge[1::2]
    wide = end - start >= SHORT
    start, end = start[wide], end[wide]
    if not len(start):
        return []
    any_ = lambda flags: np.diff(np.r_[0, np.cumsum(flags)][np.stack([start, end], 1)], axis=1)[:, 0] > 0
    odd = any_(kind == 3) | any_(np.r_[False, (kind[1:] == 2) & (kind[:-1] == 1)])
    sure = (end - start >= LONG) | odd & (end - start >= PLAIN)
    # what stands before, but for blanks and quotes
    solid = np.maximum.accumulate(np.where((points == 32) | (points == 9) | (points == 34) | (points == 39), -1, np.arange(len(points))))
    before = np.where(start > 0, solid[np.maximum(start - 1, 0)], -1)
    assigned = (before >= 0) & ((points[before] == ord(":")) | (points[before] == ord("=")))
    spoken = np.flatnonzero(~(sure | assigned) & (start > 3))
    # an announcing word ends in one of a few letters
    ends = np.isin(points[before[spoken]] | 32, [ord(c) for c in "rcdshylnt"])
    for i in spoken[ends].tolist():
        assigned[i] = ANNOUNCED.search(text, max(0, int(start[i]) - 16), int(start[i])) is not None
    out = []
    for a, b in zip(start[sure | assigned].tolist(), end[sure | assigned].tolist(), strict=True):
        while b > a and text[b - 1] in ".-":  # the end of a sentence
            b -= 1
        if b - a >= SHORT:
            while text.startswith("=", b):
                b += 1
            out.append((a, b))
    return out


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_texts(texts: list[str], model: dict) -> list[tuple]:
    """n_assign, n_access, n_hex, base_sha256, spans, n_model, n_confirmed of each text."""
    base = [base_spans(t) for t in texts]
    own, spots = [], []
    for i, t in enumerate(texts):
        for a, k, b in base[i]:
            own.append((i, ASSIGN.match(t, a, b).start(2) if k == 0 else a, b))
        starts = [x for x, _, _ in base[i]]
        reach = list(accumulate((y for _, _, y in base[i]), max))  # how far the spans up to here reach

        def free(a, b, starts=starts, reach=reach):
            before = bisect_left(starts, b)
            return not before or reach[before - 1] <= a

        spots += [(i, a, b) for a, b in candidates(t) if free(a, b)]
    p = secret_model.probability(model, texts, own + spots)
    confirmed = [0] * len(texts)
    for (i, _, _), sure in zip(own, p >= model["threshold"], strict=False):
        confirmed[i] += int(sure)
    added: dict[int, list] = {}
    for (i, a, b), sure in zip(spots, p[len(own) :] >= model["threshold"], strict=True):
        if sure:
            added.setdefault(i, []).append((a, 3, b))
    out = []
    for i, spans in enumerate(base):
        n = [sum(k == x for _, k, _ in spans) for x in range(3)]
        out.append((*n, hashlib.sha256(spelled(spans).encode()).hexdigest(), spelled(sorted(spans + added.get(i, []))), len(added.get(i, [])), confirmed[i]))
    return out


def secret_scan(docs: DataFrame, findings: int = 5000, seed: int = 7, recall: float = 0.99) -> DataFrame:
    """One row per document: counts of base kinds, their digest, all spans, the number of added ones and of base spans that the network confirms.

    findings bounds the labelled findings the network is fitted on; recall is what its threshold must keep of held-out ones.
    """
    model = secret_model.trained(findings, seed, recall=recall)

    def scan(batches):
        for b in slices(batches):
            rows = scan_texts(b.column(1).to_pylist(), model)
            yield record_batch(ARROW, [b.column(0), *(map(list, zip(*rows, strict=True)) if rows else [[]] * 7)])

    return keyed_texts(docs).mapInArrow(scan, SCHEMA)
