"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens (a run of spaces and the word after it); no piece of the vocabulary crosses such a cut. The
distinct pre-tokens of a batch lie in ragged numpy arrays. In each round every sequence merges its lowest-rank pair, all
sequences at once, until no pair of a known piece is left; what survives is counted.

A very long pre-token (a text without spaces) is first cut into overlapping chunks, which merge side by side. Where two
neighbouring chunks end up with the same two tokens beside a place, and the first of them goes back to a cut, no merge of the
whole sequence crosses the place: up to any rank both tokens come about from their own characters alone, so the pair that
would cross is the same in the whole sequence and in either chunk, and there it lost. Such places become cuts; where two
chunks don't agree, the text is merged again from the last cut in chunks of twice the length.

Null texts are empty and have 0 tokens. Repeated rows are counted row by row, ties (equal pairs side by side) merge from the
left as the library does. Texts of any length are taken whole. Other columns of docs, whatever their names, aren't read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm._common import keyed_texts, record_batch, slices

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
FAR = np.int32(2**31 - 1)
MARK = "▁"
#: Longer pre-tokens are cut; a chunk reaches STEP / 2 beyond its STEP characters at either end.
LONG, STEP, CHUNKS = 256, 64, 8192


class Merger:
    """The merge table of a sentencepiece BPE model, and counts by it."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.check(sp)
        score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        symbols = sorted({*score, *(c for p in score for c in p)})
        index = {s: i for i, s in enumerate(symbols)}
        self.n = len(symbols) + 1  # the last stands for characters that no piece holds
        rank = {p: order[s] for p, s in score.items()}
        pairs, unsafe = {}, np.zeros(len(order) + 1, bool)
        for p, r in rank.items():
            for cut in range(1, len(p)):
                a, b = p[:cut], p[cut:]
                if a in index and b in index:
                    pairs[index[a] * self.n + index[b]] = (r, index[p])
                    for part in (a, b):  # once this part is merged, a lower rank may appear beside it
                        if len(part) > 1 and r <= rank.get(part, -1):
                            unsafe[rank[part]] = True
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys], np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys], np.int32)
        self.safe = ~unsafe
        self.symbol = np.full(0x110000, self.n - 1, np.int32)
        self.weight = np.ones(0x110000, np.int32)
        self.weight[0x80:] = 2
        self.weight[0x800:] = 3
        self.weight[0x10000:] = 4
        for s, i in index.items():
            if len(s) == 1:
                self.symbol[ord(s)] = i
                if s in score:
                    self.weight[ord(s)] = 1
        self.newline_apart = not any("\n" in p for p in score)

    @staticmethod
    def check(sp) -> None:
        """Only what this class reproduces: BPE, bytes for unknown characters, no changes but spaces."""
        probe = "  aéﬁ b\n\t"
        if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model rewrites texts; only a model that keeps characters is supported")
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if sum(map(sp.is_byte, range(len(pieces)))) != 256 or any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("the model lacks byte pieces or has pieces that cross a space")

    def pair(self, a, b):
        """Rank and merged symbol of pairs; FAR where they make no piece."""
        key = a.astype(np.int64) * self.n + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], FAR), self.merged[at]

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each non-empty pre-token."""
        out = np.zeros(len(words), np.int64)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        word, _, weight = self.merge([words[i] for i in short])
        out[short] = np.bincount(word, weight, len(short)).astype(np.int64)
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.count_long(w)
        return out

    def count_long(self, text: str) -> int:
        """Tokens of one long pre-token: chunk by chunk as far as neighbours agree, else again from there in longer chunks."""
        total, done, step, chunks = 0, 0, STEP, CHUNKS
        while done < len(text):
            half = step // 2
            rest = text[done : done + chunks * step + half]  # from a cut, so it stands for itself
            n = max(1, -(-(len(rest) - half) // step))
            chunk, at, weight = self.merge([rest[max(0, k * step - half) : (k + 1) * step + half] for k in range(n)])
            start = at + np.maximum(chunk * step - half, 0)
            last = np.r_[chunk[1:] != chunk[:-1], True]
            end = np.where(last, np.minimum((chunk + 1) * step + half, len(rest)), np.r_[start[1:], 0])
            inner = np.flatnonzero(~last)  # a place between two tokens of a chunk
            place, zone = end[inner], (end[inner] + half) // step  # the chunks zone - 1 and zone both hold the places of a zone
            key = np.stack([place, place - start[inner], end[inner + 1] - place], 1)
            left, right = chunk[inner] == zone - 1, chunk[inner] == zone
            cut = np.full(n + 1, -1)
            for p, _, _ in set(map(tuple, key[left].tolist())) & set(map(tuple, key[right].tolist())):
                cut[(p + half) // step] = max(p, cut[(p + half) // step])
            cut[0] = 0
            if done + len(rest) == len(text):
                cut[n] = len(rest)
            sound = int(np.argmin(np.r_[cut >= 0, False])) - 1  # a cut holds only if the one before it does
            inside = (chunk < sound) & (start >= cut[chunk]) & (start < cut[np.minimum(chunk + 1, n)])
            total, done = total + int(weight[inside].sum()), done + int(cut[sound])
            step, chunks = (STEP, min(2 * chunks, CHUNKS)) if sound else (2 * step, 8)
        return total

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The final tokens: word, place of the first character in it, and weight (tokens it stands for), by word and place."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        sym, wt = self.symbol[points], self.weight[points]
        size = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), size)
        at_ = np.arange(len(sym)) - np.repeat(np.cumsum(size) - size, size)
        ended: list[tuple] = []
        rank, into = np.full(len(sym), FAR), np.zeros(len(sym), np.int32)
        if len(sym) > 1:
            rank[:-1], into[:-1] = self.pair(sym[:-1], sym[1:])
            rank[:-1][word[1:] != word[:-1]] = FAR
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(sym)])
            least = np.minimum.reduceat(rank, first)
            done = least == FAR
            if done.any():
                stay = np.repeat(~done, size)
                ended.append((word[~stay], at_[~stay], wt[~stay]))
                sym, wt, word, at_, rank, into = sym[stay], wt[stay], word[stay], at_[stay], rank[stay], into[stay]
                least, size = least[~done], size[~done]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            k = np.arange(len(at))
            new = np.r_[True, (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]])]
            lone = np.r_[True, word[at[1:]] != word[at[:-1]]]
            even = (k - np.maximum.accumulate(np.where(new, k, 0))) % 2 == 0
            at = at[np.where(self.safe[rank[at]], even, lone)]
            sym[at], wt[at] = into[at], 1
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # each merge before has taken one place away
            sym, wt, word, at_, rank, into = sym[keep], wt[keep], word[keep], at_[keep], rank[keep], into[keep]
            fresh = np.unique(np.r_[moved, moved[moved > 0] - 1])
            rank[fresh] = FAR
            fresh = fresh[fresh + 1 < len(sym)]
            fresh = fresh[word[fresh] == word[fresh + 1]]
            rank[fresh], into[fresh] = self.pair(sym[fresh], sym[fresh + 1])
        if not ended:
            return (np.zeros(0, np.int64),) * 3
        word, at_, wt = (np.concatenate(x) for x in zip(*ended, strict=True))
        by = np.argsort(word, kind="stable")  # a word's tokens end together, in order
        return word[by], at_[by], wt[by]

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text, some of them empty."""
        if not text:
            return []
        text = MARK + text.replace(" ", MARK)
        if not self.newline_apart:
            return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", text)
        if MARK * 2 in text:
            return re.findall(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+", text)
        return text.replace(MARK, "\n" + MARK).split("\n")

    def count_texts(self, texts: list[str], known: dict[str, int]) -> list[int]:
        parts = [self.words(t) for t in texts]
        new = list(set().union(*parts) - known.keys())
        known.update(zip(new, self.counts(new).tolist(), strict=True))
        lines = [t.count("\n") if self.newline_apart else 0 for t in texts]
        return [sum(map(known.__getitem__, p)) + n for p, n in zip(parts, lines, strict=True)]


@lru_cache(2)
def merger(model_path: str) -> Merger:
    return Merger(model_path)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, known_words: int = 400_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row of docs.

    Null text: 0 bytes, 0 tokens. An empty table gives no rows; null or repeated doc_ids pass through; other columns of docs
    are not read. A worker remembers the counts of up to about known_words pre-tokens; more are counted anew.
    """

    def count(batches):
        m, known = merger(model_path), {"": 0}
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            if len(known) > known_words:
                known = {"": 0}
            n = m.count_texts(texts, known)
            yield record_batch(ARROW, [b.column(0), [len(t.encode()) for t in texts], n, [x > limit for x in n]])

    return keyed_texts(docs).mapInArrow(count, SCHEMA)
