"""A full-text index of immutable segments (FTS04, FTS05), and its best units by block maxima (FTS02, SRT02).

A segment is a folder of postings of the units that one refresh brought; nothing in it changes. A unit that changes or goes is
put on a deletion list, which counts for all segments before it. So a refresh writes the postings of the changed units and
their ids, whatever the size of the index. Segments of about one size are merged once there are several, which is when deleted
postings go; so a posting is rewritten a number of times that grows with the logarithm of the index. A manifest in a
commit log names the segments, deletion lists and corpus figures; readers see one manifest, writers that cross are told.

Within a segment units that follow each other by their ids are a range (units of one paper are alike), and the postings of a term
in a range are one row, a block. So only texts are shuffled, by their units' ids: a task has all units of its ranges, makes their
blocks in arrays, sorts them and writes a file to each folder of terms. A block without a term lists the range's units. The others
tell their number of postings and which pairs of occurrences and size no posting of theirs exceeds in both ways; the best of these
pairs is, at any mean size, what the term adds to a unit's score there at the most. The k best units of a query take two passes:
the ranges with the greatest bounds are scored whole, the k-th score found there is a threshold, and of all other ranges only
those whose bound reaches it, and in which each word occurs, are opened. The result equals the full ranking's first k.
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import commits
from tessera.functions.text import tokens
from tessera.operators.search import K1, LEAST_IDF, B, _phrase_counts

#: Units of a range, and their tokens, at most; a longer unit is a range of its own. Most terms of a small range occur in it
#: once, which makes nearly as many blocks as postings.
RANGE, TOKENS = 16384, 1 << 20
#: The folder of the blocks without a term.
UNITS = -1
#: Ids that rise and small numbers are written as differences, for which no dictionary is tried.
DELTAS = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}
#: n: postings; most_f, least_size: the pairs that bound the block's scores; the other lists go by posting, in the order of unit ids.
BLOCKS = "part int, term string, range long, n int, most_f array<int>, least_size array<int>, unit_ids array<long>, paper_ids array<long>, sizes array<int>, positions array<array<int>>"


def parts_of(term: Column, folders: int) -> Column:
    return (F.crc32(term.cast("binary")) % folders).cast("int")


def share(f: Column, size: Column, mean: Column) -> Column:
    """What a term that occurs f times adds to a unit's score, but for its idf."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean))


def _of_units(batches, many: int, folders: int):
    """Blocks of units (unit_id, paper_id, t: tokens) that come in the order of their ids; of rows with one id the first counts."""

    def first_rows():
        last = None
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("unit_id").to_numpy()
                new = np.append(last is None or ids[0] != last, ids[1:] != ids[:-1])
                last = ids[-1]
                yield batch if new.all() else batch.filter(pa.array(new))

    def sizes(batch):
        return np.arange(batch.num_rows), batch.column("t").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)

    def arrays(rows):
        n = sizes(rows)[1]
        words = rows.column("t").flatten().dictionary_encode()
        unit, position = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return rows.column("unit_id"), rows.column("paper_id"), n, words.dictionary, words.indices.to_numpy().astype(np.int64), unit, position

    yield from _ranges(first_rows(), sizes, arrays, many, folders)


def _of_postings(batches, many: int, folders: int):
    """Blocks of postings that come in the order of unit ids; before those of a unit goes a row of it without a term."""

    def sizes(batch):
        first = np.flatnonzero(batch.column("term").is_null().to_numpy(zero_copy_only=False))
        return first, batch.column("size").to_numpy()[first].astype(np.int64)

    def arrays(rows):
        first = rows.column("term").is_null()
        units, found = rows.filter(first), rows.filter(pa.compute.invert(first))
        owner = (np.cumsum(first.to_numpy(zero_copy_only=False)) - 1)[~first.to_numpy(zero_copy_only=False)]
        n = found.column("positions").value_lengths().to_numpy(zero_copy_only=False)
        words = found.column("term").dictionary_encode()
        codes, position = words.indices.to_numpy().astype(np.int64), found.column("positions").flatten().to_numpy().astype(np.int64)
        return units.column("unit_id"), units.column("paper_id"), units.column("size").to_numpy().astype(np.int64), words.dictionary, np.repeat(codes, n), np.repeat(owner, n), position

    yield from _ranges(batches, sizes, arrays, many, folders)


def _ranges(batches, sizes, arrays, many: int, folders: int):
    """Cuts rows before the first row of a unit into ranges, and gives their blocks. sizes: the first rows of a batch's units, and the units' tokens."""
    held, units, words, number = [], 0, 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        first, n = sizes(batch)
        at = i = 0
        while i < len(first):
            total = np.cumsum(n[i : i + many])
            fit = min(many - units, int(np.searchsorted(total, TOKENS - words, side="right")))
            if fit <= 0 and units:
                yield from _blocks(number, folders, *arrays(pa.concat_batches([*held, batch.slice(at, first[i] - at)])))
                held, units, words, number, at = [], 0, 0, number + 1, first[i]
                continue
            fit = max(fit, 1)
            units, words, i = units + fit, words + int(total[fit - 1]), i + fit
        held.append(batch.slice(at))
    if units:
        yield from _blocks(number, folders, *arrays(pa.concat_batches(held)))


def _blocks(number: int, folders: int, unit_ids, paper_ids, sizes, terms, codes, unit, position):
    """The rows of one range; tokens are codes of terms with unit and position, in the order of units."""
    parts = np.fromiter((zlib.crc32(t) % folders for t in terms.cast(pa.binary()).to_pylist()), np.int64, len(terms))
    by_term = pa.compute.sort_indices(pa.table({"part": parts, "term": terms}), [("part", "ascending"), ("term", "ascending")]).to_numpy()
    terms, parts, place = terms.take(pa.array(by_term)), parts[by_term], np.empty(len(terms), np.int64)
    place[by_term] = np.arange(len(terms))
    codes = place[codes]
    order = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")  # 16 bits are sorted by radix
    if len(terms) > 1 << 16:
        order = order[np.argsort((codes[order] >> 16).astype(np.uint16), kind="stable")]
    codes, unit, position = codes[order], unit[order], position[order]
    posting = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(unit, prepend=-1) != 0))
    f, codes, unit = np.diff(posting, append=len(codes)), codes[posting], unit[posting]
    block = np.flatnonzero(np.diff(codes, prepend=-1))
    of, most_f, least_size = _bounds(codes, f, sizes[unit], len(unit_ids))

    def lists(starts, values, n):
        return pa.ListArray.from_arrays(pa.array(np.append(starts, n).astype(np.int32)), values)

    def row(part, term, n, bounds, at, owner, places):
        pairs = (lists(bounds[0], pa.array(x.astype(np.int32)), len(x)) for x in bounds[1:])
        owners = pa.array(owner)
        held = (lists(at, x, len(owner)) for x in (unit_ids.take(owners), paper_ids.take(owners), pa.array(sizes[owner].astype(np.int32)), places))
        return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), term, pa.array(np.full(len(n), number)), pa.array(n.astype(np.int32)), *pairs, *held], names=["part", "term", "range", "n", "most_f", "least_size", "unit_ids", "paper_ids", "sizes", "positions"])

    none, zero, all_ = np.zeros(0, np.int64), np.zeros(1, np.int64), np.arange(len(unit_ids))
    yield row(np.array([UNITS]), pa.nulls(1, pa.string()), np.array([len(all_)]), (zero, none, none), zero, all_, lists(np.zeros(len(all_)), pa.nulls(0, pa.int32()), 0))
    found = row(parts, terms, np.diff(block, append=len(codes)), (np.searchsorted(of, np.arange(len(terms))), most_f, least_size), block, unit, lists(posting, pa.array(position.astype(np.int32)), len(position)))
    for i in range(0, found.num_rows, 10_000):
        yield found.slice(i, 10_000)


def _bounds(codes, f, size, units: int):
    """Of each code the pairs (f, size) that no other one exceeds by more occurrences in a unit that is no larger: codes, f, size."""
    if units < 2 or not len(codes):  # a posting for each code
        return codes, f, size
    top, wide = int(f.max()) + 1, int(size.max()) + 1  # all are at most TOKENS
    key = np.sort((codes * top + (top - 1 - f)) * wide + size)
    size, key = key % wide, key // wide
    f, codes = top - 1 - key % top, key // top
    falling = size - codes * wide  # below all of the codes before
    new = np.append(True, falling[1:] < np.minimum.accumulate(falling)[:-1])
    return codes[new], f[new], size[new]


class Segments:
    """The index in a folder. Units are unit_id, paper_id, content; a unit without content has no terms, but counts."""

    FOLDERS = 16
    #: So many segments of about one size are merged.
    FAN = 4

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = commits.Log(spark, self.root)

    def manifest(self, state: commits.State | None = None) -> dict:
        """segments (name, at, units, size), deletions (name, at), units and size (tokens) of the corpus; at: the number of the refresh."""
        found = (state or self.log.state()).values.get("manifest")
        return json.loads(found[0]) if found else {"at": 0, "segments": [], "deletions": [], "units": 0, "size": 0}

    def _save(self, base: commits.State, manifest: dict) -> None:
        self.log.commit(base, set_={"manifest": [json.dumps(manifest)]})

    # writing

    def refresh(self, changed: DataFrame, gone: DataFrame | None = None) -> None:
        """FTS04: takes in units that are new or have changed, and lets others go. Units without an id aren't taken in. Then merges what is due."""
        base = self.log.state()
        now = self.manifest(base)
        at, name = now["at"] + 1, uuid.uuid4().hex
        ids = changed.select(F.col("unit_id").cast("long"))
        stale = (ids if gone is None else ids.unionByName(gone.select(F.col("unit_id").cast("long")))).filter("unit_id IS NOT NULL").distinct()
        lost = {"units": 0, "size": 0}
        if now["segments"]:
            found = self._alive(self._sizes(now), now["deletions"]).join(stale, "unit_id", "left_semi")
            found.select("unit_id", "size").write.parquet(f"{self.root}/deletions/{name}")
            lost = self._totals(self.spark.read.schema("unit_id long, size int").parquet(f"{self.root}/deletions/{name}"))
        known = changed.filter("unit_id IS NOT NULL").select(F.col("unit_id").cast("long"), F.col("paper_id").cast("long"), F.coalesce("content", F.lit("")).alias("content"))
        placed = known.repartitionByRange("unit_id").sortWithinPartitions("unit_id", "paper_id", "content")
        new = self._write(name, at, placed.select("unit_id", "paper_id", tokens(F.col("content")).alias("t")).mapInArrow(partial(_of_units, many=RANGE, folders=self.FOLDERS), BLOCKS))
        # a list of nothing is none
        deletions = now["deletions"] + ([{"name": name, "at": at}] if lost["units"] else [])
        segments = now["segments"] + ([new] if new["units"] else [])
        after = {"at": at, "segments": segments, "deletions": deletions, "units": now["units"] - lost["units"] + new["units"], "size": now["size"] - lost["size"] + new["size"]}
        self._save(base, after)
        self.merge()

    def _write(self, name: str, at: int, blocks: DataFrame) -> dict:
        """Writes a segment's blocks to the folders of their terms."""
        blocks.sortWithinPartitions("part", "term", "range").write.partitionBy("part").options(**DELTAS).parquet(f"{self.root}/postings/{name}")
        one = {"name": name, "at": at}
        return one | self._totals(self._sizes({"segments": [one]}))

    def _totals(self, sizes: DataFrame) -> dict:
        n, size = sizes.agg(F.count("*"), F.sum("size")).first()
        return {"units": n, "size": size or 0}

    def merge(self) -> None:
        """Merges segments while FAN of them are of about one size; deletion lists that count for no segment are let go."""
        while True:
            base = self.log.state()
            now = self.manifest(base)
            classes: dict[int, list] = {}
            for s in now["segments"]:
                classes.setdefault(int(math.log(max(s["units"], 1), self.FAN)), []).append(s)
            due = next((c for _, c in sorted(classes.items()) if len(c) >= self.FAN), None)
            if due is None:
                return
            part = {**now, "segments": due}
            rows = self._opened(self.blocks(None, part), part).repartitionByRange("unit_id").sortWithinPartitions("unit_id", F.asc_nulls_first("term"))
            merged = self._write(uuid.uuid4().hex, now["at"], rows.mapInArrow(partial(_of_postings, many=RANGE, folders=self.FOLDERS), BLOCKS))
            segments = [s for s in now["segments"] if s not in due] + ([merged] if merged["units"] else [])
            oldest = min([s["at"] for s in segments], default=now["at"])
            self._save(base, {**now, "segments": segments, "deletions": [d for d in now["deletions"] if d["at"] > oldest]})

    def vacuum(self) -> None:
        """Deletes the folders that the present manifest doesn't name; no reader of an older one may still be at work."""
        now = self.manifest()
        kept = {"postings": {s["name"] for s in now["segments"]}, "deletions": {d["name"] for d in now["deletions"]}}
        for kind, names in kept.items():
            p, fs = commits.file_system(self.spark, f"{self.root}/{kind}")
            for s in fs.listStatus(p) if fs.exists(p) else []:
                if s.getPath().getName() not in names:
                    fs.delete(s.getPath(), True)

    # reading

    def _read(self, kind: str, schema: str, entry: dict) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{kind}/{entry['name']}").withColumn("at", F.lit(entry["at"]))

    def _sizes(self, manifest: dict) -> DataFrame:
        return self.blocks(None, manifest).filter(F.col("part") == UNITS).select("at", F.inline(F.arrays_zip("unit_ids", "sizes")).alias("unit_id", "size"))

    def _alive(self, rows: DataFrame, deletions: list[dict]) -> DataFrame:
        """Rows of units that no later deletion list names. The lists meet as the newest `at` of each unit."""
        if not deletions:
            return rows
        lists = reduce(DataFrame.unionByName, (self._read("deletions", "unit_id long", d) for d in deletions))
        newest = lists.groupBy("unit_id").agg(F.max("at").alias("_gone"))
        return rows.join(newest, "unit_id", "left").filter(F.col("_gone").isNull() | (F.col("_gone") <= F.col("at"))).drop("_gone")

    def blocks(self, words: list[str] | None, manifest: dict | None = None) -> DataFrame:
        """Blocks of the given terms, whose folders alone are read; or all, those without a term, too."""
        now = manifest or self.manifest()
        if not now["segments"]:
            return self.spark.createDataFrame([], f"{BLOCKS}, at int")
        rows = reduce(DataFrame.unionByName, (self._read("postings", BLOCKS, s) for s in now["segments"]))
        if words is not None:
            rows = rows.filter(reduce(lambda a, b: a | b, ((F.col("part") == parts_of(F.lit(w), self.FOLDERS)) & (F.col("term") == w) for w in words), F.lit(False)))
        return rows

    def _opened(self, blocks: DataFrame, manifest: dict) -> DataFrame:
        rows = blocks.select("term", "at", F.inline(F.arrays_zip("unit_ids", "paper_ids", "sizes", "positions")).alias("unit_id", "paper_id", "size", "positions"))
        return self._alive(rows, manifest["deletions"]).select("term", "unit_id", "paper_id", "size", "positions")

    def postings(self, words: list[str] | None = None, manifest: dict | None = None) -> DataFrame:
        """term, unit_id, paper_id, size, positions of the units alive."""
        now = manifest or self.manifest()
        return self._opened(self.blocks(words, now).filter("term IS NOT NULL"), now)

    def figures(self, manifest: dict | None = None) -> tuple[int, float]:
        now = manifest or self.manifest()
        return now["units"], now["size"] / now["units"] if now["units"] else 0.0

    def bm25(self, phrases: list[list[str]], papers: DataFrame | None = None) -> DataFrame:
        """FTS02, FTS03: unit_id, paper_id, rank of all units with all phrases, as search.bm25 gives them."""
        now = self.manifest()
        counts = _phrase_counts(self.postings(sorted({w for p in phrases for w in p}), now), phrases) if phrases else None
        if counts is None:
            return self.spark.createDataFrame([], "unit_id long, paper_id long, rank double")
        seen = counts.agg(*(F.count_if(F.col(f"_f{i}") > 0).alias(f"_n{i}") for i in range(len(phrases)))).first()
        ranked = self._scored(counts, phrases, seen, now)
        return ranked if papers is None else ranked.join(papers.select("paper_id").distinct(), "paper_id", "left_semi").select("unit_id", "paper_id", "rank")

    def _scored(self, counts: DataFrame, phrases, seen, manifest: dict) -> DataFrame:
        units, mean = self.figures(manifest)
        both = counts.filter(reduce(lambda a, b: a & b, (F.col(f"_f{i}") > 0 for i in range(len(phrases)))))
        score = F.lit(0.0)
        for i in range(len(phrases)):
            score = score - idf(units, seen[i]) * share(F.col(f"_f{i}"), F.col("size"), F.lit(mean))
        return both.select("unit_id", "paper_id", score.alias("rank"))

    def best(self, words: list[str], k: int) -> tuple[DataFrame, dict[str, int]]:
        """SRT02: the k units with the best rank that hold all the words, ties by unit_id; and how many postings the words have, and how many were opened."""
        words, now = sorted(set(words)), self.manifest()
        none = self.spark.createDataFrame([], "unit_id long, paper_id long, rank double")
        if not words or not now["segments"] or k < 1:
            return none, {"postings": 0, "opened": 0}
        units, mean = self.figures(now)
        blocks = self.blocks(words, now)
        total = blocks.agg(F.sum("n")).first()[0] or 0
        counted = blocks.groupBy("term").agg(F.sum("n").alias("n"))
        if now["deletions"]:  # units alive that hold a word: their ids only
            alive = self._alive(blocks.select("term", "at", F.explode("unit_ids").alias("unit_id")), now["deletions"])
            counted = alive.groupBy("term").agg(F.count("*").alias("n"))
        n = {r.term: r.n for r in counted.collect()}
        if set(words) - set(n):
            return none, {"postings": total, "opened": 0}
        phrases, seen = [[w] for w in words], [n[w] for w in words]
        weight = F.element_at(F.create_map(*(x for w in words for x in (F.lit(w), F.lit(idf(units, n[w]))))), F.col("term"))
        bound = F.sum(weight * F.array_max(F.zip_with("most_f", "least_size", lambda f, size: share(f, size, F.lit(mean)))))
        ranges = blocks.groupBy("at", "range").agg(bound.alias("bound"), F.count("*").alias("words"), F.sum("n").alias("held")).filter(F.col("words") == len(words))

        def ranked(some: DataFrame) -> DataFrame:
            opened = blocks.join(some.select("at", "range"), ["at", "range"], "left_semi")
            return self._scored(_phrase_counts(self._opened(opened, now), phrases), phrases, seen, now).orderBy("rank", "unit_id").limit(k)

        first = ranges.orderBy(F.desc("bound"), "at", "range").limit(max(4, 4 * -(-k // RANGE)))  # a stated number
        found = ranked(first).collect()
        if len(found) == k:
            ranges = ranges.filter(F.col("bound") >= -found[-1].rank * (1 - 1e-9))
        return ranked(ranges), {"postings": total, "opened": ranges.agg(F.sum("held")).first()[0] or 0}


def idf(units: int, n: int) -> float:
    found = math.log((units - n + 0.5) / (n + 0.5))
    return found if found > 0 else LEAST_IDF
