"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A text is a multiset of paragraphs (lines), and each paragraph one of clauses (up to five words). A vector of eight wide
lanes sums, modulo 2^62, numbers hashed from each paragraph's SHA-256: equal multisets have equal lanes whatever their
order, and inserting or deleting a paragraph adds or subtracts its numbers. 128 narrow lanes count, for each bit of two hashes
of a clause, how often it is set, modulo 2^31; packed two to a long they add up at once. They add up the same way, and as
random signs their differences estimate how much two multisets of clauses share.

One text's fingerprint is an expression over its arrays. A whole table's clauses are rows instead, whose lanes are summed
by a grouped aggregation: compiled code, combined within each task before anything is shuffled.

Null texts are empty: one empty paragraph and no clause. Lanes are exact up to 2^30 clauses, so also for very long and
repetitive texts. Repeated rows have equal fingerprints. Other columns of docs, whatever their names, aren't read. Documents follow each
other by ascending doc_id, rows of one doc_id by a hash of their text, null ids after all others; the first follows the
last. A single document follows itself. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import keyed_texts

WIDE, WIDE_MASK = 8, (1 << 62) - 1
SALT = 100
#: Up to five words of a paragraph (parts of 40 characters of a longer one), counted from the paragraph's start.
CLAUSE = "(?:[^ \\n]{1,40}+ ?+){1,5}+"
#: Two lanes of 31 bits in a long, 32 bits apart, so that no sum leaves its lane or the long.
LANES, LANE_BITS = 32, 31
LANE = (1 << LANE_BITS) - 1
BOTH, ONE = LANE << 32 | LANE, 1 << 32 | 1
HASHES = 2


def paragraphs(text: Column) -> Column:
    return F.split(text, "\n", -1)


def clauses(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CLAUSE), F.lit(0))


def _hashes(items: Column, salt: int) -> Column:
    return F.transform(items, lambda x: F.xxhash64(F.lit(salt), x))


def _wide(hashes: Column) -> Column:
    """One long: the sum modulo 2^62."""
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: (acc + h.bitwiseAND(F.lit(WIDE_MASK))).bitwiseAND(F.lit(WIDE_MASK)))


def digests(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.sha2(x, 256))


def fingerprint(text: Column) -> Column:
    """struct(wide: 8 longs, narrow: 64 longs of 2 lanes, n: clauses)."""
    parts, lines = clauses(text), digests(paragraphs(text))
    wide = F.array(*(_wide(_hashes(lines, j)) for j in range(WIDE)))
    narrow = F.flatten(F.array(*(_lanes(_hashes(parts, SALT + j)) for j in range(HASHES))))
    return F.struct(wide.alias("wide"), narrow.alias("narrow"), F.size(parts).alias("n"))


def _lanes(hashes: Column) -> Column:
    """32 longs: in lane k of long j how often bit j + 32 k is set. One pass over the hashes."""
    shift = [F.lit(j) for j in range(LANES)]
    zero = F.struct(*(F.lit(0).cast("long").alias(f"l{j}") for j in range(LANES)))
    add = lambda acc, h: F.struct(*((acc[f"l{j}"] + F.call_function("shiftrightunsigned", h, s).bitwiseAND(F.lit(ONE))).bitwiseAND(F.lit(BOTH)).alias(f"l{j}") for j, s in enumerate(shift)))
    return F.aggregate(hashes, zero, add, lambda acc: F.array(*(acc[f"l{j}"] for j in range(LANES))))


def insert(print_: Column, text: Column) -> Column:
    """The fingerprint after the paragraphs of text are added to the multiset."""
    return _combine(print_, fingerprint(text), 1)


def delete(print_: Column, text: Column) -> Column:
    """The fingerprint after the paragraphs of text are taken out of the multiset."""
    return _combine(print_, fingerprint(text), -1)


def _combine(a: Column, b: Column, sign: int) -> Column:
    def lane(x, y, k):
        return F.pmod(_lane(x, k) + sign * _lane(y, k), F.lit(LANE + 1))

    wide = F.zip_with(a["wide"], b["wide"], lambda x, y: (x + sign * y).bitwiseAND(F.lit(WIDE_MASK)))
    narrow = F.zip_with(a["narrow"], b["narrow"], lambda x, y: F.call_function("shiftleft", lane(x, y, 1), F.lit(32)).bitwiseOR(lane(x, y, 0)))
    return F.struct(wide.alias("wide"), narrow.alias("narrow"), (a["n"] + sign * b["n"]).alias("n"))


def _lane(v: Column, k: int) -> Column:
    return F.call_function("shiftright", v, F.lit(32 * k)).bitwiseAND(F.lit(LANE).cast("long"))


def spelled(print_: Column) -> Column:
    """Hexadecimal: the wide lanes, then the narrow ones, then the number of clauses."""
    longs = F.concat(print_["wide"], print_["narrow"])
    return F.lower(F.concat(F.array_join(F.transform(longs, lambda x: F.lpad(F.hex(x), 16, "0")), ""), F.lpad(F.hex(print_["n"].cast("long")), 8, "0")))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: 1 if all lanes are equal, else twice the multisets' inner product over the sum of their squares, as
    estimated from the lanes. For sets that is the share of clauses they have in common.

    A lane with c of n bits set stands for the sum 2 c - n of random signs; products of two such sums have the inner product
    as their mean.
    """
    ab, aa, bb = F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(2):
        x, y = _signs(a, k), _signs(b, k)
        ab, aa, bb = ab + _dot(x, y), aa + _dot(x, x), bb + _dot(y, y)
    both = aa + bb
    estimate = F.when(both == 0, F.lit(0.0)).otherwise(2 * ab / F.greatest(both, F.lit(1)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate)))


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0).cast("long"), lambda acc, v: acc + v)


def _signs(print_: Column, k: int) -> Column:
    """Sums of signs in the k-th lanes; a lane is known modulo 2^31, the sum therefore from -2^31 to 2^31 - 1."""
    half, whole = F.lit(1 << LANE_BITS).cast("long"), F.lit(1 << LANE_BITS + 1).cast("long")
    return F.transform(print_["narrow"], lambda v: F.pmod(2 * _lane(v, k) - print_["n"] + half, whole) - half)


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """range, guest, place, doc_id, text, next_text: the following document's text (null for guests that end a range).

    Rows are cut into ranges at quantiles of their ids (as many as the parameter says, whatever the table's size); an id, or the lack
    of one, that has more rows than a range should is cut by the hash of the text as well. The first row of a range also
    goes, as a guest, to the range before, so every row finds its follower in its own range.
    """
    spark = docs.sparkSession
    buckets = buckets or min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 20_000)
    texts = keyed_texts(docs).withColumns({"none": F.col("doc_id").isNull().cast("int"), "id": F.coalesce("doc_id", F.lit(0)), "h": F.xxhash64("text"), "h2": F.hash("text")})
    q = texts.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)] or [0.5], 20 * buckets).alias("q")).first()
    share = -(-q["n"] // buckets)
    low, whole = -(1 << 63), 1 << 64
    starts = {(0, low, low), *((0, x, low) for x in q["q"] or [])}
    for none, id_, n in texts.groupBy("none", "id").count().filter(F.col("count") > 2 * share).collect():  # half as many as ranges at most
        parts = -(-n // share)
        starts |= {(none, id_, low + i * whole // parts) for i in range(parts)}
    table = sorted(starts)  # a list of some times `buckets` starts at most
    n = len(table)
    nones, ids, hashes = (F.array(*map(F.lit, x)) for x in zip(*table, strict=True))

    def not_after(i: Column) -> Column:
        a, b, c = F.get(nones, i), F.get(ids, i), F.get(hashes, i)
        return (a < F.col("none")) | ((a == F.col("none")) & ((b < F.col("id")) | ((b == F.col("id")) & (c <= F.col("h")))))

    # binary search for the last start that isn't after the row
    steps = F.array(*(F.lit(1 << bit) for bit in reversed(range(n.bit_length()))))
    own = texts.withColumn("range", F.aggregate(steps, F.lit(0), lambda a, s: F.when((a + s < n) & not_after(a + s), a + s).otherwise(a)))
    order = ["none", "id", "h", "h2"]
    firsts = [(r["range"], *r["first"]) for r in own.groupBy("range").agg(F.min(F.struct(*order)).alias("first")).orderBy("range").collect()]  # a row for each range
    seats = spark.createDataFrame([(firsts[i - 1][0], *f) for i, f in enumerate(firsts)], "before int, range int, none int, id long, h long, h2 int")
    guests = own.join(F.broadcast(seats), ["range", *order]).dropDuplicates(["range"]).withColumn("range", F.col("before")).drop("before")
    seated = own.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    w = Window.partitionBy("range").orderBy("guest", *order)
    return seated.select("range", "guest", F.row_number().over(w).alias("place"), "doc_id", "text", F.lead("text").over(w).alias("next_text"))


def edited(text: Column, n: Column, following: Column) -> Column:
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def lane_sums(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, n and narrow for the text column of each row; keys must tell all rows apart."""
    clause = rows.select(*keys, F.explode_outer(clauses(F.col(text))).alias("_c"))
    hashed = clause.select(*keys, "_c", *(F.xxhash64(F.lit(SALT + q), "_c").alias(f"_h{q}") for q in range(HASHES)))
    bits = [(q, j) for q in range(HASHES) for j in range(LANES)]  # a long sums the bits j and j + 32
    sums = [F.sum(F.when(F.col("_c").isNull(), F.lit(0)).otherwise(F.call_function("shiftrightunsigned", F.col(f"_h{q}"), F.lit(j)).bitwiseAND(F.lit(ONE)))).bitwiseAND(F.lit(BOTH)).alias(f"_s{q}_{j}") for q, j in bits]
    summed = hashed.groupBy(*keys).agg(F.count("_c").cast("int").alias("n"), *sums)
    return summed.select(*keys, "n", F.array(*(f"_s{q}_{j}" for q, j in bits)).alias("narrow"))


def fingerprint_report(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = with_next(docs, buckets).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edit", F.coalesce(edited(F.col("text"), F.col("n_chars"), F.col("next_text")), F.lit("")))
    place = ["range", "place", "guest", "doc_id", "n_chars"]
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("text")), F.struct(F.lit(1).alias("side"), F.col("edit").alias("text")))
    each = rows.select(*place, F.explode(sides).alias("s")).select(*place, "s.side", "s.text")
    each = each.withColumn("sha", F.when(F.col("side") == 1, F.sha2("text", 256))).withColumn("_lines", digests(paragraphs(F.col("text"))))
    each = each.withColumn("wide", F.array(*(_wide(_hashes(F.col("_lines"), j)) for j in range(WIDE))))
    prints = lane_sums(each, "text", [*place, "side", "sha", "wide"]).withColumn("print", F.struct("wide", "narrow", "n"))
    w = Window.partitionBy("range").orderBy("place", "side")  # a text, its edited text, the next text, ...
    seen = prints.select("doc_id", "n_chars", "guest", "side", F.lead("sha").over(w).alias("edited_sha256"), F.col("print").alias("own"), F.lead("print").over(w).alias("other"), F.lead("print", 2).over(w).alias("next"))
    seen = seen.filter("side = 0 AND NOT guest")
    return seen.select("doc_id", "n_chars", "edited_sha256", spelled(F.col("own")).alias("fingerprint"), spelled(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))
