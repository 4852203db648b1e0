"""Lines of texts as columns: words, normal forms and hashes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed by the contract: the characters between words.
BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words of a text as an array; no words, an empty array."""
    plain = F.trim(F.translate(text, BLANKS[1:], " " * 5))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " +", -1))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def normal_lines(text: Column) -> Column:
    """Line by line: lower case, digits as 0, runs of blanks as one space, none at the ends."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "0"), "[ \t\x0b\x0c\r]+", " ")
    return F.transform(F.split(flat, "\n", -1), lambda x: F.trim(x))


def hashed_lines(text: Column) -> Column:
    """For each line struct(h, words); h is null where a line has no word."""
    return F.transform(normal_lines(text), lambda x: F.struct(F.when(x != "", F.xxhash64(x)).alias("h"), F.when(x != "", F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).otherwise(0).alias("words")))


def without(text: Column, gone: Column) -> Column:
    """The text without the lines whose hash is in gone; texts without such lines are left as they are."""
    hashes = F.transform(hashed_lines(text), lambda x: x["h"])
    kept = F.filter(F.arrays_zip(lines(text).alias("line"), hashes.alias("h")), lambda z: z["h"].isNull() | ~F.array_contains(gone, z["h"]))
    return F.when(F.coalesce(F.size(gone), F.lit(0)) == 0, text).otherwise(F.array_join(F.transform(kept, lambda z: z["line"]), "\n"))
