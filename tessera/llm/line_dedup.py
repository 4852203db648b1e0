"""Line dedup by the spread of a line over distinct sites.

Each line's sites go into a HyperLogLog sketch; sketches merge by aggregation. A line whose estimate is clearly above the
threshold is boilerplate; one whose estimate lies within the sketch's error of the threshold gets an exact distinct count.
Boilerplate lines are removed from every document. Given a test for copies, documents that mostly consist of such lines and
are copies of others stay whole, so that whoever drops the copies finds them alike.

A site is a source; a null source counts as one site. Null texts are empty. Repeated rows are treated alike, whether a
doc_id is null or not; ties don't arise, as a line is over the threshold or not. Empty tables give no rows. Very long texts
are read whole. Columns of docs named like the results (n_lines, n_removed, clean_text) are replaced, all others kept as
they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import forget, inside, outside, written
from tessera.llm.lines import hashed_lines, lines, without


def spread_lines(held: DataFrame, min_sites: int, lg_k: int = 12, deviations: float = 4.0) -> DataFrame:
    """h: hashes of lines that at least min_sites sites hold. held: _site and h of each line."""
    margin = math.ceil(deviations * 1.04 / math.sqrt(2**lg_k) * min_sites)
    sketches = held.groupBy("h").agg(F.hll_sketch_agg("_site", F.lit(lg_k)).alias("sites"))
    rough = written(sketches.select("h", F.hll_sketch_estimate("sites").alias("sites")).filter(F.col("sites") >= min_sites - margin))
    near = rough.filter(F.col("sites") <= min_sites + margin)
    exact = held.join(near.select("h"), "h", "left_semi").select("h", "_site").distinct().groupBy("h").count().filter(F.col("count") >= min_sites)
    return rough.filter(F.col("sites") > min_sites + margin).select("h").unionAll(exact.select("h"))


def line_dedup(docs: DataFrame, min_sites: int = 10, copies: Callable[[DataFrame], DataFrame] | None = None, most: float = 0.5) -> DataFrame:
    """docs with n_lines, n_removed and clean_text (without cross-site boilerplate).

    copies: of rows (doc_id, text) that lose more than the share `most` of their words the distinct doc_id and t (xxhash64 of
    the text) of those that are copies and stay whole.
    """
    text = F.coalesce("in_text", F.lit(""))
    own = inside(docs, "n_lines", "n_removed", "clean_text")
    rows = own.withColumns({"d": F.col("in_doc_id"), "t": F.xxhash64(text)})
    spots = rows.select("d", "t", F.xxhash64("in_source").alias("_site"), F.inline(F.filter(hashed_lines(text), lambda x: x["h"].isNotNull())))
    held = written(spots)
    spread = spread_lines(held, min_sites)
    hits = held.join(spread, "h").groupBy("d", "t").agg(F.collect_set("h").alias("gone"), F.sum("words").alias("lost"))
    if copies is not None:
        hits = written(hits)
        totals = held.groupBy(F.col("d").alias("td"), F.col("t").alias("tt")).agg(F.sum("words").alias("total"))
        crowded = hits.join(totals, F.col("d").eqNullSafe(F.col("td")) & (F.col("t") == F.col("tt"))).filter(F.col("lost") > most * F.col("total")).select("td", "tt")
        crowded = written(crowded)
        forget(held)  # hits has what is needed of it
        crowded_rows = rows.join(crowded, F.col("d").eqNullSafe(F.col("td")) & (F.col("t") == F.col("tt")), "left_semi")
        whole = written(copies(crowded_rows.select(F.col("d").alias("doc_id"), text.alias("text"))).select(F.col("doc_id").alias("wd"), F.col("t").alias("wt")))
        hits = hits.join(whole, F.col("d").eqNullSafe(F.col("wd")) & (F.col("t") == F.col("wt")), "left_anti")
    gone = hits.select(F.col("d").alias("hd"), F.col("t").alias("ht"), "gone")
    joined = rows.join(gone, F.col("d").eqNullSafe(F.col("hd")) & (F.col("t") == F.col("ht")), "left")
    removed = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size(F.filter(hashed_lines(text), lambda x: F.coalesce(F.array_contains(F.col("gone"), x["h"]), F.lit(False)))))
    out = joined.select(*own.columns, F.size(lines(text)).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), without(text, F.col("gone")).alias("clean_text"))
    return out.select(*outside(own), "n_lines", "n_removed", "clean_text")


LINE_ORACLE = r"""
WITH ln AS (SELECT doc_id, i, coalesce(source, chr(0)) AS site, part[i] AS line FROM
  (SELECT doc_id, source, part, unnest(range(1, len(part) + 1)) AS i
   FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS part FROM documents))),
nl AS (SELECT *, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[ \t\x0B\f\r]+', ' ', 'g')) AS n FROM ln),
spread AS (SELECT n FROM nl WHERE n <> '' GROUP BY n HAVING count(DISTINCT site) >= 10),
marked AS (SELECT nl.*, spread.n IS NOT NULL AS bad FROM nl LEFT JOIN spread ON nl.n = spread.n)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (bad))::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
