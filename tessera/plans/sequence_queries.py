"""WIN06-12 and the range-style join on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sequences as S
from tessera.registry import query

SIZES = "length(text)"


@query("win06_history_trim", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s FROM conversations) WHERE s <= 600")
def win06(t):
    return S.trim_history(t.conversations, "conv_id", "turn", F.length("text"), 600).select("conv_id", "turn")


@query(
    "win07_pack",
    """WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
    f AS (SELECT conv_id, turn, r, 0 AS batch, s AS used FROM o WHERE r = 1 UNION ALL
      SELECT o.conv_id, o.turn, o.r, CASE WHEN f.used > 0 AND f.used + o.s > 500 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.used > 0 AND f.used + o.s > 500 THEN o.s ELSE f.used + o.s END
      FROM f JOIN o ON o.conv_id = f.conv_id AND o.r = f.r + 1) SELECT conv_id, turn, batch FROM f""",
)
def win07(t):
    return S.pack_batches(t.conversations, "conv_id", "turn", F.length("text"), 500)


@query(
    "win08_budget",
    """WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
    f AS (SELECT conv_id, turn, r, s <= 400 AS took, CASE WHEN s <= 400 THEN s ELSE 0 END AS used FROM o WHERE r = 1 UNION ALL
      SELECT o.conv_id, o.turn, o.r, f.used + o.s <= 400, CASE WHEN f.used + o.s <= 400 THEN f.used + o.s ELSE f.used END
      FROM f JOIN o ON o.conv_id = f.conv_id AND o.r = f.r + 1) SELECT conv_id, turn FROM f WHERE took""",
)
def win08(t):
    return S.fill_budget(t.conversations, "conv_id", "turn", F.length("text"), 400)


#: All conversations as one group, in the order of conversation and turn.
_ONE = "(SELECT conv_id * 1000 + turn AS o, length(text) AS s, row_number() OVER (ORDER BY conv_id * 1000 + turn, length(text)) AS r FROM conversations)"


@query(
    "win07_one_group",
    f"""WITH RECURSIVE n AS {_ONE}, f AS (SELECT o, r, 0 AS batch, s AS used FROM n WHERE r = 1 UNION ALL
      SELECT n.o, n.r, CASE WHEN f.used > 0 AND f.used + n.s > 3000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.used > 0 AND f.used + n.s > 3000 THEN n.s ELSE f.used + n.s END
      FROM f JOIN n ON n.r = f.r + 1) SELECT o, batch FROM f""",
)
def win07_one(t):
    """A group too large for one row, as the limit given says: in blocks."""
    rows = t.conversations.select(F.lit(0).alias("g"), (F.col("conv_id") * 1000 + F.col("turn")).alias("o"), "text")
    return S.pack_batches(rows, "g", "o", F.length("text"), 3000, most_rows=100).select("o", "batch")


@query(
    "win08_one_group",
    f"""WITH RECURSIVE n AS {_ONE}, f AS (SELECT o, r, s <= 20000 AS took, CASE WHEN s <= 20000 THEN s ELSE 0 END AS used FROM n WHERE r = 1 UNION ALL
      SELECT n.o, n.r, f.used + n.s <= 20000, CASE WHEN f.used + n.s <= 20000 THEN f.used + n.s ELSE f.used END FROM f JOIN n ON n.r = f.r + 1) SELECT o FROM f WHERE took""",
)
def win08_one(t):
    rows = t.conversations.select(F.lit(0).alias("g"), (F.col("conv_id") * 1000 + F.col("turn")).alias("o"), "text")
    return S.fill_budget(rows, "g", "o", F.length("text"), 20000, most_rows=100).select("o")


@query(
    "win09_central_diff",
    "SELECT user_id, event_id, round(-(lead(value) OVER w - lag(value) OVER w) / nullif(lead(event_id) OVER w - lag(event_id) OVER w, 0), 9) + 0.0 AS slope FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
)
def win09(t):
    return S.central_difference(t.events, "user_id", "event_id", "value").select("user_id", "event_id", (F.round("slope", 9) + 0.0).alias("slope"))


@query("win10_neighbours", "SELECT conv_id, turn, substr(lag(text) OVER w, 1, 80) AS before, substr(lead(text) OVER w, 1, 80) AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def win10(t):
    return S.neighbours(t.conversations, "conv_id", "turn", "text", 80).select("conv_id", "turn", "before", "after")


@query("win11_carried_heading", "SELECT conv_id, turn, arg_max(CASE WHEN role = 'user' THEN turn END, CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS heading FROM conversations")
def win11(t):
    return S.carried(t.conversations, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")), "heading").select("conv_id", "turn", "heading")


LINES_SQL = "(SELECT doc_id, part[i] AS line, i - 1 AS line_no FROM (SELECT doc_id, part, unnest(range(1, len(part) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS part FROM documents)))"


def lines(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query("win12_context_lines", f"WITH l AS {LINES_SQL} SELECT DISTINCT l.doc_id, l.line_no FROM l JOIN l h ON l.doc_id = h.doc_id AND abs(l.line_no - h.line_no) <= 2 WHERE contains(h.line, 'icense')")
def win12(t):
    rows = lines(t)
    return S.around(rows, rows.filter(F.col("line").contains("icense")), "doc_id", "line_no", 2).select("doc_id", F.col("line_no").cast("long").alias("line_no"))


@query("jon23_range_join", f"WITH l AS {LINES_SQL} SELECT l.doc_id, h.line_no AS first, count(*) AS n, sum(length(l.line))::BIGINT AS chars FROM l JOIN l h ON l.doc_id = h.doc_id AND l.line_no BETWEEN h.line_no AND h.line_no + 3 WHERE contains(h.line, 'icense') GROUP BY ALL")
def jon23(t):
    rows = lines(t)
    spans = rows.filter(F.col("line").contains("icense")).select("doc_id", F.col("line_no").alias("first"), (F.col("line_no") + 3).alias("last"))
    return S.within(rows, spans, "doc_id", "line_no").groupBy("doc_id", F.col("first").cast("long").alias("first")).agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))
