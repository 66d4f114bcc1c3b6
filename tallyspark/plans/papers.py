"""Document queries: pages, messages and budgetary lines written from the driver's rows, and line statistics over its tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.operators import documents as ops

from tallyspark.sources import pages

from . import fixtures as fx
from . import printed, vetoes
from .ledger import table

INSTRUCTIONS = fx.Drawn("ins", "id int, instruction string", list(enumerate([
    "On page #, delete “one two # three.”", 'On page 13 delete lines beginning with "A b" and ending with "y z".', "On page 14, begging with “start here” and continuing to the bottom of the page.", "On page 15, delete the whole section.", "On page 16, delete “broken",
    "On page 17, starting with nothing quoted and ending with “x#”.", "delete all #”", "On Page 9a, stating with “p” or ending with “q”",
])))
BUDGET = fx.Drawn("budget", "id int, line string", list(enumerate([
    "Dept of Parks|GRF 4#321 Operating|1,000.00|1,#.00|900.00|200.00", "Lakes GRF 2#50 River Aid|5.00|5.00|(1.00)|6.00", "Heading # only", "Parks GRF 4#321|1.00|2.00|1.00|5.00", "Total|1.00|2.00|1.00|1.00", "4#321 first|1.00|2.00|1.00|1.00", "Lakes GRF 2#50x River Aid|5.00|#.00|0.00|#.00",
])))


def line_marks(spark, sf_dir):
    """Printed lines: an order is a document, its line numbers are pages, the discount is the height on the page."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.floor(F.col("l_discount") * 20).alias("y"), F.concat("l_returnflag", "l_linestatus", F.floor("l_quantity").cast("string")).alias("text"),
    )


def carried(spark, sf_dir):
    pages = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("page"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("rules"))
    return ops.carried_rules(pages)


def islands(spark, sf_dir):
    """Runs of days on which a user has events."""
    days = table(spark, sf_dir, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("day")).distinct()
    rows = days.withColumn("island", F.col("day") - F.row_number().over(W.partitionBy("user_id").orderBy("day")))
    return rows.groupBy("user_id", "island").agg(F.min("day").alias("first_day"), F.count("*").cast("int").alias("days")).drop("island")


def sessions(spark, sf_dir):
    """Entries of a conversation: each user turn starts one."""
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("line_no"), "role", "text")
    parts = ops.segments(lines, F.coalesce(F.col("role") == "user", F.lit(False)))
    return parts.groupBy(F.col("doc").alias("conv_id"), "segment").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


QUERIES = {
    "f28_deletions": lambda s, d: ops.deletions(INSTRUCTIONS.frame(s, d)).drop("instruction"),
    "w18_veto_items": lambda s, d: ops.veto_items(vetoes.lines(s, d)),
    "a27_missing_numbers": lambda s, d: ops.missing_numbers(ops.veto_items(vetoes.lines(s, d))),
    "c28_budget_rows": lambda s, d: ops.budget_rows(BUDGET.frame(s, d).select("id", F.split("line", "\\|").alias("cells"))),
    "c26_page_cells": lambda s, d: ops.cells(pages.page_glyphs(printed.pages(s, d))),
    "w13_carry_forward": carried,
    "w11_islands": islands,
    "w16_sessions": sessions,
    "a24_repeated_lines": lambda s, d: ops.running_lines(line_marks(s, d)),
    "j38_without_running_lines": lambda s, d: ops.without_running_lines(line_marks(s, d)),
}
RUNNING_SQL = """marks AS (SELECT l_orderkey AS doc, l_linenumber AS page, CAST(floor(l_discount * 20) AS BIGINT) AS y, l_returnflag || l_linestatus || CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) AS text,
  regexp_replace(l_returnflag || l_linestatus || CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR), '[0-9]', '#', 'g') AS key FROM lineitem),
own AS (SELECT doc, count(DISTINCT page) AS pages FROM marks GROUP BY doc),
heads AS (SELECT m.doc, y, key, count(DISTINCT page) AS n FROM marks m JOIN own ON own.doc = m.doc GROUP BY m.doc, y, key, pages HAVING count(DISTINCT page) >= greatest(pages // 2, 2))"""
_VETO = f"""{vetoes.PRINTED}, t AS (SELECT *, TRY_CAST(nullif(regexp_extract(trim(text), '^ITEM NUMBER\\s+([0-9]+)(\\s|$)', 1), '') AS INTEGER) AS num FROM l), s AS (SELECT *, sum(CAST(num IS NOT NULL AS INTEGER)) OVER (PARTITION BY doc ORDER BY line_no) AS segment FROM t)"""
ORACLES = {
    "f28_deletions": f"""WITH {INSTRUCTIONS.sql()}, {vetoes.CUTS.replace(vetoes.CUTS[: vetoes.CUTS.index("cut1 AS")], "cut0 AS (SELECT id AS doc, 0 AS segment, 0 AS item_number, 0 AS place, instruction FROM ins), ")}
SELECT CAST(doc AS INTEGER) AS id, kind, bill_page, text, begins, ends, quotes_repaired FROM cuts""",
    "w18_veto_items": f"WITH {_VETO} SELECT doc, CAST(segment AS BIGINT) AS segment, max(num) AS item_number, string_agg(trim(text), chr(10) ORDER BY line_no) AS lines FROM s WHERE segment > 0 GROUP BY doc, segment",
    "a27_missing_numbers": f"WITH {_VETO}, n AS (SELECT DISTINCT doc, num FROM s WHERE num IS NOT NULL), e AS (SELECT doc, unnest(range(min(num), max(num) + 1)) AS item_number FROM n GROUP BY doc) SELECT doc, CAST(item_number AS INTEGER) AS item_number FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc = e.doc AND n.num = e.item_number)",
    "c28_budget_rows": f"""WITH {BUDGET.sql()}, r AS (SELECT id, string_split(line, '|') AS c FROM budget),
m AS (SELECT *, CASE WHEN len(c) >= 4 THEN list_transform(c[len(c) - 3:], lambda x: CASE WHEN regexp_full_match(trim(x), '[(]?[0-9,]+[.][0-9][0-9][)]?') THEN CAST(regexp_replace(x, '[^0-9]', '', 'g') AS BIGINT) * CASE WHEN x LIKE '(%' THEN -1 ELSE 1 END END) END AS money,
  list_filter(string_split(array_to_string(c[:greatest(len(c) - 4, 0)], ' '), ' '), lambda t: t <> '') AS tokens FROM r),
k AS (SELECT *, len(money) = 4 AND len(list_filter(money, lambda x: x IS NULL)) = 0 AS known, list_position(list_transform(tokens, lambda t: regexp_full_match(t, '[A-Za-z0-9]{{6}}') AND regexp_matches(t, '[0-9]')), true) AS pos FROM m),
o AS (SELECT *, CASE WHEN known IS NOT TRUE THEN 'skipped' WHEN money[4] <> money[2] - money[3] THEN 'problem' WHEN coalesce(pos, 0) < 2 THEN 'skipped' ELSE 'row' END AS outcome FROM k)
SELECT id, outcome, CASE WHEN outcome = 'row' THEN array_to_string(tokens[:pos - 2], ' ') END AS agency, CASE WHEN outcome = 'row' THEN tokens[pos - 1] END AS fund, CASE WHEN outcome = 'row' THEN tokens[pos] END AS code, CASE WHEN outcome = 'row' THEN array_to_string(tokens[pos + 1:], ' ') END AS name,
  CASE WHEN outcome = 'row' THEN money[1] END AS original_cents, CASE WHEN outcome = 'row' THEN money[2] END AS final_cents, CASE WHEN outcome = 'row' THEN money[3] END AS actual_cents, CASE WHEN outcome = 'row' THEN money[2] - money[3] END AS unspent_cents FROM o""",
    "c26_page_cells": f"{printed.WITH} SELECT * FROM cell",
    "w13_carry_forward": "SELECT user_id AS doc, event_id AS page, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rules FROM events",
    "w11_islands": "WITH d AS (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events), i AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS island FROM d) SELECT user_id, CAST(min(day) AS INTEGER) AS first_day, CAST(count(*) AS INTEGER) AS days FROM i GROUP BY user_id, island",
    "w16_sessions": "WITH s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS segment FROM conversations) SELECT conv_id, CAST(segment AS BIGINT) AS segment, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM s GROUP BY conv_id, segment",
    "a24_repeated_lines": f"WITH {RUNNING_SQL} SELECT doc, y, key, n FROM heads",
    "j38_without_running_lines": f"WITH {RUNNING_SQL} SELECT doc, page, y, text FROM marks m WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h.doc = m.doc AND h.y = m.y AND h.key = m.key)",
}
