"""Stages, process and category queries over the driver's tables.

Stage ladder: the five order priorities. Bill: return flag; column of a workbook: line number; key: part.
Category: brand number modulo 4; workbook: line number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.numbers import cents_of
from tallyspark.operators import localfin, process, stages

from .ledger import CENTS, FY, fiscal_year, period, table

STAGES = 5
HAND_OFFS = [("house", 1, 2, 3, 4), ("senate", 1, 3, 4, 5), ("conference", 1, 4, 5, 6)]
CATEGORIES, NARROW = ["own_source", "shared", "reimbursement", "school_aid"], ["own_source", "shared"]


def points(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("item"), period(F.col("o_orderdate")).alias("period"), F.substring("o_orderpriority", 1, 1).cast("int").alias("stage"),
        F.when(F.col("o_orderstatus") != "P", cents_of(F.col("o_totalprice"))).alias("cents"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("version"), F.col("o_orderkey").alias("ref"),
    )


def described(rows: DataFrame) -> DataFrame:
    """Action, kind and actor of order lines."""
    return rows.withColumns({
        "action": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents_of(F.col("l_extendedprice"))),
        "kind": F.when(F.col("l_tax") < 0.005, "veto").otherwise("amendment"), "actor": F.concat(F.lit("actor-"), F.col("l_suppkey").cast("string")),
    })


def c12(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_tax")
    applies, modifies = (lines.withColumn(name, F.col(key)) for name, key in (("version", "l_orderkey"), ("ref", "l_partkey")))
    return stages.attributed(stages.steps(points(spark, sf_dir)), applies, modifies, described)


def a06(spark, sf_dir):
    rows = points(spark, sf_dir).where("cents is not null").select((F.col("item") * 10000 + F.substring("period", 3, 4).cast("int")).alias("code"), "stage", "cents", "ord")
    return stages.ladder_rollup(rows, STAGES)


def columns(spark, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("bill"), F.col("l_partkey").alias("key"), F.col("l_linenumber").alias("column"), F.floor(F.col("l_quantity")).cast("bigint").alias("cents"))
    return process.side_by_side(facts, ["bill", "key"], [1, 2, 3, 4, 5, 6])


def a12(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").select(fiscal_year(F.col("l_shipdate")).alias("year"), F.col("l_partkey").alias("key"), F.col("l_linenumber").alias("column"), cents_of(F.col("l_extendedprice")).alias("cents")).where("column <= 3")
    return process.adjustment_test(process.side_by_side(facts, ["year", "key"], [1, 2, 3]))


def cells(spark, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return localfin.chosen_cells(lines.select(
        F.col("l_linenumber").alias("workbook"), F.when((F.col("l_linestatus") == "F") | (fiscal_year(F.col("l_shipdate")) >= 2002), "actual").otherwise("enacted").alias("measure"), fiscal_year(F.col("l_shipdate")).alias("year"), F.col("p_brand").alias("code"), cents_of(F.col("l_extendedprice")).alias("cents"),
    ))


def a13(spark, sf_dir):
    number = F.regexp_extract("p_brand", r"([0-9]+)$", 1).cast("int")
    kinds = table(spark, sf_dir, "part").select(F.col("p_brand").alias("code"), F.element_at(F.array(*map(F.lit, CATEGORIES)), number % 4 + 1).alias("category")).distinct()
    return localfin.category_totals(cells(spark, sf_dir), kinds, CATEGORIES, NARROW)


def w20(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", cents_of(F.col("o_totalprice")).alias("cents"))
    return localfin.last_wins(rows, ["o_custkey", "o_orderpriority"], "o_orderkey", "cents")


def w21(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("column"), cents_of(F.col("l_extendedprice")).alias("cents"))
    return process.single_cells(facts, "l_orderkey").withColumnRenamed("column", "l_linenumber")


QUERIES = {
    "w02_stage_steps": lambda s, d: stages.steps(points(s, d)).drop("version", "ref"),
    "w03_series": lambda s, d: stages.series(points(s, d), STAGES),
    "c12_decompose": c12,
    "a06_stage_rollup": a06,
    "c15_conditioning": lambda s, d: process.conditioning(columns(s, d), HAND_OFFS),
    "c16_conference": lambda s, d: process.conference_position(columns(s, d), 4, 5, 6),
    "a12_adjustment": a12,
    "a15_chosen_cells": cells,
    "a13_category_totals": a13,
    "u03_actual_only_years": lambda s, d: localfin.actual_only_years(cells(s, d)),
    "w20_last_wins": w20,
    "w21_single_cells": w21,
    "a16_ambiguous_codes": lambda s, d: localfin.ambiguous_codes(table(s, d, "part").select(F.col("p_brand").alias("code"), F.col("p_name").alias("name"))),
}

POINTS = f"""pts AS (SELECT o_custkey AS item, 'FY' || {FY.format('o_orderdate')} AS period, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS stage, CASE WHEN o_orderstatus <> 'P' THEN {CENTS.format('o_totalprice')} END AS cents, o_orderkey AS ord FROM orders),
fst AS (SELECT * FROM pts QUALIFY row_number() OVER (PARTITION BY item, period, stage ORDER BY ord) = 1),
stp AS (SELECT *, lag(stage) OVER w AS from_stage, lag(cents) OVER w AS from_cents FROM fst WHERE cents IS NOT NULL WINDOW w AS (PARTITION BY item, period ORDER BY stage)),
steps AS (SELECT item, period, from_stage, stage AS to_stage, from_cents, cents AS to_cents, cents - from_cents AS delta_cents, array_to_string(range(from_stage + 1, stage), ',') AS skipped, ord FROM stp WHERE from_stage IS NOT NULL)"""
WIDE = """cell AS (SELECT l_returnflag AS bill, l_partkey AS key, l_linenumber AS col, CAST(floor(max(l_quantity)) AS BIGINT) AS cents FROM lineitem GROUP BY ALL HAVING count(*) = 1),
wide AS (SELECT bill, key, max(cents) FILTER (col = 1) AS c1, max(cents) FILTER (col = 2) AS c2, max(cents) FILTER (col = 3) AS c3, max(cents) FILTER (col = 4) AS c4, max(cents) FILTER (col = 5) AS c5, max(cents) FILTER (col = 6) AS c6 FROM cell GROUP BY ALL)"""
CELLS = f"""fact AS (SELECT l_linenumber AS workbook, CASE WHEN l_linestatus = 'F' OR {FY.format('l_shipdate')} >= 2002 THEN 'actual' ELSE 'enacted' END AS measure, CAST({FY.format('l_shipdate')} AS INTEGER) AS year, p_brand AS code, {CENTS.format('l_extendedprice')} AS cents FROM lineitem JOIN part ON l_partkey = p_partkey),
cells AS (SELECT measure, year, code, arg_max(cents, workbook) AS cents FROM (SELECT workbook, measure, year, code, max(cents) AS cents FROM fact GROUP BY ALL) GROUP BY ALL)"""
_HAND = " UNION ALL ".join(f"SELECT '{a}' AS actor, bill, c{b} AS base, c{p} AS prior, c{g} AS given, c{r} AS result FROM wide" for a, b, p, g, r in HAND_OFFS)
_PLACES = ", ".join(f"count(*) FILTER (place = '{p}') AS {p}, coalesce(round(CAST(sum(cents) FILTER (place = '{p}') AS DOUBLE) / CAST(sum(cents) AS DOUBLE) * 100, 4), 0) AS {p}_dollar_pct" for p in ("at_house", "at_senate", "between", "outside"))
_SUMS = ", ".join(f"sum(cents) FILTER (category = '{c}') AS {c}" for c in CATEGORIES)
_CATS = ", ".join(f"CAST(CASE WHEN measure = 'enacted' THEN coalesce({c}, 0) ELSE {c} END AS BIGINT) AS {c}" for c in CATEGORIES)
_MISS = ", ".join(f"CASE WHEN measure = 'actual' AND {c} IS NULL THEN '{c}' END" for c in CATEGORIES)
ORACLES = {
    "w02_stage_steps": f"WITH {POINTS} SELECT * EXCLUDE (ord) FROM steps",
    "w03_series": f"""WITH {POINTS} SELECT item, period, greatest(count(cents) - 1, 0) AS n_steps, arg_max(cents, stage) FILTER (cents IS NOT NULL) - arg_min(cents, stage) FILTER (cents IS NOT NULL) AS net_cents,
  array_to_string(list_filter([1, 2, 3, 4, 5], lambda x: NOT list_contains(coalesce(list(stage) FILTER (cents IS NOT NULL), []), x)), ',') AS missing,
  coalesce(max(stage) FILTER (cents IS NOT NULL) - min(stage) FILTER (cents IS NOT NULL) + 1 = count(cents), true) AS is_complete FROM fst GROUP BY item, period""",
    "c12_decompose": f"""WITH {POINTS}, act AS (SELECT DISTINCT l_orderkey, l_partkey, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, {CENTS.format('l_extendedprice')}) AS action, CASE WHEN l_tax < 0.005 THEN 'veto' ELSE 'amendment' END AS kind, 'actor-' || l_suppkey AS actor FROM lineitem),
f AS (SELECT s.item, s.period, s.to_stage, action, kind, actor FROM steps s JOIN act ON s.ord = l_orderkey
  UNION SELECT s.item, s.period, s.to_stage, action, kind, actor FROM steps s JOIN act ON s.ord = l_partkey),
b AS (SELECT item, period, to_stage, count(*) AS n, bool_or(kind = 'veto') AS veto, arg_min(actor, action) AS actor FROM f GROUP BY ALL)
SELECT s.item, s.period, s.to_stage, from_stage, from_cents, to_cents, delta_cents, skipped, coalesce(n, 0) AS n_actions, actor AS first_actor, skipped = '' AND coalesce(n, 0) > 0 AS is_attributed, coalesce(veto, false) AND delta_cents > 0 AS veto_with_rise
FROM steps s LEFT JOIN b ON s.item = b.item AND s.period = b.period AND s.to_stage = b.to_stage""",
    "a06_stage_rollup": f"""WITH {POINTS}, lastrow AS (SELECT item * 10000 + CAST(substr(period, 3, 4) AS INTEGER) AS code, stage, arg_max(cents, ord) AS cents FROM pts WHERE cents IS NOT NULL GROUP BY ALL),
d AS (SELECT a.code, a.stage AS from_stage, b.cents - a.cents AS d FROM lastrow a JOIN lastrow b ON a.code = b.code AND b.stage = a.stage + 1 WHERE b.cents <> a.cents),
g AS (SELECT from_stage, count(*) AS moved, count(*) FILTER (d > 0) AS raised, count(*) FILTER (d < 0) AS cut, sum(abs(d)) AS gross, sum(d) AS net, arg_min(code, (-d, code)) FILTER (d > 0) AS rise, arg_min(code, (d, code)) FILTER (d < 0) AS fall FROM d GROUP BY from_stage)
SELECT CAST(l.i AS INTEGER) AS from_stage, CAST(l.i + 1 AS INTEGER) AS to_stage, coalesce(moved, 0) AS moved, coalesce(raised, 0) AS raised, coalesce(cut, 0) AS cut, CAST(coalesce(gross, 0) AS BIGINT) AS gross_cents, CAST(coalesce(net, 0) AS BIGINT) AS net_cents, rise AS largest_rise, fall AS largest_cut,
  coalesce(round(CAST(gross AS DOUBLE) / CAST(sum(gross) OVER () AS DOUBLE) * 100, 4), 0) AS share_pct FROM (SELECT unnest(range(1, 5)) AS i) l LEFT JOIN g ON g.from_stage = l.i""",
    "c15_conditioning": f"""WITH {WIDE}, h AS ({_HAND}), m AS (SELECT *, result - given AS d, given - prior AS before, abs(result - base) - abs(given - base) AS nearer FROM h WHERE base IS NOT NULL AND prior IS NOT NULL AND given IS NOT NULL AND result <> given),
t AS (SELECT actor, coalesce(bill, 'pooled') AS bill, count(*) AS n, count(*) FILTER (before > 0 AND d > 0) AS raised_after_raise, count(*) FILTER (before > 0) AS after_raise, count(*) FILTER (before < 0 AND d > 0) AS raised_after_cut, count(*) FILTER (before < 0) AS after_cut,
  count(*) FILTER (nearer < 0) AS toward, count(*) FILTER (nearer > 0) AS away, count(*) FILTER (nearer = 0) AS same_distance, CAST(sum(abs(d)) AS BIGINT) AS gross_cents, CAST(sum(d) AS BIGINT) AS net_cents FROM m GROUP BY GROUPING SETS ((actor, bill), (actor)))
SELECT *, round((CAST(raised_after_cut AS DOUBLE) / nullif(after_cut, 0) - CAST(raised_after_raise AS DOUBLE) / nullif(after_raise, 0)) * 100, 6) AS reversal_gap_pp, round(CAST(toward AS DOUBLE) / nullif(toward + away, 0) * 100, 6) AS toward_pct FROM t""",
    "c16_conference": f"""WITH {WIDE}, r AS (SELECT bill, c4 AS h, c5 AS s, c6 AS c FROM wide WHERE c4 IS NOT NULL AND c5 IS NOT NULL AND c6 IS NOT NULL AND c4 <> c5),
p AS (SELECT unnest([bill, 'pooled']) AS bill, CASE WHEN c = h THEN 'at_house' WHEN c = s THEN 'at_senate' WHEN c > least(h, s) AND c < greatest(h, s) THEN 'between' ELSE 'outside' END AS place, abs(h - s) AS cents, round(CAST(c - s AS DOUBLE) / (h - s), 9) AS position FROM r)
SELECT bill, count(*) AS contested, CAST(sum(cents) AS BIGINT) AS contested_cents, {_PLACES}, list_sort(list(position))[count(*) // 2 + 1] AS median_position FROM p GROUP BY bill""",
    "a12_adjustment": f"""WITH cell AS (SELECT CAST({FY.format('l_shipdate')} AS INTEGER) AS year, l_partkey AS key, l_linenumber AS col, max({CENTS.format('l_extendedprice')}) AS cents FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL HAVING count(*) = 1),
w AS (SELECT year, key, max(cents) FILTER (col = 1) AS e, max(cents) FILTER (col = 2) AS j, max(cents) FILTER (col = 3) AS a FROM cell GROUP BY ALL HAVING e IS NOT NULL AND j IS NOT NULL AND a IS NOT NULL),
t AS (SELECT year, count(*) AS n, CAST(sum(abs(a - e)) AS BIGINT) AS distance_enacted, CAST(sum(abs(a - j)) AS BIGINT) AS distance_adjusted, count(*) FILTER (j <> e) AS adjusted, count(*) FILTER (j <> e AND abs(a - j) < abs(a - e)) AS toward, count(*) FILTER (j <> e AND abs(a - j) > abs(a - e)) AS away FROM w GROUP BY year)
SELECT *, round(CAST(distance_enacted - distance_adjusted AS DOUBLE) / nullif(distance_enacted, 0) * 100, 6) AS closed_pct, round(CAST(toward AS DOUBLE) / nullif(toward + away, 0) * 100, 6) AS toward_pct FROM t""",
    "a15_chosen_cells": f"WITH {CELLS} SELECT * FROM cells",
    "a13_category_totals": f"""WITH {CELLS}, j AS (SELECT *, ['own_source', 'shared', 'reimbursement', 'school_aid'][CAST(regexp_extract(code, '([0-9]+)$', 1) AS INTEGER) % 4 + 1] AS category FROM cells), g AS (SELECT measure, year, {_SUMS} FROM j GROUP BY measure, year)
SELECT measure, year, {_CATS}, concat_ws(',', {_MISS}) AS missing, CAST(coalesce(own_source, 0) + coalesce(shared, 0) AS BIGINT) AS narrow_cents, CAST(coalesce(own_source, 0) + coalesce(shared, 0) + coalesce(reimbursement, 0) + coalesce(school_aid, 0) AS BIGINT) AS wide_cents FROM g""",
    "u03_actual_only_years": f"WITH {CELLS} SELECT DISTINCT year FROM cells WHERE measure = 'actual' AND year NOT IN (SELECT year FROM cells WHERE measure = 'enacted')",
    "w20_last_wins": f"SELECT o_custkey, o_orderpriority, arg_max({CENTS.format('o_totalprice')}, o_orderkey) AS cents FROM orders GROUP BY ALL",
    "w21_single_cells": f"SELECT l_orderkey, l_linenumber, max({CENTS.format('l_extendedprice')}) AS cents FROM lineitem GROUP BY ALL HAVING count(*) = 1",
    "a16_ambiguous_codes": "SELECT p_brand AS code, CAST(count(DISTINCT p_name) AS INTEGER) AS n_names, string_agg(DISTINCT p_name, ' | ' ORDER BY p_name) AS names FROM part GROUP BY p_brand HAVING count(DISTINCT p_name) > 1",
}
