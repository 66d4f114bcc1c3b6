"""The driver's tables read as a ledger, and the queries of the authority/outturn comparison.

Line item: customer and order priority. Authority: order totals; an order with status P is still open.
Outturn: lineitem amounts by the order's fiscal year (July to June); return flag R is a recipient slice, line
status tells the basis, and a combination of high discount and tax stands for an unreadable amount.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.numbers import cents_of
from tallyspark.operators import gap as ops


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fiscal_year(date: Column) -> Column:
    return F.year(date) + F.when(F.month(date) >= 7, 1).otherwise(0)


def period(date: Column) -> Column:
    return F.concat(F.lit("FY"), fiscal_year(date).cast("string"))


def line_item() -> Column:
    return F.concat(F.col("o_custkey").cast("string"), F.lit("/"), F.substring("o_orderpriority", 1, 1))


def start_year(label: str = "period") -> Column:
    """First year of a period label; the largest int where there is none."""
    return F.coalesce(F.regexp_extract(label, r"^(?:FY)*([0-9]+)(?:[- ].*)?$", 1).try_cast("int"), F.lit(2147483647))


def authority(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        line_item().alias("item"), period(F.col("o_orderdate")).alias("period"), cents_of(F.col("o_totalprice")).alias("cents"),
        F.when(F.col("o_orderstatus") == "P", "open").otherwise("ok").alias("state"), F.struct(F.col("o_orderkey").alias("a"), F.lit(0).cast("bigint").alias("b")).alias("ord"),
    )


def outturn(spark, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", line_item().alias("item"), period(F.col("o_orderdate")).alias("period"))
    lines = table(spark, sf_dir, "lineitem")
    ugly = (F.col("l_discount") > 0.085) & (F.col("l_tax") > 0.075)
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        "item", "period", cents_of(F.col("l_extendedprice")).alias("cents"), F.when(ugly, "bad").otherwise("ok").alias("state"),
        F.struct(F.col("l_orderkey").alias("a"), F.col("l_linenumber").cast("bigint").alias("b")).alias("ord"),
        F.when(F.col("l_linestatus") == "F", "actual-closed").otherwise("disbursed").alias("basis"), (F.col("l_returnflag") == "R").alias("is_slice"),
        F.when(F.col("l_quantity") > 40, F.col("l_quantity").cast("bigint")).alias("reversion_cents"),
    )


def gaps(spark, sf_dir: str) -> DataFrame:
    return ops.gap(authority(spark, sf_dir), outturn(spark, sf_dir))


FY = "(year({0}) + CASE WHEN month({0}) >= 7 THEN 1 ELSE 0 END)"
CENTS = "CAST(round({0} * 100) AS BIGINT)"

LEDGER_SQL = f"""
auth AS (SELECT CAST(o_custkey AS VARCHAR) || '/' || substr(o_orderpriority, 1, 1) AS item, 'FY' || {FY.format('o_orderdate')} AS period,
    {CENTS.format('o_totalprice')} AS cents, CASE WHEN o_orderstatus = 'P' THEN 'open' ELSE 'ok' END AS state, o_orderkey AS oa FROM orders),
outt AS (SELECT CAST(o_custkey AS VARCHAR) || '/' || substr(o_orderpriority, 1, 1) AS item, 'FY' || {FY.format('o_orderdate')} AS period,
    {CENTS.format('l_extendedprice')} AS cents, CASE WHEN l_discount > 0.085 AND l_tax > 0.075 THEN 'bad' ELSE 'ok' END AS state, l_orderkey AS oa, l_linenumber AS ob,
    CASE WHEN l_linestatus = 'F' THEN 'actual-closed' ELSE 'disbursed' END AS basis, l_returnflag = 'R' AS is_slice,
    CASE WHEN l_quantity > 40 THEN CAST(l_quantity AS BIGINT) END AS rev
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""
GAP_SQL = f"""{LEDGER_SQL},
a AS (SELECT item, period, count(*) AS n, sum(cents) AS cents, arg_min(state, oa) FILTER (state <> 'ok') AS bad FROM auth GROUP BY ALL),
e AS (SELECT item, period, count(*) FILTER (NOT is_slice) AS whole, count(*) FILTER (is_slice) AS slices, count(DISTINCT basis) FILTER (NOT is_slice) AS nb,
    min(basis) FILTER (NOT is_slice) AS basis, sum(cents) FILTER (NOT is_slice) AS cents, sum(rev) FILTER (NOT is_slice) AS rev, min(state) FILTER (NOT is_slice AND state <> 'ok') AS bad FROM outt GROUP BY ALL),
o AS (SELECT e.item, e.period, e.basis, e.slices, e.rev, a.cents AS ac, e.cents AS ec,
    CASE WHEN a.n IS NULL THEN 'unavailable' WHEN whole = 0 THEN 'refused' WHEN nb > 1 THEN 'refused' WHEN a.bad = 'open' THEN 'unavailable' WHEN e.bad IS NOT NULL THEN 'refused' ELSE 'computed' END AS status,
    CASE WHEN a.n IS NULL THEN 'one_side_missing' WHEN whole = 0 THEN 'recipient_slice_only' WHEN nb > 1 THEN 'mixed_bases' WHEN a.bad = 'open' THEN 'authority_open' WHEN e.bad IS NOT NULL THEN 'outturn_unparsed' END AS reason_code
  FROM e LEFT JOIN a ON e.item = a.item AND e.period = a.period),
gap AS (SELECT item, period, status, reason_code, CASE WHEN status = 'computed' THEN CAST(ac AS BIGINT) END AS appropriated_cents,
    CASE WHEN status = 'computed' THEN CAST(ec AS BIGINT) END AS spent_cents, CASE WHEN status = 'computed' THEN CAST(ac - ec AS BIGINT) END AS variance_cents,
    CASE WHEN status = 'computed' AND ac <> 0 THEN round(CAST(ac - ec AS DOUBLE) / CAST(ac AS DOUBLE) * 100, 6) END AS variance_pct,
    CASE WHEN status = 'computed' THEN CAST(rev AS BIGINT) END AS reversion_cents, CASE WHEN status = 'computed' THEN coalesce(basis, '[open]') END AS basis,
    CASE WHEN status = 'computed' THEN coalesce(basis = 'disbursed', false) END AS provisional, CASE WHEN status = 'computed' THEN slices END AS slices_excluded,
    CASE WHEN status = 'computed' AND (ac = 0) <> (ec = 0) THEN 'one_side_zero' END AS anomaly FROM o)
"""

#: Character of a line item, read from the market segment of its customer.
FORMULA, MATCHED = ("BUILDING", "MACHINERY"), ("AUTOMOBILE",)


def a05_character(spark, sf_dir):
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("_cust"), ops.character(F.col("c_mktsegment").isin(*FORMULA), F.col("c_mktsegment").isin(*MATCHED)).alias("character"))
    rows = gaps(spark, sf_dir).withColumn("_cust", F.substring_index("item", "/", 1)).join(who, "_cust")
    return ops.character_distribution(rows)


def c03_coverage(spark, sf_dir):
    return outturn(spark, sf_dir).select("item", "period").distinct()


def p05_recipient_partition(spark, sf_dir):
    rows = outturn(spark, sf_dir)
    return rows.groupBy("period").agg(F.count_if("is_slice").alias("slices"), F.count_if(~F.col("is_slice")).alias("whole_lines"), F.sum(F.when(F.col("is_slice"), F.col("cents"))).alias("slice_cents"))


def a30_outcome_counts(spark, sf_dir):
    return gaps(spark, sf_dir).groupBy("status", "reason_code").agg(F.count("*").alias("pairs"))


def o06_headline(spark, sf_dir):
    rows = gaps(spark, sf_dir).where("status = 'computed'")
    return rows.orderBy(F.abs("variance_cents").desc(), "period", "item").limit(1).select("item", "period", "variance_cents", "variance_pct")


def w01_adjacent(spark, sf_dir):
    return ops.adjacent_periods(gaps(spark, sf_dir), start_year()).select("item", "period", "to_period", "status", "to_status")


def c02_succession(spark, sf_dir):
    """Each item is declared to be succeeded by the next customer's item, and by its own with the lowest priority."""
    base = gaps(spark, sf_dir)
    zeroed = base.withColumn("anomaly", F.when(F.col("variance_pct") < -500, "one_side_zero"))
    links = base.select("item").distinct().select("item", F.explode(F.array(
        F.struct(F.lit(1).alias("pos"), F.concat(F.substring_index("item", "/", 1), F.lit("/5")).alias("counterpart")),
        F.struct(F.lit(0).alias("pos"), F.concat((F.substring_index("item", "/", 1).cast("bigint") + 1).cast("string"), F.lit("/"), F.substring_index("item", "/", -1)).alias("counterpart")),
    )).alias("l")).select("item", "l.pos", "l.counterpart")
    real = links.join(base.select(F.col("item").alias("counterpart")).distinct(), "counterpart", "left_semi")
    return ops.succession_anomaly(zeroed, real)


QUERIES = {
    "c01_gap": lambda spark, sf_dir: gaps(spark, sf_dir),
    "c02_succession_anomaly": c02_succession,
    "c03_coverage": c03_coverage,
    "c06_gap_summary": lambda spark, sf_dir: ops.summary(gaps(spark, sf_dir)),
    "a05_character_upper_median": a05_character,
    "a30_outcome_counts": a30_outcome_counts,
    "p05_recipient_partition": p05_recipient_partition,
    "o06_headline_top1": o06_headline,
    "w01_adjacent_periods": w01_adjacent,
}
START = "CAST(substr(period, 3) AS INTEGER)"
ADJ_SQL = f"""{GAP_SQL}, adj AS (SELECT *, lead(period) OVER w AS to_period, lead(status) OVER w AS to_status, lead(reason_code) OVER w AS to_reason, lead(variance_cents) OVER w AS to_variance
  FROM gap WINDOW w AS (PARTITION BY item ORDER BY {START}, period))"""


ORACLES = {
    "c01_gap": f"WITH {GAP_SQL} SELECT * FROM gap",
    "c02_succession_anomaly": f"""WITH {GAP_SQL}, items AS (SELECT DISTINCT item, CAST(split_part(item, '/', 1) AS BIGINT) AS c, split_part(item, '/', 2) AS p FROM gap)
SELECT gap.item, period, coalesce(n.item, l.item, 'none declared') AS counterpart FROM gap JOIN items ON gap.item = items.item
LEFT JOIN items n ON n.item = CAST(items.c + 1 AS VARCHAR) || '/' || items.p LEFT JOIN items l ON l.item = CAST(items.c AS VARCHAR) || '/5' WHERE variance_pct < -500""",
    "c03_coverage": f"WITH {LEDGER_SQL} SELECT DISTINCT item, period FROM outt",
    "c06_gap_summary": f"""WITH {GAP_SQL} SELECT count(*) AS pairs, CAST(sum(appropriated_cents) AS BIGINT) AS appropriated_cents, CAST(sum(spent_cents) AS BIGINT) AS spent_cents,
  count(*) FILTER (variance_pct < 0) AS overspent, round(CAST(sum(appropriated_cents) - sum(spent_cents) AS DOUBLE) / CAST(sum(appropriated_cents) AS DOUBLE) * 100, 4) AS variance_pct FROM gap WHERE status = 'computed'""",
    "a05_character_upper_median": f"""WITH {GAP_SQL}, c AS (SELECT gap.*, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'entitlement' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'formula' ELSE 'unclassified' END AS character
  FROM gap JOIN customer ON split_part(item, '/', 1) = CAST(c_custkey AS VARCHAR) WHERE status = 'computed' AND variance_pct IS NOT NULL)
SELECT character, count(*) AS pairs, list_sort(list(variance_pct))[count(*) // 2 + 1] AS median_pct, round(avg(abs(variance_pct)), 4) AS mean_abs_pct,
  count(*) FILTER (abs(variance_pct) < 1) AS within_one, count(*) FILTER (abs(variance_pct) > 5) AS beyond_five FROM c GROUP BY character""",
    "a30_outcome_counts": f"WITH {GAP_SQL} SELECT status, reason_code, count(*) AS pairs FROM gap GROUP BY ALL",
    "p05_recipient_partition": f"WITH {LEDGER_SQL} SELECT period, count(*) FILTER (is_slice) AS slices, count(*) FILTER (NOT is_slice) AS whole_lines, CAST(sum(cents) FILTER (is_slice) AS BIGINT) AS slice_cents FROM outt GROUP BY period",
    "o06_headline_top1": f"WITH {GAP_SQL} SELECT item, period, variance_cents, variance_pct FROM gap WHERE status = 'computed' ORDER BY abs(variance_cents) DESC, period, item LIMIT 1",
    "w01_adjacent_periods": f"WITH {ADJ_SQL} SELECT item, period, to_period, status, to_status FROM adj WHERE to_period IS NOT NULL",
}
