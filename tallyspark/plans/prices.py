"""Price series of the driver's tables and the queries that restate amounts with it.

Primary series: monthly mean unit price of all lines; alternate: of lines with status F. Base period FY1998.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators import deflate as ops

from .ledger import CENTS, FY, table

BASE = "FY1998"


def observations(spark, sf_dir: str) -> DataFrame:
    """series, year, month, value: means over whole cents, so that both engines add up the same integers."""
    lines = table(spark, sf_dir, "lineitem").select("l_shipdate", F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("bigint").alias("unit"), "l_linestatus")
    by = ["series", F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")]
    rows = lines.select("l_shipdate", "unit", F.explode(F.when(F.col("l_linestatus") == "F", F.array(F.lit("all"), F.lit("closed"))).otherwise(F.array(F.lit("all")))).alias("series"))
    return rows.groupBy(*by).agg((F.sum("unit") / F.count("*")).alias("value"))


def factors(spark, sf_dir: str, series: str = "all") -> DataFrame:
    return ops.deflator(ops.fiscal_index(observations(spark, sf_dir)), BASE).where(F.col("series") == series).select("period", "factor")


def nation_points(spark, sf_dir: str) -> DataFrame:
    """item, period, cents: yearly order totals of each nation; nation 3 also has a biennial label."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    year = F.year("o_orderdate") + F.when(F.month("o_orderdate") >= 7, 1).otherwise(0)
    label = F.when((F.col("c_nationkey") == 3) & (year == 1999), "FY1999-00").otherwise(F.concat(F.lit("FY"), year.cast("string")))
    return rows.groupBy(F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("item"), label.alias("period")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))


def c11(spark, sf_dir):
    return ops.real_series(nation_points(spark, sf_dir), factors(spark, sf_dir), factors(spark, sf_dir, "closed"))


def c08(spark, sf_dir):
    rows = nation_points(spark, sf_dir).join(factors(spark, sf_dir), "period", "left")
    return rows.select("item", "period", "cents", F.when(F.col("factor").isNull(), "period_not_in_index").alias("reason_code"), ops.deflate(F.col("cents"), F.col("factor")).alias("real_cents"))


QUERIES = {
    "s15_price_months": lambda spark, sf_dir: observations(spark, sf_dir).withColumn("value", F.round("value", 6)),
    "a18_fiscal_index": lambda spark, sf_dir: ops.fiscal_index(observations(spark, sf_dir)).withColumn("index", F.round("index", 6)),
    "a19_cadence": lambda spark, sf_dir: ops.cadence(observations(spark, sf_dir)),
    "c08_deflate": c08,
    "c10_deflator": lambda spark, sf_dir: ops.deflator(ops.fiscal_index(observations(spark, sf_dir)), BASE).withColumn("factor", F.round("factor", 9)),
    "c11_real_series": c11,
}

OBS_SQL = """
units AS (SELECT l_shipdate, CAST(round(l_extendedprice * 100 / l_quantity) AS BIGINT) AS unit, unnest(CASE WHEN l_linestatus = 'F' THEN ['all', 'closed'] ELSE ['all'] END) AS series FROM lineitem),
obs AS (SELECT series, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, CAST(sum(unit) AS DOUBLE) / count(*) AS value FROM units GROUP BY ALL),
lagged AS (SELECT *, year * 12 + month - lag(year * 12 + month) OVER (PARTITION BY series ORDER BY year, month) AS gap FROM obs),
cad AS (SELECT series, min(gap) AS months, CASE WHEN min(gap) % 12 = 0 THEN 1 WHEN min(gap) IN (1, 3, 6) THEN 12 // min(gap) END AS per_year FROM lagged WHERE gap > 0 GROUP BY series),
idx AS (SELECT series, 'FY' || fy AS period, CASE WHEN n = per_year THEN mean END AS index, n AS observed, per_year AS wanted
  FROM (SELECT series, year + CASE WHEN month >= 7 THEN 1 ELSE 0 END AS fy, count(*) AS n, avg(value) AS mean FROM obs GROUP BY ALL) JOIN cad USING (series)),
bases AS (SELECT series, max(CASE WHEN period = 'FY1998' THEN index END) AS base, min(index) AS least FROM idx GROUP BY series),
allfactors AS (SELECT series, period, base / index AS factor FROM idx JOIN bases USING (series) WHERE index IS NOT NULL AND base IS NOT NULL AND least > 0)
"""
FACTORS_SQL = f"{OBS_SQL}, factors AS (SELECT period, factor FROM allfactors WHERE series = 'all'), factors2 AS (SELECT period, factor FROM allfactors WHERE series = 'closed')"
POINTS_SQL = f"""points AS (SELECT 'nation-' || c_nationkey AS item, CASE WHEN c_nationkey = 3 AND fy = 1999 THEN 'FY1999-00' ELSE 'FY' || fy END AS period, CAST(sum(cents) AS BIGINT) AS cents
  FROM (SELECT c_nationkey, {FY.format('o_orderdate')} AS fy, {CENTS.format('o_totalprice')} AS cents FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1, 2)"""
ORACLES = {
    "s15_price_months": f"WITH {OBS_SQL} SELECT series, year, month, round(value, 6) AS value FROM obs",
    "a18_fiscal_index": f"WITH {OBS_SQL} SELECT series, period, round(index, 6) AS index, observed, CAST(wanted AS INTEGER) AS wanted FROM idx",
    "a19_cadence": f"WITH {OBS_SQL} SELECT series, CAST(months AS INTEGER) AS months, CAST(per_year AS INTEGER) AS per_year FROM cad",
    "c08_deflate": f"WITH {FACTORS_SQL}, {POINTS_SQL} SELECT item, period, cents, CASE WHEN factor IS NULL THEN 'period_not_in_index' END AS reason_code, CAST(round(cents * factor) AS BIGINT) AS real_cents FROM points LEFT JOIN factors USING (period)",
    "c10_deflator": f"WITH {OBS_SQL} SELECT series, period, round(factor, 9) AS factor FROM allfactors",
    "c11_real_series": f"""WITH {FACTORS_SQL}, {POINTS_SQL},
r AS (SELECT item, period, cents, f.factor AS f, CAST(round(cents * f.factor) AS BIGINT) AS real, CAST(round(cents * g.factor) AS BIGINT) AS real2, CASE WHEN regexp_matches(period, '^[^-]*-[0-9]+$') THEN 'b' ELSE 'a' END AS kind,
  CAST(substr(period, 3, 4) AS INTEGER) AS start FROM points LEFT JOIN factors f USING (period) LEFT JOIN factors2 g USING (period)),
s AS (SELECT item, count(DISTINCT kind) AS kinds, count(f) AS n, count(*) FILTER (f IS NOT NULL AND real2 IS NULL) AS missing, coalesce(string_agg(period, ',' ORDER BY period) FILTER (f IS NULL), '') AS periods_omitted,
  arg_min(period, (start, period)) FILTER (f IS NOT NULL) AS p0, arg_max(period, (start, period)) FILTER (f IS NOT NULL) AS p1, arg_min(cents, (start, period)) FILTER (f IS NOT NULL) AS c0, arg_max(cents, (start, period)) FILTER (f IS NOT NULL) AS c1,
  arg_min(real, (start, period)) FILTER (f IS NOT NULL) AS r0, arg_max(real, (start, period)) FILTER (f IS NOT NULL) AS r1, arg_min(real2, (start, period)) FILTER (f IS NOT NULL) AS s0, arg_max(real2, (start, period)) FILTER (f IS NOT NULL) AS s1 FROM r GROUP BY item),
t AS (SELECT *, CASE WHEN kinds > 1 THEN 'mixed_periods' WHEN n < 2 THEN 'too_few_covered' END AS reason_code FROM s),
u AS (SELECT *, CASE WHEN reason_code IS NULL AND c0 <> 0 THEN round(CAST(c1 - c0 AS DOUBLE) / c0 * 100, 6) END AS nominal_pct, CASE WHEN reason_code IS NULL AND r0 <> 0 THEN round(CAST(r1 - r0 AS DOUBLE) / r0 * 100, 6) END AS real_pct,
  CASE WHEN reason_code IS NULL AND missing = 0 AND s0 <> 0 THEN round(CAST(s1 - s0 AS DOUBLE) / s0 * 100, 6) END AS alternate_pct FROM t)
SELECT item, CASE WHEN reason_code IS NULL THEN 'restated' ELSE 'refused' END AS status, reason_code, n, periods_omitted, CASE WHEN reason_code IS NULL THEN p0 END AS first_period, CASE WHEN reason_code IS NULL THEN p1 END AS last_period,
  nominal_pct, real_pct, alternate_pct, sign(nominal_pct) * sign(real_pct) < 0 AS sign_reverses, round(abs(real_pct - alternate_pct), 6) AS spread_pct FROM u""",
}
