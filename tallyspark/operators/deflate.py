"""Constant-dollar restatement: price observations to fiscal-year indices to deflated amounts.

A fiscal year has an index only if its observations are as many as the series' cadence asks for; other
years are named, not filled. Amounts round half away from zero after scaling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cadence(observations: DataFrame) -> DataFrame:
    """Observations a year, from the smallest gap between months (series, year, month, value)."""
    at = F.col("year") * 12 + F.col("month")
    gaps = observations.withColumn("_gap", at - F.lag(at).over(W.partitionBy("series").orderBy("year", "month")))
    least = gaps.where("_gap > 0").groupBy("series").agg(F.min("_gap").alias("months"))
    per_year = F.when(F.pmod("months", F.lit(12)) == 0, 1).when(F.col("months").isin(1, 3, 6), (F.lit(12) / F.col("months")).cast("int"))
    return least.select("series", "months", per_year.alias("per_year"))


def fiscal_index(observations: DataFrame) -> DataFrame:
    """series, period, index (null where the year is incomplete), observed and wanted counts; one scan of the series."""
    fy = F.col("year") + F.when(F.col("month") >= 7, 1).otherwise(0)
    years = observations.withColumn("fy", fy).groupBy("series", "fy").agg(F.count("value").alias("observed"), F.avg("value").alias("mean"))
    years = years.join(cadence(observations), "series")
    whole = F.col("observed") == F.col("per_year")
    return years.select("series", F.concat(F.lit("FY"), F.col("fy").cast("string")).alias("period"), F.when(whole, F.col("mean")).alias("index"), "observed", F.col("per_year").alias("wanted"))


def deflator(index: DataFrame, base: str) -> DataFrame:
    """series, period, factor to ``base`` money; series whose base is uncovered, or with an index that is not positive, have none."""
    covered = index.where(F.col("index").isNotNull())
    usable = covered.groupBy("series").agg(F.max(F.when(F.col("period") == base, F.col("index"))).alias("base_index"), F.min("index").alias("least")).where("base_index is not null and least > 0")
    return covered.join(usable, "series").select("series", "period", (F.col("base_index") / F.col("index")).alias("factor"))


def deflate(cents: Column, factor: Column) -> Column:
    return F.round(cents * factor).cast("bigint")


def period_kind(label: Column) -> Column:
    """biennial when digits follow the first hyphen, else annual."""
    return F.when(label.rlike(r"^[^-]*-[0-9]+$"), "biennial").otherwise("annual")


def real_series(points: DataFrame, factors: DataFrame, alternate: DataFrame | None = None) -> DataFrame:
    """One outcome per item over its (item, period, cents) points.

    Refused if annual and biennial periods are mixed or fewer than two periods are covered; periods without a
    factor are named in ``periods_omitted``; ``alternate`` factors restate the same change for comparison.
    """
    rows = points.join(factors.select("period", "factor"), "period", "left")
    other = alternate.select("period", F.col("factor").alias("factor2")) if alternate is not None else factors.select("period", F.lit(None).cast("double").alias("factor2"))
    rows = rows.join(other, "period", "left").withColumns({"kind": period_kind(F.col("period")), "start": F.coalesce(F.regexp_extract("period", r"^(?:FY)*([0-9]+)", 1).try_cast("int"), F.lit(2147483647))})
    covered = F.col("factor").isNotNull()
    point = F.struct("start", "period", "cents", deflate(F.col("cents"), F.col("factor")).alias("real"), deflate(F.col("cents"), F.col("factor2")).alias("real2"))
    series = rows.groupBy("item").agg(
        F.count_distinct("kind").alias("kinds"), F.count_if(covered).alias("n"), F.min(F.when(covered, point)).alias("a"), F.max(F.when(covered, point)).alias("z"),
        F.array_join(F.sort_array(F.collect_list(F.when(~covered, F.col("period")))), ",").alias("periods_omitted"),
        F.count_if(covered & F.col("factor2").isNull()).alias("alternate_missing"),
    )
    reason = F.when(F.col("kinds") > 1, "mixed_periods").when(F.col("n") < 2, "too_few_covered")
    ok = reason.isNull()
    change = lambda name: F.when(ok & (F.col(f"a.{name}") != 0), F.round((F.col(f"z.{name}") - F.col(f"a.{name}")).cast("double") / F.col(f"a.{name}") * 100, 6))
    out = series.withColumns({"nominal_pct": change("cents"), "real_pct": change("real"), "alternate_pct": F.when(F.col("alternate_missing") == 0, change("real2"))})
    return out.select(
        "item", F.when(ok, "restated").otherwise("refused").alias("status"), reason.alias("reason_code"), "n", "periods_omitted",
        F.when(ok, F.col("a.period")).alias("first_period"), F.when(ok, F.col("z.period")).alias("last_period"), "nominal_pct", "real_pct", "alternate_pct",
        (F.signum("nominal_pct") * F.signum("real_pct") < 0).alias("sign_reverses"), F.round(F.abs(F.col("real_pct") - F.col("alternate_pct")), 6).alias("spread_pct"),
    )


# What is nominal by nature and is not restated.
NOMINAL = ["debt service", "bond", "statutory threshold", "principal and interest"]


def is_nominal(purpose: Column) -> Column:
    return F.lower(purpose).rlike("|".join(NOMINAL))
