"""How money splits across policy categories, authority and outturn kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# The categories with their labels, whether the money is the state's own, and whether the narrow boundary counts it.
CATEGORIES = [
    ("own_source", "own-source revenue in transit", False, False),
    ("shared", "shared state revenue", True, True),
    ("reimbursement", "reimbursement", True, True),
    ("school_aid", "school foundation aid", True, False),
]


def category_attributes(spark) -> DataFrame:
    """category, label, is_state_money and in_narrow_boundary: a dimension of four rows."""
    return spark.createDataFrame(CATEGORIES, "category string, label string, is_state_money boolean, in_narrow_boundary boolean")


def by_ownership(cells: DataFrame, categories: DataFrame) -> DataFrame:
    """(measure, year): the state's own money, what the narrow boundary counts, and everything, of the classified codes."""
    attributes = F.broadcast(category_attributes(cells.sparkSession))
    rows = cells.join(categories, "code").join(attributes, "category")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("cents"))), F.lit(0)).alias
    return rows.groupBy("measure", "year").agg(total(F.col("is_state_money"))("state_cents"), total(F.col("in_narrow_boundary"))("narrow_cents"), F.sum("cents").alias("all_cents"))


def chosen_cells(facts: DataFrame) -> DataFrame:
    """measure, year, code, cents: the largest figure of a code within a workbook, then the last workbook.

    facts: workbook (ordered), measure, year, code, cents.
    """
    largest = facts.groupBy("workbook", "measure", "year", "code").agg(F.max("cents").alias("cents"))
    return largest.groupBy("measure", "year", "code").agg(F.max(F.struct("workbook", "cents"))["cents"].alias("cents"))


def category_totals(cells: DataFrame, categories: DataFrame, names: list[str], narrow: list[str]) -> DataFrame:
    """(measure, year): total per category, narrow and wide boundary.

    A category without members is zero authority (``enacted``) but missing, and named, outturn (``actual``).
    """
    rows = cells.join(categories, "code").groupBy("measure", "year").pivot("category", names).agg(F.sum("cents"))
    enacted = F.col("measure") == "enacted"
    missing = F.array_join(F.array_compact(F.array(*[F.when(~enacted & F.col(n).isNull(), F.lit(n)) for n in names])), ",")
    rows = rows.withColumn("missing", missing).withColumns({n: F.when(enacted, F.coalesce(n, F.lit(0))).otherwise(F.col(n)) for n in names})
    total = lambda some: sum((F.coalesce(n, F.lit(0)) for n in some), F.lit(0).cast("bigint"))
    return rows.withColumns({"narrow_cents": total(narrow), "wide_cents": total(names)})


def actual_only_years(cells: DataFrame) -> DataFrame:
    """Years with outturn but no authority."""
    years = lambda m: cells.where(F.col("measure") == m).select("year").distinct()
    return years("actual").join(years("enacted"), "year", "left_anti")


def last_wins(rows: DataFrame, keys: list[str], order: str, *values: str) -> DataFrame:
    """The values of the last row (by ``order``) of each key."""
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, *values)).alias("_v"))
    return best.select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def ambiguous_codes(rows: DataFrame) -> DataFrame:
    """Codes that stand under more than one name."""
    out = rows.groupBy("code").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return out.where(F.size("names") > 1).select("code", F.size("names").alias("n_names"), F.array_join("names", " | ").alias("names"))


def points(years: DataFrame) -> DataFrame:
    """Chart rows of the years that are restated (nominal, actual and real sums of each category in cents); others are dropped.

    ``state_money_paid`` rescales the actuals by the factor that the restated appropriation has to the nominal one, half away from zero, half up below it as
    the feed rounds; null without actuals or where nothing was appropriated.
    """
    both = lambda kind: F.col(f"{kind}_shared_cents") + F.col(f"{kind}_reimbursement_cents")
    exact = both("actual").cast("decimal(38,0)") * both("real").cast("decimal(19,0)")
    scaled = F.floor((2 * exact + both("nominal")) / (2 * both("nominal"))).cast("bigint")
    return years.where("real_own_source_cents IS NOT NULL").select(
        "period", F.col("real_own_source_cents").alias("own_source"), F.col("real_shared_cents").alias("shared"), F.col("real_reimbursement_cents").alias("reimbursement"), both("real").alias("state_money"),
        F.col("real_foundation_cents").alias("school_foundation"), (both("real") + F.col("real_foundation_cents")).alias("state_money_wide"), F.when(both("nominal") != 0, scaled).alias("state_money_paid"),
    )
