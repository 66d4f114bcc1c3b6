"""Authority against outturn per line item and period, with a tri-state outcome.

Both sides are laid under one another and aggregated once by (item, period), so the comparison costs
one shuffle and no join. Outcomes follow a fixed precedence: one side missing is unavailable; only
recipient slices, or outturn on several bases, is refused; the first authority row, then the first
outturn row, that is open (unavailable) or unreadable (refused) decides next; else computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.numbers import exact_sum, percent, upper_median


def totals_by_pair(authority: DataFrame, outturn: DataFrame) -> DataFrame:
    """One row per (item, period) of both sides.

    authority: item, period, cents, state (ok, open, bad), ord.
    outturn: the same with basis, is_slice and reversion_cents.
    """
    kinds = "item", "period", "cents", "state", "ord"
    left = authority.select(*kinds, F.lit(None).cast("string").alias("basis"), F.lit(False).alias("is_slice"), F.lit(None).cast("bigint").alias("reversion_cents"), F.lit(True).alias("is_authority"))
    right = outturn.select(*kinds, "basis", "is_slice", "reversion_cents", F.lit(False).alias("is_authority"))
    a, e = F.col("is_authority"), ~F.col("is_authority")
    whole = e & ~F.col("is_slice")
    bad = F.struct("ord", "state")
    return left.unionByName(right).groupBy("item", "period").agg(
        F.count_if(a).alias("n_authority"),
        F.count_if(e).alias("n_outturn"),
        F.count_if(whole).alias("n_whole"),
        F.count_if(e & F.col("is_slice")).alias("n_slices"),
        F.sort_array(F.collect_set(F.when(whole, F.trim("basis")))).alias("bases"),
        F.min(F.when(a & (F.col("state") != "ok"), bad))["state"].alias("bad_authority"),
        F.min(F.when(whole & (F.col("state") != "ok"), bad))["state"].alias("bad_outturn"),
        F.sum(F.when(a, F.col("cents"))).alias("appropriated_cents"),
        F.sum(F.when(whole, F.col("cents"))).alias("spent_cents"),
        F.sum(F.when(whole, F.col("reversion_cents"))).alias("reversion_cents"),
    )


def outcome() -> tuple[Column, Column]:
    """(status, reason_code) of a row of ``totals_by_pair``."""
    cases = [
        ((F.col("n_authority") == 0) | (F.col("n_outturn") == 0), "unavailable", "one_side_missing"),
        (F.col("n_whole") == 0, "refused", "recipient_slice_only"),
        (F.size("bases") > 1, "refused", "mixed_bases"),
        (F.col("bad_authority") == "open", "unavailable", "authority_open"),
        (F.col("bad_authority").isNotNull(), "refused", "authority_unparsed"),
        (F.col("bad_outturn") == "open", "unavailable", "outturn_open"),
        (F.col("bad_outturn").isNotNull(), "refused", "outturn_unparsed"),
    ]
    status, reason = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for test, s, r in cases:
        status, reason = status.when(test, s), reason.when(test, r)
    return status.otherwise("computed"), reason


def gap(authority: DataFrame, outturn: DataFrame) -> DataFrame:
    """The outcome of every pair that has outturn."""
    status, reason = outcome()
    pairs = totals_by_pair(authority, outturn).where("n_outturn > 0").withColumns({"status": status, "reason_code": reason})
    known = F.col("status") == "computed"
    variance = F.col("appropriated_cents") - F.col("spent_cents")
    return pairs.select(
        "item", "period", "status", "reason_code",
        F.when(known, F.col("appropriated_cents")).alias("appropriated_cents"),
        F.when(known, F.col("spent_cents")).alias("spent_cents"),
        F.when(known, variance).alias("variance_cents"),
        F.when(known, percent(variance, F.col("appropriated_cents"))).alias("variance_pct"),
        F.when(known, F.col("reversion_cents")).alias("reversion_cents"),
        F.when(known, F.coalesce(F.element_at("bases", 1), F.lit("[open]"))).alias("basis"),
        F.when(known, F.coalesce(F.element_at("bases", 1) == "disbursed", F.lit(False))).alias("provisional"),
        F.when(known, F.col("n_slices")).alias("slices_excluded"),
        F.when(known & ((F.col("appropriated_cents") == 0) != (F.col("spent_cents") == 0)), "one_side_zero").alias("anomaly"),
    )


def succession_anomaly(gaps: DataFrame, links: DataFrame) -> DataFrame:
    """Anomalous pairs with the first counterpart (item, pos, counterpart) that succession links declare."""
    first = links.groupBy("item").agg(F.min(F.struct("pos", "counterpart"))["counterpart"].alias("counterpart"))
    return gaps.where("anomaly is not null").join(first, "item", "left").select("item", "period", F.coalesce("counterpart", F.lit("none declared")).alias("counterpart"))


def summary(gaps: DataFrame) -> DataFrame:
    """Portfolio totals over computed pairs; a null percentage never counts as overspent."""
    done = gaps.where("status = 'computed'")
    totals = done.agg(
        F.count("*").alias("pairs"), exact_sum(F.col("appropriated_cents")).alias("appropriated"), exact_sum(F.col("spent_cents")).alias("spent"), F.count_if(F.col("variance_pct") < 0).alias("overspent")
    )
    left = F.col("appropriated") - F.col("spent")
    return totals.select("pairs", F.col("appropriated").cast("bigint").alias("appropriated_cents"), F.col("spent").cast("bigint").alias("spent_cents"), "overspent", percent(left, F.col("appropriated"), 4).alias("variance_pct"))


def character_distribution(gaps: DataFrame) -> DataFrame:
    """Per character: pairs, upper median and mean absolute percentage, shares within 1 and beyond 5 percent."""
    rows = gaps.where("status = 'computed' and variance_pct is not null")
    size = F.abs("variance_pct")
    return rows.groupBy("character").agg(
        F.count("*").alias("pairs"), upper_median("variance_pct").alias("median_pct"), F.round(F.avg(size), 4).alias("mean_abs_pct"), F.count_if(size < 1.0).alias("within_one"), F.count_if(size > 5.0).alias("beyond_five")
    )


def funders(items: DataFrame, programs: DataFrame, links: DataFrame) -> DataFrame:
    """Per line item: its programs' policy areas (counted), whether one is formula-driven, whether one is federally matched, and its character.

    programs: program, policy_area, formula_basis, federal_participation. links: program, item (funded-by). A missing or ``[open]`` text decides
    nothing; a basis that says "Not formula" and a participation that begins with "None" deny. An item without programs is neither.
    """
    known = lambda c: F.col(c).isNotNull() & ~F.contains(F.col(c), F.lit("[open]"))
    formula = F.when(known("formula_basis"), ~F.contains("formula_basis", F.lit("Not formula")))
    matched = F.when(known("federal_participation"), ~F.ltrim("federal_participation").startswith("None"))
    said = links.distinct().join(programs, "program").groupBy("item").agg(F.count("policy_area").alias("policy_areas"), F.bool_or(formula).alias("formula"), F.bool_or(matched).alias("matched"))
    joined = items.select("item").join(said, "item", "left")
    false = lambda c: F.coalesce(c, F.lit(False))
    return joined.select("item", F.coalesce("policy_areas", F.lit(0)).alias("policy_areas"), false("formula").alias("formula_driven"), false("matched").alias("federally_matched"), character(F.col("formula"), F.col("matched")).alias("character"))


def character(formula: Column, matched: Column) -> Column:
    """entitlement if federally matched, else formula, else unclassified."""
    return F.when(F.coalesce(matched, F.lit(False)), "entitlement").when(F.coalesce(formula, F.lit(False)), "formula").otherwise("unclassified")


def adjacent_periods(gaps: DataFrame, start: Column) -> DataFrame:
    """Each period of an item with the next one, by first year and then label."""
    order = W.partitionBy("item").orderBy("_start", "period")
    rows = gaps.withColumn("_start", F.coalesce(start, F.lit(2147483647)))
    keep = "period", "status", "reason_code", "variance_cents", "variance_pct"
    rows = rows.withColumns({f"to_{c}": F.lead(c).over(order) for c in keep})
    return rows.where("to_period is not null").select("item", *keep, *[f"to_{c}" for c in keep])


def trend(gaps: DataFrame, deflator: DataFrame, start: Column) -> DataFrame:
    """Change of the gap between adjacent periods, in nominal and base-period cents.

    deflator: period, factor (base index over the period's index). The earlier period's reason comes before
    the later one's; a period without a factor is refused. Real cents are rounded before they are subtracted.
    """
    pairs = adjacent_periods(gaps, start)
    pairs = pairs.join(deflator.select("period", F.col("factor").alias("f0")), "period", "left")
    pairs = pairs.join(deflator.select(F.col("period").alias("to_period"), F.col("factor").alias("f1")), "to_period", "left")
    status = (
        F.when(F.col("status") != "computed", F.col("status")).when(F.col("to_status") != "computed", F.col("to_status"))
        .when(F.col("f0").isNull() | F.col("f1").isNull(), "refused").otherwise("computed")
    )
    reason = (
        F.when(F.col("status") != "computed", F.concat(F.lit("from_"), F.col("reason_code"))).when(F.col("to_status") != "computed", F.concat(F.lit("to_"), F.col("to_reason_code")))
        .when(F.col("f0").isNull() | F.col("f1").isNull(), "period_not_in_index")
    )
    known = F.col("trend_status") == "computed"
    real0, real1 = F.round(F.col("variance_cents") * F.col("f0")).cast("bigint"), F.round(F.col("to_variance_cents") * F.col("f1")).cast("bigint")
    return pairs.withColumns({"trend_status": status, "trend_reason": reason}).select(
        "item", "period", "to_period", "trend_status", "trend_reason",
        F.when(known, F.col("to_variance_cents") - F.col("variance_cents")).alias("nominal_change_cents"),
        F.when(known, real1 - real0).alias("real_change_cents"),
    )


