"""How each actor answers the one before it: conditioned tallies, conference positions, the adjustment test.

Keys that occur more than once in a column are dropped after parsing. One conditional aggregation
lays all columns of a key side by side, in place of three or four joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.numbers import WIDE, percent, ratio, upper_median


def single_cells(facts: DataFrame, *keys: str) -> DataFrame:
    """(keys, column, cents) of the keys that stand exactly once in a column."""
    return facts.where("cents is not null").groupBy(*keys, "column").agg(F.count("*").alias("_n"), F.max("cents").alias("cents")).where("_n = 1").drop("_n")


def side_by_side(facts: DataFrame, keys: list[str], columns: list[int]) -> DataFrame:
    """One row per key with the cents of each column, named c<column>."""
    cells = single_cells(facts, *keys)
    return cells.groupBy(*keys).agg(*[F.max(F.when(F.col("column") == c, F.col("cents"))).alias(f"c{c}") for c in columns])


def conditioning(wide: DataFrame, hand_offs: list[tuple[str, int, int, int, int]]) -> DataFrame:
    """(actor, bill and pooled) tallies of an actor's change given its predecessor's, from (base, prior, input, result) columns."""
    parts = None
    for actor, base, prior, given, result in hand_offs:
        cols = [F.col(f"c{k}") for k in (base, prior, given, result)]
        rows = wide.select("bill", F.lit(actor).alias("actor"), *[c.alias(n) for c, n in zip(cols, ("base", "prior", "given", "result"), strict=True)]).where("base is not null and prior is not null and given is not null and result is not null")
        parts = rows if parts is None else parts.unionByName(rows)
    assert parts is not None
    moved = parts.where("result <> given").withColumns({"d": F.col("result") - F.col("given"), "before": F.col("given") - F.col("prior"), "nearer": F.abs(F.col("result") - F.col("base")) - F.abs(F.col("given") - F.col("base"))})
    d, before, nearer = F.col("d"), F.col("before"), F.col("nearer")
    out = moved.rollup("actor", "bill").agg(
        F.count("*").alias("n"), F.count_if((before > 0) & (d > 0)).alias("raised_after_raise"), F.count_if(before > 0).alias("after_raise"),
        F.count_if((before < 0) & (d > 0)).alias("raised_after_cut"), F.count_if(before < 0).alias("after_cut"), F.count_if(nearer < 0).alias("toward"), F.count_if(nearer > 0).alias("away"),
        F.count_if(nearer == 0).alias("same_distance"), F.sum(F.abs(d).cast(WIDE)).cast("bigint").alias("gross_cents"), F.sum(d.cast(WIDE)).cast("bigint").alias("net_cents"),
    ).where("actor is not null")
    cut, rise = ratio(F.col("raised_after_cut"), F.col("after_cut")), ratio(F.col("raised_after_raise"), F.col("after_raise"))
    return out.withColumns({"bill": F.coalesce("bill", F.lit("pooled")), "reversal_gap_pp": F.round((cut - rise) * 100, 6), "toward_pct": percent(F.col("toward"), F.col("toward") + F.col("away"))})


def conference_position(wide: DataFrame, house: int, senate: int, conference: int) -> DataFrame:
    """Where the conference lands between two contested figures, per bill and pooled."""
    rows = wide.select("bill", F.col(f"c{house}").alias("h"), F.col(f"c{senate}").alias("s"), F.col(f"c{conference}").alias("c")).where("h is not null and s is not null and c is not null and h <> s")
    h, s, c = F.col("h"), F.col("s"), F.col("c")
    where = F.when(c == h, "at_house").when(c == s, "at_senate").when((c > F.least(h, s)) & (c < F.greatest(h, s)), "between").otherwise("outside")
    rows = rows.withColumns({"place": where, "cents": F.abs(h - s), "position": F.round(ratio(c - s, h - s), 9)})
    rows = rows.select(F.explode(F.array("bill", F.lit("pooled"))).alias("bill"), "place", "cents", "position")
    places = "at_house", "at_senate", "between", "outside"
    total = F.sum("cents")
    return rows.groupBy("bill").agg(
        F.count("*").alias("contested"), total.alias("contested_cents"), *[F.count_if(F.col("place") == p).alias(p) for p in places],
        *[F.coalesce(percent(F.sum(F.when(F.col("place") == p, F.col("cents"))), total, 4), F.lit(0.0)).alias(f"{p}_dollar_pct") for p in places], upper_median("position").alias("median_position"),
    )


def adjustment_test(wide: DataFrame) -> DataFrame:
    """Does adjusting authority bring it nearer to the outturn? From (year, key, c1 enacted, c2 adjusted, c3 actual)."""
    e, j, a = F.col("c1"), F.col("c2"), F.col("c3")
    rows = wide.where("c1 is not null and c2 is not null and c3 is not null")
    before, after = F.abs(a - e), F.abs(a - j)
    out = rows.groupBy("year").agg(
        F.count("*").alias("n"), F.sum(before.cast(WIDE)).cast("bigint").alias("distance_enacted"), F.sum(after.cast(WIDE)).cast("bigint").alias("distance_adjusted"), F.count_if(j != e).alias("adjusted"),
        F.count_if((j != e) & (after < before)).alias("toward"), F.count_if((j != e) & (after > before)).alias("away"),
    )
    return out.withColumns({"closed_pct": percent(F.col("distance_enacted") - F.col("distance_adjusted"), F.col("distance_enacted")), "toward_pct": percent(F.col("toward"), F.col("toward") + F.col("away"))})


def with_previous(biennia: DataFrame) -> DataFrame:
    """Biennia (bill, file, previous_bill) with the previous one's file; null for the first."""
    before = biennia.select(F.col("bill").alias("previous_bill"), F.col("file").alias("previous_file"))
    return biennia.join(before, "previous_bill", "left")


def with_officers(tallies: DataFrame, officers: DataFrame) -> DataFrame:
    """Tallies (actor, bill, ..) with the officer who presided over the actor's chamber (bill, actor, officer); none for others."""
    return tallies.join(F.broadcast(officers), ["actor", "bill"], "left")


def findings(wide: DataFrame, required: DataFrame, hand_offs: list[tuple[str, int, int, int, int]], officers: DataFrame) -> DataFrame:
    """All conditioned tallies with officers, and no row at all if a bill of ``required`` (bill) has no figures."""
    absent = required.join(wide.select("bill").distinct(), "bill", "left_anti").agg((F.count("*") == 0).alias("complete"))
    rows = with_officers(conditioning(wide, hand_offs), officers).withColumn("complete", F.lit(True))
    return rows.join(F.broadcast(absent), "complete").drop("complete")


def hand_off_rows(tallies: DataFrame) -> DataFrame:
    """Plot-ready shares of conditioned tallies: percent raised by what came before, their gap, and how often toward the baseline."""
    share = lambda up, of: F.when(F.col(of) > 0, F.round(100 * F.col(up) / F.col(of), 6))
    rows = tallies.select(
        "actor", "bill", share("raised_after_raise", "after_raise").alias("raised_when_prior_raised"), share("raised_after_cut", "after_cut").alias("raised_when_prior_cut"),
        (F.col("after_raise") + F.col("after_cut")).alias("moved_n"), F.when(F.col("toward") + F.col("away") > 0, F.round(100 * F.col("toward") / (F.col("toward") + F.col("away")), 6)).alias("toward_baseline"),
    )
    return rows.withColumn("gap", F.round(F.col("raised_when_prior_cut") - F.col("raised_when_prior_raised"), 5))
