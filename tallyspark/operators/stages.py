"""How a figure moves from stage to stage, and which actions explain each step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.numbers import exact_sum, percent


def first_by_stage(points: DataFrame) -> DataFrame:
    """The first row (by ord) of each (item, period, stage), before any test of its amount; open ones have null cents."""
    order = W.partitionBy("item", "period", "stage").orderBy("ord")
    return points.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def steps(points: DataFrame) -> DataFrame:
    """One row per pair of adjacent present stages, with the stages skipped between them."""
    order = W.partitionBy("item", "period").orderBy("stage")
    rows = first_by_stage(points).where("cents is not null").withColumns({"from_stage": F.lag("stage").over(order), "from_cents": F.lag("cents").over(order)})
    between = F.when(F.col("stage") - F.col("from_stage") > 1, F.sequence(F.col("from_stage") + 1, F.col("stage") - 1)).otherwise(F.array().cast("array<int>"))
    return rows.where("from_stage is not null").select(
        "item", "period", "from_stage", F.col("stage").alias("to_stage"), "from_cents", F.col("cents").alias("to_cents"), (F.col("cents") - F.col("from_cents")).alias("delta_cents"),
        F.array_join(between.cast("array<string>"), ",").alias("skipped"), "version", "ref",
    )


def attributed(moves: DataFrame, applies: DataFrame, modifies: DataFrame, describe: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Steps with their actions: those on the later version, or on the later figure itself; each action once.

    applies: version, action, kind, actor; modifies: ref, action, kind, actor. Two equi-joins, never an OR; repeated
    actions go after the joins, when the actions of all other figures are gone. ``describe`` may add action, kind and actor
    after the joins, from whatever columns the two sides have, so that texts are not shuffled.
    """
    key = ["item", "period", "to_stage"]
    of = lambda acts, on: describe(moves.select(*key, on).join(acts, on)).select(*key, "action", "kind", "actor")
    found = of(applies, "version").unionByName(of(modifies, "ref")).dropDuplicates([*key, "action"])
    by_step = found.groupBy(*key).agg(F.count("*").alias("n_actions"), F.bool_or(F.col("kind") == "veto").alias("has_veto"), F.min(F.struct("action", "actor"))["actor"].alias("first_actor"))
    rows = moves.join(by_step, key, "left").fillna({"n_actions": 0, "has_veto": False})
    return rows.select(
        *key, "from_stage", "from_cents", "to_cents", "delta_cents", "skipped", "n_actions", "first_actor",
        ((F.col("skipped") == "") & (F.col("n_actions") > 0)).alias("is_attributed"), (F.col("has_veto") & (F.col("delta_cents") > 0)).alias("veto_with_rise"),
    )


def with_readings(attributed: DataFrame) -> DataFrame:
    """Attributed steps with ``is_complete`` of their (item, period): no step of it passes over a stage, so it may be read as attribution."""
    return attributed.withColumn("is_complete", F.bool_and(F.col("skipped") == "").over(W.partitionBy("item", "period")))


def series(points: DataFrame, last_stage: int) -> DataFrame:
    """Per (item, period): steps, net change from first to last present stage, missing stages, completeness."""
    rows = first_by_stage(points)
    present = F.when(F.col("cents").isNotNull(), F.struct("stage", "cents"))
    out = rows.groupBy("item", "period").agg(F.min(present).alias("a"), F.max(present).alias("z"), F.count("cents").alias("n"), F.collect_set(F.when(F.col("cents").isNotNull(), F.col("stage"))).alias("seen"))
    missing = F.array_except(F.sequence(F.lit(1), F.lit(last_stage)), "seen")
    adjacent = F.coalesce(F.col("z.stage") - F.col("a.stage") + 1 == F.col("n"), F.lit(True))
    return out.select("item", "period", F.greatest(F.col("n") - 1, F.lit(0)).alias("n_steps"), (F.col("z.cents") - F.col("a.cents")).alias("net_cents"), F.array_join(F.sort_array(missing).cast("array<string>"), ",").alias("missing"), adjacent.alias("is_complete"))


def ladder_rollup(rows: DataFrame, last_stage: int) -> DataFrame:
    """Movement over each transition of the fixed ladder, empty ones included; the last row of a (code, stage) wins."""
    last = rows.withColumn("_n", F.row_number().over(W.partitionBy("code", "stage").orderBy(F.desc("ord")))).where("_n = 1")
    order = W.partitionBy("code").orderBy("stage")
    moves = last.withColumns({"next": F.lead("stage").over(order), "next_cents": F.lead("cents").over(order)}).where("next = stage + 1")
    moves = moves.select("code", F.col("stage").alias("from_stage"), (F.col("next_cents") - F.col("cents")).alias("d")).where("d <> 0")
    up = F.max(F.when(F.col("d") > 0, F.struct("d", (-F.col("code")).alias("c"))))
    down = F.min(F.when(F.col("d") < 0, F.struct("d", "code")))
    agg = moves.groupBy("from_stage").agg(
        F.count("*").alias("moved"), F.count_if(F.col("d") > 0).alias("raised"), F.count_if(F.col("d") < 0).alias("cut"), exact_sum(F.abs("d")).alias("gross"), exact_sum(F.col("d")).alias("net"),
        (-up["c"]).alias("largest_rise"), down["code"].alias("largest_cut"),
    )
    ladder = rows.sparkSession.range(1, last_stage).select(F.col("id").cast("int").alias("from_stage"))
    out = ladder.join(agg, "from_stage", "left").fillna(0, ["moved", "raised", "cut", "gross", "net"])
    total = F.sum("gross").over(W.partitionBy(F.lit(1)))
    return out.select("from_stage", (F.col("from_stage") + 1).alias("to_stage"), "moved", "raised", "cut", F.col("gross").cast("bigint").alias("gross_cents"), F.col("net").cast("bigint").alias("net_cents"), "largest_rise", "largest_cut", F.coalesce(percent(F.col("gross"), total, 4), F.lit(0.0)).alias("share_pct"))
