"""Extracted rows to proposals for the graph; nothing is written back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYNTHETIC = "synthetic-fixture"


def match_codes(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Each row with its item: the first whose current code is equal, else the last that names it whole among its historical codes."""
    current = items.select(F.col("current_code").alias("code"), F.lit("current").alias("how"), (-F.col("pos")).alias("rank"), "item").where("code <> ''")
    past = items.select(F.explode(F.split("historical_codes", "[^A-Za-z0-9]")).alias("code"), F.lit("historical").alias("how"), F.col("pos").alias("rank"), "item").where("code <> ''")
    best = current.unionByName(past).groupBy("code").agg(F.max(F.struct((F.col("how") == "current").alias("p"), "rank", "item", "how"))["item"].alias("item"), F.max(F.col("how") == "current").alias("by_current"))
    return rows.join(best, "code", "left")


def propose(rows: DataFrame, items: DataFrame, appropriations: DataFrame, sources: DataFrame) -> DataFrame:
    """Every row with its outcome: refused (synthetic), unmatched (no item, or no figure to fill), or proposed.

    appropriations: item, fiscal_year, stage, path, pos; sources: slug, content_committed.
    """
    first = appropriations.groupBy("item", "fiscal_year", "stage").agg(F.min(F.struct("pos", "path"))["path"].alias("path"))
    out = match_codes(rows, items).join(first, ["item", "fiscal_year", "stage"], "left").join(sources.select(F.col("slug").alias("source"), "content_committed"), "source", "left")
    outcome = F.when(F.col("source") == SYNTHETIC, "refused_synthetic").when(F.col("item").isNull(), "unmatched_code").when(F.col("path").isNull(), "unmatched_figure").otherwise("proposed")
    known = F.col("outcome") == "proposed"
    return out.withColumn("outcome", outcome).select(
        "row_id", "code", "fiscal_year", "stage", "amount_cents", "outcome", F.when(known, F.col("path")).alias("path"), F.when(known, ~F.col("by_current")).alias("needs_review"), F.coalesce("content_committed", F.lit(False)).alias("may_mark_verified")
    )


def still_open(appropriations: DataFrame, proposals: DataFrame) -> DataFrame:
    """Open figures that this run does not fill."""
    return appropriations.where("is_open").join(proposals.where("outcome = 'proposed'"), "path", "left_anti").select("path")


def unmatched(proposals: DataFrame, k: int = 12) -> DataFrame:
    """The k most frequent unmatched codes."""
    return proposals.where("outcome like 'unmatched%'").groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(k)
