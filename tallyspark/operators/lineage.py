"""Which line items plausibly succeed one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.numbers import ratio
from tallyspark.functions.text import title_overlap, title_tokens

ENDED = ("superseded", "retired", "restructured")
# Administrative names that are no programs of their own.
ADMINISTRATIVE = ["program support", "administration", "oversight", "fraud", "audit", "reconciliation"]
KEEP_FROM = 0.35


def _stated(period: Column) -> Column:
    return period.isNotNull() & ~F.contains(F.coalesce(period, F.lit("")), F.lit("[open]"))


def similar_titles(ended: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """Pairs (pred, succ) whose title overlap can reach ``least``, a set-similarity join on rare tokens.

    An overlap of at least t between lists of n and m tokens needs t / (1 + t) * (n + m) tokens of the first in the second. So for every
    length m that the second can have (at most n / t), one of the first's rarest tokens, all but that many less one, must be in
    it; join keys are the token and the length. A token that stands in every title comes last in the order, and is a key
    only where a single shared token is enough, that is where its pairs are results.
    """
    often = items.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("titles"))
    place = F.row_number().over(W.partitionBy("pred").orderBy("titles", "token"))
    ranked = ended.select(F.col("item").alias("pred"), F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(often, "token").withColumn("place", place)
    lengths = items.select(F.size("tokens").alias("m")).distinct()
    need = F.ceil(least / (1 + least) * (F.col("n") + F.col("m")) - 1e-9)
    reach = ranked.where("n > 0").withColumn("m", F.explode(F.sequence(F.lit(1), F.floor(F.col("n") / least).cast("int"))))
    keys = reach.where(F.col("place") <= F.col("n") - need + 1).join(lengths, "m", "left_semi").select("pred", "token", "m").distinct()
    return keys.join(items.select(F.col("item").alias("succ"), F.size("tokens").alias("m"), F.explode(F.array_distinct("tokens")).alias("token")), ["token", "m"]).select("pred", "succ")


def _candidates(items: DataFrame, agency_links: DataFrame, asserted: DataFrame) -> DataFrame:
    """Pairs (pred, succ) that can reach the score to keep: titles that overlap enough, an agency succession, or a stated link.

    Without a succession the score is 0.2, 0.4 of the overlap, and 0.1 where both periods are stated: the overlap must be 0.375, or 0.125
    where they are. Equi-joins stand for the pairing of all items with all ended ones.
    """
    ended = items.where(F.col("status").isin(*ENDED))
    close = similar_titles(ended, items, 0.375)
    dated = similar_titles(ended.where(_stated(F.col("last_period"))), items.where(_stated(F.col("first_period"))), 0.125)
    moved = ended.select(F.col("item").alias("pred"), F.col("agency").alias("old")).join(agency_links, "old").join(items.select(F.col("item").alias("succ"), F.col("agency").alias("new")), "new").select("pred", "succ")
    stated = asserted.join(ended.select(F.col("item").alias("pred")), "pred", "left_semi").select("pred", "succ")
    return close.unionByName(dated).unionByName(moved).unionByName(stated).where("pred <> succ").distinct()


def propose(items: DataFrame, agency_links: DataFrame, asserted: DataFrame) -> DataFrame:
    """Scored successions (pred, succ); every one needs confirmation.

    items: item, name, status, agency, first_period, last_period. agency_links: old, new. asserted: pred, succ.
    """
    items = items.withColumn("tokens", title_tokens(F.col("name")))
    side = lambda name: items.select(F.col("item").alias(name), F.struct("tokens", "agency", "first_period", "last_period", "status").alias(f"{name}_"))
    pairs = _candidates(items, agency_links, asserted).join(side("pred"), "pred").join(side("succ"), "succ")
    pairs = pairs.join(agency_links.select(F.col("old").alias("_old"), F.col("new").alias("_new"), F.lit(True).alias("moved")), (F.col("pred_.agency") == F.col("_old")) & (F.col("succ_.agency") == F.col("_new")), "left")
    pairs = pairs.join(asserted.withColumn("asserted", F.lit(True)), ["pred", "succ"], "left")
    score = 0.2 + 0.4 * title_overlap(F.col("pred_.tokens"), F.col("succ_.tokens")) + F.when(F.col("moved"), 0.3).otherwise(0.0) + F.when(_stated(F.col("pred_.last_period")) & _stated(F.col("succ_.first_period")), 0.1).otherwise(0.0)
    scored = pairs.select("pred", "succ", F.least(F.lit(1.0), F.round(score, 9)).alias("confidence"), F.coalesce("asserted", F.lit(False)).alias("asserted"))
    return scored.where((F.col("confidence") >= KEEP_FROM) | F.col("asserted")).withColumn("requires_confirmation", F.lit(True))


def unresolved(items: DataFrame, proposals: DataFrame) -> DataFrame:
    """Superseded or retired items for which nothing is proposed."""
    return items.where(F.col("status").isin("superseded", "retired")).join(proposals, items["item"] == proposals["pred"], "left_anti").select("item", "status")


def is_administrative(name: Column) -> Column:
    return F.lower(name).rlike("|".join(ADMINISTRATIVE))


def is_namesake(a: Column, b: Column) -> Column:
    """The shorter name, of 12 bytes and two words or more, begins the longer one."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    short, long = F.when(F.octet_length(x) <= F.octet_length(y), x).otherwise(y), F.when(F.octet_length(x) <= F.octet_length(y), y).otherwise(x)
    return (F.octet_length(short) >= 12) & (F.size(F.split(short, r"\s+")) >= 2) & F.startswith(long, short)


def slices(rows: DataFrame) -> DataFrame:
    """Items with namesakes in their agency, and their own share of the money (agency, code, name, cents).

    Rows of one name are summed before names meet, and a longer name finds the shorter ones among its own beginnings, so no two rows are paired.
    """
    best = rows.groupBy("agency", "code").agg(F.max(F.struct("cents", "name")).alias("m")).select("agency", "code", "m.name", "m.cents")
    counts, two = ~is_administrative(F.col("name")), F.size(F.split("_key", r"\s+")) >= 2
    best = best.withColumn("_key", F.lower(F.trim("name"))).where("agency IS NOT NULL AND code IS NOT NULL AND octet_length(_key) >= 12")
    best = best.withColumns({"_one": counts.cast("bigint"), "_own": F.when(counts, F.col("cents"))})
    totals = best.groupBy("agency", "_key").agg(F.sum("_one").alias("n"), F.sum("_own").alias("total"), F.count("_own").alias("stated"))
    # The shorter name has at least 12 bytes, so namesakes agree in their first 12 bytes; beginnings are cut at the lengths that names have there.
    names = totals.select("agency", F.col("_key").alias("long"), F.substring(F.col("_key").cast("binary"), 1, 12).alias("_head"))
    lengths = totals.where(two).select("agency", F.substring(F.col("_key").cast("binary"), 1, 12).alias("_head"), F.length("_key").alias("size")).distinct()
    cut = names.join(lengths, ["agency", "_head"]).where(F.length("long") >= F.col("size")).select("agency", "long", F.col("long").substr(F.lit(1), F.col("size")).alias("_key"))
    pairs = cut.join(totals.where(two), ["agency", "_key"]).withColumnRenamed("_key", "short")
    sums = ["n", "total", "stated"]
    below = pairs.select("agency", F.col("long").alias("_key"), *sums)
    above = pairs.where("long <> short").select("agency", "long", "short").join(totals.withColumnRenamed("_key", "long"), ["agency", "long"]).select("agency", F.col("short").alias("_key"), *sums)
    near = below.unionByName(above).groupBy("agency", "_key").agg(*[F.sum(c).alias(c) for c in sums])
    # A name of two words is its own namesake: the row itself is taken off again.
    itself = two & counts
    found = best.join(near, ["agency", "_key"]).withColumns({"siblings": F.col("n") - F.when(itself, 1).otherwise(0), "_others": F.col("stated") - F.when(itself & F.col("cents").isNotNull(), 1).otherwise(0)})
    out = found.where("siblings > 0").withColumn("sibling_cents", F.when(F.col("_others") > 0, F.col("total") - F.when(itself, F.coalesce("cents", F.lit(0))).otherwise(0)))
    return out.select("agency", "code", "name", F.col("cents").alias("own_cents"), "siblings", "sibling_cents", F.round(ratio(F.col("cents"), F.col("cents") + F.col("sibling_cents")), 6).alias("own_share"))
