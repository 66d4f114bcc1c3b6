"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Sources are weighed, the requested total is shared by weight, a source whose share exceeds
``max_epochs`` times its own words is clamped there and the excess is reshared among the others.
The clamped fixed point is found in closed form: sources sorted by cap per unit of weight, the
first one whose cap covers its share of what is left ends the clamping.

Within a source every document is repeated ``floor(rate)`` times and a systematic sample, drawn
in seeded order inside size classes, takes one more copy. The sample's running index is laid over
all cells of a source (size class x bucket), so no task ever holds a whole source.

Edge cases: null text has size 0 and takes nothing; a null source is a source of its own, ranked
last; repeated rows are separate documents; an empty table gives an empty result; further columns
are ignored. Null or repeated doc_id: the seeded order also hashes the text, and rows equal in
both are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, hinted, saved

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
#: Rows of one size class and source that one sorting task handles, about. Buckets are ranges of the seeded key, so the
#: order (class, key) and with it the result does not depend on their number.
ROWS_PER_BUCKET = 20_000


def sized(docs: DataFrame, seed: str, buckets: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, the ``keep`` columns, source key, size in words, seeded key, size class and bucket."""
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), F.coalesce("text", F.lit(""))))
    bits = F.bin("size")
    return (
        docs.select("doc_id", "source", *keep, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), key.alias("key"))
        .withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("~null")))
        .withColumn("cls", F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 3)))
        .withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * buckets / F.lit(1 << 32)).cast("bigint"))
    )


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(skey, source, source_size) with weight, target words and rate.

    One row per source: the two unpartitioned windows run over that dimension, not over documents.
    """
    wide = "decimal(38,0)"
    ranked = sources.withColumn("pos", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("pos", F.lit(len(weights))) + 1).cast("int")).cast("bigint"))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_epochs)
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("pos").asc())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(1))
    left = (
        ranked.withColumn("at", F.row_number().over(order))
        .withColumn("words_left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("free", F.col("cap").cast(wide) * F.col("weight_left") >= F.col("weight").cast(wide) * F.col("words_left"))
    )
    level = F.min(F.when(F.col("free"), F.struct("at", "words_left", "weight_left"))).over(every)
    return (
        left.withColumn("level", level)
        .withColumn("clamped", F.col("at") < F.col("level.at"))
        .withColumn("target", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("level.words_left")).cast("double") / F.col("level.weight_left").cast("double")))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .select("skey", "source_size", "weight", "clamped", "target", "rate")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, rows_per_bucket: int = ROWS_PER_BUCKET, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its size, its source's words and target, how often the mix takes it, and the ``keep`` columns."""
    buckets = max(1, -(-docs.count() // rows_per_bucket))
    rows = sized(docs, seed, buckets, keep)
    cells = saved(sized(docs, seed, buckets).groupBy("skey", "source", "cls", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    targets = source_targets(cells.groupBy("skey", "source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    start = F.coalesce(F.sum("n").over(W.partitionBy("skey").orderBy("cls", "bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = saved(cells.select("skey", "cls", "bucket", start.alias("start")).join(targets, "skey"))
    at = F.col("start") + F.row_number().over(W.partitionBy("skey", "cls", "bucket").orderBy("key"))
    part = F.col("rate") - F.floor("rate")
    extra = F.floor(F.col("at") * part + 0.5) - F.floor((F.col("at") - 1) * part + 0.5)
    return (
        rows.join(hinted(cells), ["skey", "cls", "bucket"])
        .withColumn("at", at)
        .withColumn("repeats", (F.floor("rate") + extra).cast("bigint"))
        .select("doc_id", "source", *keep, "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))
    )


def op4_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce(text, '')) AS key
  FROM documents),
c AS (SELECT *, lpad(CAST(len(bin(size)) AS VARCHAR), 2, '0') || substr(bin(size), 1, 3) AS cls FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS pos FROM s),
w AS (SELECT *, CAST([1, 2, 3][pos % 3 + 1] AS BIGINT) AS weight, source_size * 3 AS cap FROM r),
o AS (SELECT *, row_number() OVER q AS idx,
         sum(source_size) OVER () - coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
         sum(weight) OVER () - coalesce(sum(weight) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left
      FROM w WINDOW q AS (ORDER BY CAST(cap AS DOUBLE) / weight, pos)),
f AS (SELECT * FROM o WHERE CAST(cap AS HUGEINT) * weight_left >= CAST(weight AS HUGEINT) * words_left ORDER BY idx LIMIT 1),
t AS (SELECT o.source, o.source_size,
         CASE WHEN o.idx < f.idx THEN CAST(o.cap AS DOUBLE) ELSE CAST(o.weight * f.words_left AS DOUBLE) / CAST(f.weight_left AS DOUBLE) END AS target
      FROM o, f),
i AS (SELECT c.doc_id, c.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY c.source ORDER BY c.cls, c.key) AS idx
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + floor(idx * (rate - floor(rate)) + 0.5) - floor((idx - 1) * (rate - floor(rate)) + 0.5)) AS BIGINT) AS taken
FROM i
"""
