"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Two fixed base rules reject short and self-repeating texts. Four further signals (symbols, repeated lines,
repeated words, word length), each a whole number from 0 to 100 on a fixed scale, give one score, their
largest. Its cutoffs become rules only where labelled holdout rows prove them safe: in each stratum (lang)
cutoffs are tested from the mildest to the strictest, and a cutoff is certified while the exact binomial
tail P[Bin(n, ALPHA) <= k] of its k false rejections among n good rows stays within DELTA divided by the
number of strata (Bonferroni across strata, fixed sequence within one). So with probability 1 - DELTA no
stratum's rule falsely rejects more than ALPHA of its good texts. Of the certified cutoffs the one with the
most bad rows rejected beyond good ones takes effect, the mildest of equals. One score instead of a test
for each signal leaves ALPHA whole: a stratum needs log(DELTA / strata) / log(1 - ALPHA) good rows (217
for four strata); with fewer it keeps everything that passes the base rules.

Edge cases: a null text has no words and fails the base rules; a null lang is its own stratum;
labels that disagree about one doc_id, or are null, are not used; repeated rows are judged one by
one; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, hinted, saved, text_of

ALPHA = 0.02
DELTA = 0.05
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Cutoffs 5, 10, ..., 100 of the score.
STEP = 5
#: Characters of a mean word from which on the length signal counts, and what each further one adds.
LONG_WORD, LONG_STEP = 10, 10
#: Reach of the tail below its last term, in square roots of that term's index: what lies beyond is below the smallest double.
REACH = 40


def text_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """Word, symbol, line and repetition counts of every whole text, next to the ``keep`` columns."""
    text = text_of(docs)
    base = docs.select(*keep, text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    base = base.select(
        *keep, "words", F.size("words").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        lines.alias("lines"),
        F.when(F.size("words") > WINDOW, hashes).alias("hashes"),
    )
    # Only texts in which some window hash occurs twice pay for the exact count on window strings.
    maybe = F.size("hashes") > F.size(F.array_distinct("hashes"))
    windows = F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.struct(F.array_join(F.slice("words", i, WINDOW), " ").alias("w"), i.alias("i")))
    base = base.select(
        *keep, "n_words", "word_chars", "n_symbols", F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(maybe, F.sort_array(windows)).alias("sorted"),
    )

    def twin(s: Column, k: Column) -> Column:
        same = lambda other: F.coalesce(F.get("sorted", other)["w"] == s["w"], F.lit(False))
        return same(k - 1) | same(k + 1)

    at = F.sort_array(F.transform(F.filter("sorted", twin), lambda s: s["i"]))
    base = base.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.when(F.col("sorted").isNotNull(), at).alias("at"))
    covered = F.aggregate(F.transform("at", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return base.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def with_score(stats: DataFrame) -> DataFrame:
    """The largest of four signals, each a whole number from 0 to 100 that is higher for worse texts."""
    share = lambda top, of: F.floor(100 * F.col(top) / F.greatest(F.lit(1), F.col(of)))
    length = F.floor(LONG_STEP * F.col("word_chars") / F.greatest(F.lit(1), F.col("n_words"))) - LONG_STEP * LONG_WORD
    signals = [share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), length]
    return stats.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), F.greatest(*signals))).cast("int"))


def log_factorial(x: Column) -> Column:
    """log(x!) by Stirling's series eight places further on, correct to double precision."""
    z = x + 9.0
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    steps = F.log(x + 1.0)
    for i in range(2, 9):
        steps = steps + F.log(x + float(i))
    return (z - 0.5) * F.log(z) - z + math.log(2 * math.pi) / 2 + series - steps


def log_binomial_tail(n: Column, k: Column, alpha: float) -> Column:
    """log P[Bin(n, alpha) <= k] for k < alpha * n: the last term, times the sum of all terms relative to it.

    Terms fall from the k-th one down, faster than a normal density, so those beyond REACH root k are zero as doubles.
    """
    last = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(alpha)) + (n - k) * F.log(F.lit(1 - alpha))
    reach = F.least(k, (REACH * F.sqrt(k)).cast("bigint") + 1000)
    down = F.when(reach > 0, F.sequence(k, k - reach + 1)).otherwise(F.array().cast("array<bigint>"))
    step = lambda a, i: a["term"] * i * (1 - alpha) / ((n - i + 1) * alpha)
    total = F.aggregate(down, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")), lambda a, i: F.struct(step(a, i).alias("term"), (a["total"] + step(a, i)).alias("total")))["total"]
    return last + F.log(total)


def certified_cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, cutoff), from rows (stratum, good, score); strata without a certified and useful cutoff are left out."""
    bins = labelled.groupBy("stratum", F.floor(F.col("score") / STEP).cast("int").alias("bin")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    # One row per stratum holds its 21 bins; the window over all of them counts the strata for Bonferroni.
    rows = bins.groupBy("stratum").agg(F.sum("good").alias("n"), F.collect_list(F.struct("bin", "good", "bad")).alias("bins")).withColumn("tests", F.count("*").over(W.partitionBy(F.lit(1))))
    above = lambda name, b: F.aggregate(F.filter("bins", lambda x: x["bin"] >= b), F.lit(0).cast("bigint"), lambda a, x: a + x[name])
    cuts = rows.select("stratum", "n", "tests", F.explode(F.transform(F.sequence(F.lit(1), F.lit(100 // STEP)), lambda b: F.struct(b.alias("bin"), above("good", b).alias("k"), above("bad", b).alias("hit")))).alias("c")).select("stratum", "n", "tests", "c.*")
    safe = F.when((F.col("n") > 0) & (F.col("k") < alpha * F.col("n")), log_binomial_tail(F.col("n"), F.col("k"), alpha) <= F.log(delta / F.col("tests"))).otherwise(False)
    # Fixed sequence: a cutoff counts only if all milder ones are certified as well.
    cuts = cuts.withColumn("safe", F.min(safe).over(W.partitionBy("stratum").orderBy(F.desc("bin"))))
    return cuts.where("safe and hit > k").groupBy("stratum").agg(F.max_by(F.col("bin") * STEP, F.struct(F.col("hit") - F.col("k"), "bin")).alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Statistics and verdict of every row of ``docs`` (the ``keep`` columns identify it)."""
    stats = with_score(saved(text_stats(docs.withColumn("stratum", F.coalesce("lang", F.lit("~null"))), *keep, "stratum")))
    stats = stats.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    agreed = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    labelled = stats.where(~F.col("base_failed")).join(agreed, "doc_id").select("stratum", (F.col("low") == 1).alias("good"), "score")
    cutoffs = saved(certified_cutoffs(labelled, alpha, delta))
    judged = stats.join(hinted(cutoffs), "stratum", "left")
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("score") >= F.col("cutoff"), F.lit(False)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; repeated and null ids are told apart by all that a verdict depends on: language and text."""
    # Lengths keep the parts of the key apart; null differs from every string.
    part = lambda c: F.concat_ws("|", F.coalesce(F.length(c), F.lit(-1)), c)
    key = F.md5(F.concat_ws("|", part(F.col("doc_id").cast("string")), part(F.col("lang")), text_of(docs)))
    marked = docs.withColumn("__row", key)
    bad = saved(judge(marked, labels, keep=("doc_id", "__row")).where("not kept").select("__row").distinct())
    return marked.join(hinted(bad, 10 * BROADCAST_ROWS), "__row", "left_anti").select(*docs.columns)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: First part of the oracle: ``s`` holds every document's statistics, ``cut`` the certified cutoffs.
ORACLE_WITH = r"""
d AS (SELECT doc_id, coalesce(lang, '~null') AS stratum, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) > 8)),
twice AS (SELECT doc_id, w FROM win GROUP BY ALL HAVING count(*) > 1),
cover AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT win.doc_id, unnest(range(i, i + 8)) AS j FROM win JOIN twice ON win.doc_id = twice.doc_id AND win.w = twice.w) GROUP BY doc_id),
s0 AS (SELECT d.doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words,
        CAST(len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(len(text) - len(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN lines ON d.doc_id = lines.doc_id LEFT JOIN cover ON d.doc_id = cover.doc_id),
s AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        greatest(0, least(100, greatest(100 * n_symbols // greatest(1, n_words), 100 * n_dup_lines // greatest(1, n_lines), 100 * n_repeat_words // greatest(1, n_words),
          10 * word_chars // greatest(1, n_words) - 100))) AS score FROM s0),
lab AS (SELECT doc_id, min(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = max(quality)),
long AS (SELECT stratum, q = 1 AS good, score FROM s JOIN lab USING (doc_id) WHERE NOT base_failed),
bins AS (SELECT g.stratum, b.bin, (SELECT count(*) FROM long x WHERE x.stratum = g.stratum AND good) AS n,
        (SELECT count(*) FROM long x WHERE x.stratum = g.stratum AND good AND score // 5 >= bin) AS k,
        (SELECT count(*) FROM long x WHERE x.stratum = g.stratum AND NOT good AND score // 5 >= bin) AS hit
      FROM (SELECT DISTINCT stratum FROM long) g, (SELECT unnest(range(1, 21)) AS bin) b),
tests AS (SELECT count(*) AS m FROM (SELECT DISTINCT stratum FROM long)),
ok AS (SELECT *, CASE WHEN n > 0 AND k < 0.02 * n THEN
          list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02) + (n - i) * ln(0.98)))) <= 0.05 / m
        ELSE false END AS safe FROM bins, tests),
seq AS (SELECT *, bool_and(safe) OVER (PARTITION BY stratum ORDER BY bin DESC) AS certified FROM ok),
best AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY hit - k DESC, bin DESC) AS place FROM seq WHERE certified AND hit > k),
judged AS (SELECT s.*, NOT base_failed AND coalesce(score < 5 * bin, true) AS kept FROM s LEFT JOIN best ON best.stratum = s.stratum AND place = 1)
"""
ORACLE = f"WITH {ORACLE_WITH} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
