r"""Benchmark decontamination by a prefix-filtered set join (DataFrame functions only).

An item's windows are all runs of ``window`` consecutive words (a shorter item is one window). A
window is a set of word shingles at fixed offsets, and a document holds it only if it holds all of
them, so its rarest shingle alone is the necessary prefix. Documents' shingles are joined once with those of the items, on the words
themselves; what is found is counted, which orders shingles by how often they occur in the whole corpus, and joined with the prefixes.
The match fixes where the window would start (positional bound), windows that would leave the document
are dropped (length bound), and every candidate is verified word by word against the document.

Edge cases: null and empty texts have no words and no hits; items without words have no windows; a
null item_id is the item ``null``; repeated items and repeated documents are allowed, and every
document row is verified on its own text; empty tables give empty results or no hits; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, drop, hinted, saved, text_of

#: The ASCII characters that are no part of words, and the pattern of a run of them.
BETWEEN = "".join(chr(c) for c in range(128) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or 0x41 <= c <= 0x5A))
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Words per shingle; windows of fewer words use all of them as one shingle.
SHINGLE = 3


def words_of(df: DataFrame) -> Column:
    """Words of the text column; a split on the other characters is several times faster than extracting matches."""
    text = F.btrim(text_of(df), F.lit(BETWEEN))
    ascii_only = F.octet_length(text) == F.length(text)
    words = F.when(ascii_only, F.split(F.lower(text), GAP)).otherwise(F.transform(F.split(text, GAP), ascii_lower))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(words)


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id (string), w: one row per distinct window of an item."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words_of(benchmark).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (window - 1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("w")).distinct()


def doc_shingles(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, h (hash of the text), at (0-based) and w0.. of every complete shingle of every row."""
    cols = [f"w{k}" for k in range(n)]
    words = docs.select("doc_id", F.xxhash64("text").alias("h"), words_of(docs).alias("words"))
    zipped = words.select("doc_id", "h", F.arrays_zip(*[F.slice("words", k + 1, F.size("words")) for k in range(n)]).alias("s"))
    # An outer explode: for an inner one the optimizer infers filters that would split every text again.
    exploded = zipped.select("doc_id", "h", F.posexplode_outer("s").alias("at", "s"))
    return exploded.select("doc_id", "h", "at", *[F.col("s")[str(k)].alias(c) for k, c in enumerate(cols)]).where(F.col(cols[-1]).isNotNull())


def matches(docs: DataFrame, windows: DataFrame, n: int) -> DataFrame:
    """doc_id, h, start and w: where a window of at least ``n`` words may stand, as its rarest shingle of ``n`` words does.

    The corpus is laid out once: what it holds of the windows' shingles is saved under their numbers, counted, and joined with the rarest ones.
    """
    cols = [f"w{k}" for k in range(n)]
    starts = F.sequence(F.lit(1), F.size("w") - (n - 1))
    parts = windows.select("w", F.explode(F.transform(starts, lambda i: F.struct((i - 1).alias("off"), *[F.element_at("w", i + k).alias(c) for k, c in enumerate(cols)]))).alias("s"))
    parts = parts.select("w", "s.off", *[f"s.{c}" for c in cols]).distinct()
    vocabulary = saved(parts.select(*cols).distinct().withColumn("shingle", F.monotonically_increasing_id()))
    numbered = saved(parts.join(vocabulary, cols).select("w", "off", "shingle"))
    found = saved(doc_shingles(docs, n).join(hinted(vocabulary), cols).select("doc_id", "h", "at", "shingle"))
    often = found.groupBy("shingle").agg(F.count("*").alias("times"))
    # A shingle that never occurs rules its window out: it has no count and comes first.
    rarest = numbered.join(often, "shingle", "left").groupBy("w").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "off", "shingle")).alias("s"))
    wanted = saved(rarest.where("s.times > 0").select("w", "s.off", "s.shingle"))
    matched = saved(found.join(hinted(wanted), "shingle").select("doc_id", "h", (F.col("at") - F.col("off")).alias("start"), "w").where("start >= 0"))
    drop(vocabulary, numbered, found, wanted)
    return matched


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with n_words, n_hit, n_items and item_ids (sorted) of every row of ``docs``.

    ``keep`` must include doc_id.
    """
    windows = saved(item_windows(benchmark, window))
    kinds = sorted(r[0] for r in windows.select(F.least(F.size("w"), F.lit(SHINGLE))).distinct().collect())  # 1 to SHINGLE
    found = None
    for n in kinds:
        own = windows.where(F.size("w") >= SHINGLE if n == SHINGLE else F.size("w") == n).select("w").distinct()
        matched = matches(docs, own, n)
        found = matched if found is None else found.unionByName(matched)
    rows = docs.select(*dict.fromkeys([*keep, "text"])).withColumn("_h", F.xxhash64("text"))
    if found is None:
        words = rows.select(*keep, words_of(rows).alias("words"))
        none = F.lit(0).cast("bigint")
        return words.select(*keep, F.size("words").cast("bigint").alias("n_words"), none.alias("n_hit"), none.alias("n_items"), F.array().cast("array<string>").alias("item_ids"))
    by_window = windows.groupBy("w").agg(F.collect_set("item_id").alias("items"))
    found = found.distinct().join(hinted(saved(by_window)), "w")
    # Rows that share an id, or have none, are told apart by their text's hash; each is verified on its own text anyway.
    per_doc = found.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_own")).agg(F.collect_list(F.struct("start", "w", "items")).alias("cand"))
    # The text crosses the shuffle as it is and is split into words again behind it.
    joined = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_own")), "left")
    joined = joined.select(*keep, words_of(joined).alias("words"), "cand")
    true = F.filter("cand", lambda c: (c["start"] + F.size(c["w"]) <= F.size("words")) & (F.slice("words", c["start"] + 1, F.size(c["w"])) == c["w"]))
    joined = joined.select(*keep, F.size("words").cast("bigint").alias("n_words"), F.coalesce(true, F.array().cast("array<struct<start:int,w:array<string>,items:array<string>>>")).alias("hit"))
    spans = F.sort_array(F.transform("hit", lambda c: F.struct(c["start"].alias("b"), (c["start"] + F.size(c["w"])).alias("e"))))
    union = F.aggregate(
        spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["e"] - F.greatest(s["b"], a["to"]))).alias("n"), F.greatest(a["to"], s["e"]).alias("to")),
    )["n"]
    ids = F.sort_array(F.array_distinct(F.flatten(F.transform("hit", lambda c: c["items"]))))
    return joined.select(*keep, "n_words", union.cast("bigint").alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"), ids.alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with all their columns (packed meanwhile, so no name clashes)."""
    packed = docs.select("doc_id", "text", F.struct("*").alias("_doc"))
    return hits(packed, benchmark, window, keep=("doc_id", "_doc")).where("n_hit = 0").select("_doc.*")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return hits(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_WITH = r"""
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(words)) AS n, array_to_string(words[i:i + 9], ' ') AS w
       FROM (SELECT item, words, unnest(range(1, greatest(2, len(words) - 8))) AS i FROM b WHERE len(words) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS w
       FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(words) >= n)),
m AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.w = bw.w),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
"""
ORACLE = f"""WITH {ORACLE_WITH}
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN it ON d.doc_id = it.doc_id"""
