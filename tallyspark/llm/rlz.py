"""Substring dedup by counts of content-defined phrases and windows.

There is no greedy Lempel-Ziv parse and there are no reference blocks: which windows are repeated does
not depend on how a parse cuts the text. "Factor" below names a phrase that also occurs elsewhere.

The reference is the whole corpus: every text is cut at its anchors (see ``anchors``) into phrases,
the words of all windows that select one anchor, and phrases are looked up in the counts
of all phrases of all texts (a join, partitioned by hash). A phrase that also occurs elsewhere
is a factor: all windows in it are repeated, and adjacent factors run on into longer ones. Where a
factor ends the reference still knows the anchor but not the phrase; there the windows are looked
up one by one, which settles the words at factor boundaries exactly. Everywhere else nothing is
repeated. Every window is judged on the input, never on what is left.

Keys are pairs of independent 64-bit hashes (anchor with phrase, anchor with window). Repeated
anchors are counted with a map-side combine before rows are joined with them, so that copies of one
text cost a count; hot keys of the joins are split by AQE.

Edge cases: null texts have no words; texts shorter than a window lose nothing; repeated rows repeat
each other; rows may share a doc_id, null ones included; empty tables give empty results; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import anchored, id_type, keyed, same_row, signed
from .common import saved
from .wordhash import Rolling, batches, mix, words

WINDOW, KMER = 35, 12
_WINDOWS = Rolling(0xC2B2AE3D27D4EB4F)


def _boundary_windows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, text, look: list of (anchor, at, n)) to (doc_id, th, anchor, hash, at) of every window to look up."""
    for batch in rows:
        look = batch.column("look")
        for lo, hi, data, offsets in batches(batch.column("text")):
            part = look.slice(lo, hi - lo)
            sizes = np.diff(np.asarray(part.offsets))
            if not sizes.sum():
                continue
            _, _, hashes, first = words(data, offsets)
            flat = part.flatten()
            anchor, at, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            text = np.repeat(np.arange(hi - lo), sizes)
            each = np.repeat(np.arange(len(at)), n)
            within = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            start = at[each] + within
            whole = start + first[text[each]]
            value = mix(_WINDOWS.ranges(_WINDOWS.prefix(hashes), whole, whole + WINDOW), 61)
            row = pa.array(text[each] + lo)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("th").take(row), pa.array(anchor[each]), signed(value), pa.array(start.astype(np.int32))], ["doc_id", "th", "anchor", "hash", "at"])


def _kept(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans: list of (at, n) window runs) to the digest of the words that stay."""
    for batch in rows:
        spans, n_words, n_removed, digests = batch.column("spans"), [], [], []
        for text, runs in zip(batch.column("text"), spans, strict=True):
            found = (text.as_py() or "").encode().split()
            n_words.append(len(found))
            if runs.is_valid and len(runs):
                both = runs.values
                at, n = (both.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
                edge = np.bincount(at, minlength=len(found) + 1) - np.bincount(at + n + WINDOW - 1, minlength=len(found) + 1)
                gone = np.cumsum(edge[: len(found)]) > 0
                n_removed.append(int(gone.sum()))
                found = [w for w, g in zip(found, gone.tolist(), strict=True) if not g]
            else:
                n_removed.append(0)
            digests.append(hashlib.sha256(b" ".join(found)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _listed(rows: DataFrame, name: str, *cols: str) -> DataFrame:
    """One list of distinct ``cols`` per row key: equal rows have one between them, however many they are."""
    return rows.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set(F.struct(*cols)).alias(name))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, th, at, n): runs of n windows, from word ``at`` on, that also start elsewhere."""
    kind = id_type(docs)
    texts = keyed(docs)
    phrases = texts.mapInArrow(anchored(WINDOW, KMER, True), f"doc_id {kind}, th binary, anchor bigint, place int, at int, n int, phrase bigint")
    # Counts are saved before rows are joined with them: both sides of the join are then plain shuffles, which AQE can split where a key is hot.
    known = phrases.groupBy("anchor").agg(F.count("*").alias("times"), F.min("phrase").alias("lo"), F.max("phrase").alias("hi")).where("times > 1")
    known = saved(known.select("anchor", (F.col("lo") == F.col("hi")).alias("one")))
    hits = saved(phrases.join(known, "anchor").select("doc_id", "th", "anchor", "phrase", "at", "n", "one"))
    # An anchor with a single phrase is a factor wherever it stands; with several, each is counted.
    several = hits.where("not one")
    place = F.struct("doc_id", "th", "at")
    factor = several.groupBy("anchor", "phrase").agg(F.count("*").alias("times"), F.min(place).alias("reference"))
    several = several.join(saved(factor), ["anchor", "phrase"]).select("doc_id", "th", "anchor", "at", "n", (F.col("times") > 1).alias("factor"), place.eqNullSafe(F.col("reference")).alias("reference"))
    several = saved(several)
    # A window beside a factor may equal one inside another factor: one place of each factor is looked up too.
    look = _listed(several.where("not factor or reference"), "look", "anchor", "at", "n")
    asked = texts.join(look, same_row(texts, look), "left").where("look is not null").select("doc_id", "th", "text", "look")
    asked = saved(asked.mapInArrow(_boundary_windows, f"doc_id {kind}, th binary, anchor bigint, hash bigint, at int"))
    twice = asked.groupBy("anchor", "hash").agg(F.count("*").alias("times")).where("times > 1").select("anchor", "hash")
    single = asked.join(saved(twice), ["anchor", "hash"], "left_semi").select("doc_id", "th", "at", F.lit(1).alias("n"))
    factors = hits.where("one").select("doc_id", "th", "at", "n").unionByName(several.where("factor").select("doc_id", "th", "at", "n"))
    return factors.unionByName(single)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words of every row."""
    texts = keyed(docs)
    runs = _listed(repeated_runs(docs), "spans", "at", "n")
    out = texts.join(runs, same_row(texts, runs), "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_kept, f"doc_id {id_type(docs)}, n_words bigint, n_removed bigint, kept_sha256 string")


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM win JOIN twice ON twice.s = win.s),
each AS (SELECT r, j, w[j] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n FROM each ANTI JOIN gone ON gone.r = each.r AND gone.j = each.j GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.r = d.r"""
