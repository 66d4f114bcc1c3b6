"""Exact passage dedup over sparse suffixes.

Only suffixes that start at minimiser positions are kept (see ``anchors``): equal windows of PASSAGE
words select the same minimiser at the same place, so all copies of a window meet under its anchor,
the KMER words that the suffix starts with. Suffixes whose anchor is unique cannot match and go after
one count. A phrase, all words of the windows that select one anchor, is counted as a whole, and its first
place is the smallest (doc_id, text hash, word). Where an anchor has a single phrase, that settles all
windows. Where it has several, one suffix of each stays:

* they are sorted by the words from the anchor on, and neighbours tell how far each matches any other to
  the right; sorted by the words before the anchor, backwards, neighbours tell how far to the left;
* a window can be repeated only if it lies between these two bounds. The best partner to the right need
  not be the one to the left, so these windows are candidates: equal ones are counted, weighted
  with the copies of their phrases, and their first place is taken over all.

Sorts are by range over all tasks, anchor first, so a hot anchor is many tasks; the first and last suffix
of a batch have a neighbour elsewhere and are taken to match as far as they reach, which only adds candidates.

A window with two places or more is a repeated passage; a word is removed if and only if some window
over it also stands at an earlier place (by doc_id, then place). The first copy of a window is never
removed as a copy of itself, and every removed word still stands where its earliest copy does.

Keys are 64-bit hashes together with the anchor's own 64 bits. All counts are combined map-side, so that
copies of one text cost a count, and windows cost one row per distinct phrase.

Edge cases: null texts have no words; texts shorter than PASSAGE have no spans; repeated rows repeat each
other and, being equal in place too, neither counts as later; a null doc_id sorts last; doc_ids that are
not numbers are ordered by their hash; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import anchored, id_type, keyed, same_row, signed
from .common import drop, saved
from .wordhash import Rolling, batches, mix, words

PASSAGE, KMER = 50, 16
#: Windows that can select one anchor; their marks are the bits of one long.
MOST = PASSAGE - KMER + 1
_WINDOWS = Rolling(0x9FB21C651E98DF25)


def _ranges(start: np.ndarray, size: np.ndarray, step: int = 1) -> np.ndarray:
    """All of start, start + step .. (size of them), one after another."""
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(start, size) + step * within


def _cuts(size: np.ndarray, width: int = 1) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(size * width))).astype(np.int32)


def _suffixes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(th, rank, text, look: list of (anchor, phrase, at, off, n, times)) to one suffix per phrase.

    ahead and behind are the words after and (backwards) before the anchor in 16 bits each, windows the hashes of all n windows.
    """
    for batch in rows:
        look = batch.column("look")
        for lo, hi, data, offsets in batches(batch.column("text")):
            part = look.slice(lo, hi - lo)
            sizes = np.diff(np.asarray(part.offsets))
            if not sizes.sum():
                continue
            _, _, hashes, first = words(data, offsets)
            flat = part.flatten()
            anchor, phrase, at, off, n, times = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(6))
            text = np.repeat(np.arange(hi - lo), sizes)
            begin = at + first[text]
            start = _ranges(begin, n)
            value = mix(_WINDOWS.ranges(_WINDOWS.prefix(hashes), start, start + PASSAGE), 62)
            code, after = (hashes >> np.uint64(48)).astype(">u2"), n + PASSAGE - 1 - off - KMER
            ahead, behind = code[_ranges(begin + off + KMER, after)], code[_ranges(begin + off - 1, off, -1)]
            packed = [pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(_cuts(size, 2)), pa.py_buffer(codes.tobytes())]) for codes, size in ((ahead, after), (behind, off))]
            row = pa.array(text + lo)
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, (anchor, phrase, at, off, n, times)), batch.column("rank").take(row), batch.column("th").take(row), *packed, pa.ListArray.from_arrays(pa.array(_cuts(n)), signed(value))],
                ["anchor", "phrase", "at", "off", "n", "times", "rank", "th", "ahead", "behind", "windows"],
            )


def _matched(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """How many words of ``name`` each suffix of a sorted batch shares with the better of its neighbours of the same anchor."""
    column, anchor = batch.column(name).cast(pa.large_binary()), batch.column("anchor").to_numpy()
    edge = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    codes = np.frombuffer(b"".join(column.to_pylist()), ">u2").astype(np.int32)
    size = np.diff(edge) // 2
    table = np.full((len(column), PASSAGE), -1, np.int32)
    table[np.repeat(np.arange(len(column)), size), _ranges(np.zeros(len(column), np.int64), size)] = codes
    same = (table[1:] == table[:-1]) & (table[1:] >= 0)
    common = np.where(anchor[1:] == anchor[:-1], same.argmin(axis=1), 0)  # a row has fewer than PASSAGE codes, so there is a first difference
    return np.maximum(np.append(common, PASSAGE), np.concatenate(([PASSAGE], common)))


def _reach_ahead(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes in the order of ``ahead``, which gives way to how far they match to the right."""
    for batch in rows:
        yield batch.drop_columns(["ahead"]).append_column("reach", pa.array(_matched(batch, "ahead").astype(np.int32)))


def _candidates(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes in the order of ``behind`` to the marks of their windows between both bounds (all, if the phrase has several copies); suffixes without any go."""
    for batch in rows:
        off, n, times, reach = (batch.column(c).to_numpy() for c in ("off", "n", "times", "reach"))
        each, offset = np.repeat(np.arange(len(n)), n), _ranges(np.zeros(len(n), np.int64), n)
        before = off[each] - offset
        held = (times[each] > 1) | ((before <= _matched(batch, "behind")[each]) & (PASSAGE - KMER - before <= reach[each]))
        marks = np.zeros(len(n), np.int64)
        np.bitwise_or.at(marks, each[held], np.int64(1) << offset[held])
        some = np.flatnonzero(marks)
        row = pa.array(some)
        yield pa.RecordBatch.from_arrays([batch.column("anchor").take(row), batch.column("phrase").take(row), pa.array(marks[some])], ["anchor", "phrase", "marks"])


def passages(docs: DataFrame) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """(doc_id, th, at, repeated, later), and the saved tables that it reads: bit i stands for the window of PASSAGE words from word at + i on."""
    kind = id_type(docs)
    texts = keyed(docs)
    numeric = kind in ("bigint", "int", "smallint", "tinyint")
    rank = F.coalesce(F.col("doc_id").cast("bigint") if numeric else F.xxhash64("doc_id"), F.lit((1 << 63) - 1)) if kind != "void" else F.lit((1 << 63) - 1)
    phrases = texts.mapInArrow(anchored(PASSAGE, KMER, True), f"doc_id {kind}, th binary, anchor bigint, place int, at int, n int, phrase bigint")
    # Counts are saved, so that both sides of the joins are plain shuffles, which AQE can split where a key is hot.
    known = phrases.groupBy("anchor").agg(F.count("*").alias("copies"), F.min("phrase").alias("lo"), F.max("phrase").alias("hi")).where("copies > 1")
    known = saved(known.select("anchor", (F.col("lo") == F.col("hi")).alias("one")))
    hits = saved(phrases.join(known, "anchor").select("doc_id", "th", rank.alias("rank"), "anchor", "phrase", "at", (F.col("place") - F.col("at")).alias("off"), "n", "one"))
    groups = hits.groupBy("anchor", "phrase", "off", "n", "one").agg(F.count("*").alias("times"), F.min(F.struct("rank", "th", "at", "doc_id")).alias("ref"))
    groups = saved(groups)
    # One copy of each phrase of an anchor that has several.
    look = groups.where("not one").groupBy(F.col("ref.doc_id").alias("_id"), F.col("ref.th").alias("_th"))
    look = look.agg(F.collect_list(F.struct("anchor", "phrase", F.col("ref.at").alias("at"), "off", "n", "times")).alias("look"))
    asked = texts.join(look, same_row(texts, look)).select("th", rank.alias("rank"), "text", "look")
    common = "anchor bigint, phrase bigint, at int, off int, n int, times bigint, rank bigint, th binary"
    # Saved, as a sort by range reads its input twice. The window hashes, most of a suffix, stay out of both sorts.
    suffixes = saved(asked.mapInArrow(_suffixes, f"{common}, ahead binary, behind binary, windows array<bigint>"))
    sortable = suffixes.select("anchor", "phrase", "off", "n", "times", "ahead", "behind")
    keys = "anchor bigint, phrase bigint, off int, n int, times bigint"
    ahead = saved(sortable.repartitionByRange("anchor", "ahead").sortWithinPartitions("anchor", "ahead").mapInArrow(_reach_ahead, f"{keys}, behind binary, reach int"))
    behind = ahead.repartitionByRange("anchor", "behind").sortWithinPartitions("anchor", "behind")
    marked = saved(behind.mapInArrow(_candidates, "anchor bigint, phrase bigint, marks bigint"))
    drop(ahead)
    # An anchor and a phrase name one suffix.
    held = suffixes.select("anchor", "phrase", "times", "rank", "th", "at", "windows").join(marked, ["anchor", "phrase"])
    held = held.select("anchor", "phrase", "times", "rank", "th", "at", "marks", F.posexplode("windows").alias("offset", "hash")).where("shiftright(marks, offset) & 1 = 1")
    asked = saved(held.select("anchor", "phrase", "times", "rank", "th", "hash", "offset", (F.col("at") + F.col("offset")).alias("at")))
    drop(suffixes, marked)
    twice = asked.groupBy("anchor", "hash").agg(F.sum("times").alias("total"), F.min(F.struct("rank", "th", "at")).alias("first")).where("total > 1")
    twice = saved(twice.select("anchor", "hash", "first"))
    found = asked.join(twice, ["anchor", "hash"]).groupBy("anchor", "phrase").agg(F.collect_set(F.struct("offset", "first")).alias("windows"))
    whole = groups.where("one").select("anchor", "phrase", F.expr("named_struct('rank', ref.rank, 'th', ref.th, 'at', ref.at)").alias("first"), F.lit(None).cast(found.schema["windows"].dataType).alias("windows"))
    settled = saved(whole.unionByName(found.select("anchor", "phrase", F.lit(None).cast(whole.schema["first"].dataType).alias("first"), "windows")))
    drop(known, groups, asked, twice)
    out = hits.join(settled, ["anchor", "phrase"])
    repeated = F.expr("if(one, shiftleft(1L, n) - 1, aggregate(windows, 0L, (m, w) -> m | shiftleft(1L, w.offset)))")
    later = F.expr("""if(one, if(named_struct('rank', rank, 'th', th, 'at', at) > first, shiftleft(1L, n) - 1, 0L),
        aggregate(windows, 0L, (m, w) -> m | if(named_struct('rank', rank, 'th', th, 'at', at + w.offset) > w.first, shiftleft(1L, w.offset), 0L)))""")
    return out.select("doc_id", "th", "at", repeated.alias("repeated"), later.alias("later")), (hits, settled)


def _under(at: np.ndarray, bits: np.ndarray, n_words: int) -> np.ndarray:
    """Which words lie under the windows that ``bits`` mark from the words ``at`` on."""
    row, offset = np.nonzero(bits[:, None] >> np.arange(MOST) & 1)
    start = at[row] + offset
    edge = np.bincount(start, minlength=n_words + 1) - np.bincount(start + PASSAGE, minlength=n_words + 1)
    return np.cumsum(edge[:n_words]) > 0


def _digest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        out: list[tuple] = []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            found = (text.as_py() or "").encode().split()
            if spans.is_valid and len(spans):
                at, both = spans.values.field(0).to_numpy(zero_copy_only=False).astype(np.int64), [spans.values.field(i).to_numpy(zero_copy_only=False) for i in (1, 2)]
                repeated, gone = (_under(at, bits, len(found)) for bits in both)
            else:
                repeated = gone = np.zeros(len(found), bool)
            edges = np.flatnonzero(np.diff(np.concatenate(([0], repeated.astype(np.int8), [0]))))
            kept = b" ".join(w for w, g in zip(found, gone.tolist(), strict=True) if not g) if gone.any() else b" ".join(found)
            out.append((len(found), int(repeated.sum()), int(gone.sum()), ",".join(f"{a}:{b}" for a, b in edges.reshape(-1, 2)), hashlib.sha256(kept).hexdigest()))
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_words", "n_repeated", "n_removed", "spans", "kept_sha256"])


def dedup_passages(docs: DataFrame) -> DataFrame:
    """Per row: its words, those in repeated passages, those removed as later copies, the spans and the digest of the rest; saved, without other tables left."""
    texts = keyed(docs)
    found, tables = passages(docs)
    spans = found.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set(F.struct("at", "repeated", "later")).alias("spans"))
    out = texts.join(spans, same_row(texts, spans), "left").select("doc_id", "text", "spans")
    done = saved(out.mapInArrow(_digest, f"doc_id {id_type(docs)}, n_words bigint, n_repeated bigint, n_removed bigint, spans string, kept_sha256 string"))
    drop(*tables)
    return done


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k, md5(coalesce(text, '')) AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, {'k': k, 't': t, 'i': i} AS place, md5(array_to_string(w[i:i + 49], ' ')) AS s FROM (SELECT r, k, t, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
twice AS (SELECT s, min(place) AS earliest FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT r, j, bool_or(later) AS later FROM (SELECT r, unnest(range(i, i + 50)) AS j, place > earliest AS later FROM win JOIN twice ON twice.s = win.s) GROUP BY r, j),
span AS (SELECT r, g, min(j) - 1 AS a, max(j) AS b, count(*) AS n, count_if(later) AS gone FROM (SELECT r, j, later, j - row_number() OVER (PARTITION BY r ORDER BY j) AS g FROM hit) GROUP BY r, g),
per AS (SELECT r, sum(n) AS n, sum(gone) AS gone, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM span GROUP BY r),
kept AS (SELECT e.r, string_agg(word, ' ' ORDER BY e.j) AS text FROM (SELECT r, j, w[j] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS j FROM d)) e ANTI JOIN (SELECT r, j FROM hit WHERE later) h ON h.r = e.r AND h.j = e.j GROUP BY e.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_repeated, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, '') AS spans, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN per ON per.r = d.r LEFT JOIN kept ON kept.r = d.r"""
