r"""Ranked lexical search with integer scores over a two-level quantised index.

The index is one row a block of documents (``BLOCK_BYTES`` of text or ``BLOCK_DOCS`` documents, whole texts, every row and
every term), written to the shared folder. Its first level holds, by term, the places of the documents and one byte each:
the document's share of the score, rounded up to a multiple of ``STEP``. Its second level holds the exact occurrences and
document sizes. A search takes the queries in chunks and passes over blocks three times, each pass reading the columns
it needs only: the document frequencies of the chunk's terms; then, on bytes alone, lower bounds of all scores (a share
lies above its byte's multiple less one step), of which each task hands on the ``k`` best a query, so that the kth best of all is known; last, again on
bytes, upper bounds: every document whose upper bound reaches the kth lower bound is scored exactly from the second
level. A true member of the best ``k`` scores at least the kth lower bound, so none is lost.

A term's weight is floor(1000 ln((2N+2)/(2df+1))), a share (10^9 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L; N counts the documents with terms, L
all terms, n a document's; all integers have 64 bits.

Sizes: a task holds one block and ``CHUNK`` scores a document of it; the driver holds one chunk of queries and the
document frequencies of their terms. A text larger than a block is a block of its own.

Edge cases: null and empty texts have no terms, are never found and find nothing; equal scores rank by doc_id, null ones last; repeated
documents are found separately; each row of the queries is searched by itself, whatever its item_id; empty tables give an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, saved

K = 50
#: Bytes of text and documents of a block, queries of a chunk.
BLOCK_BYTES, BLOCK_DOCS, CHUNK = 1 << 20, 8192, 256
#: Shares lie below a million; a byte counts them in steps.
STEP = -(-1_000_000 // 255)
#: UTF-8 bytes: A-Z lower-cased, digits, letters and all bytes of other characters kept, every other byte separates.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 0x80 else 32 for c in range(256))
BLOCK = "sizes array<bigint>, terms binary, starts binary, docs binary, tfs binary"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order."""
    return (text or "").encode().translate(FOLD).split()


def _block(ids: list, texts: list[str | None], kind: pa.DataType) -> pa.RecordBatch:
    """One row of the index: for every term of the block the documents that hold it and how often."""
    number: dict[bytes, int] = defaultdict(lambda: len(number))
    term, tf, distinct, sizes = [], [], [], []
    for text in texts:
        found = Counter(terms_of(text))
        term.extend(map(number.__getitem__, found))
        tf.extend(found.values())
        distinct.append(len(found))
        sizes.append(sum(found.values()))
    term = np.array(term, np.int64)
    order = np.argsort(term, kind="stable")
    docs = np.repeat(np.arange(len(texts), dtype=np.uint16), distinct)[order]
    starts = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(number))))).astype(np.uint32)
    tf = np.array(tf, np.int64)[order]
    cells = [pa.array([ids], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int64()))]
    cells += [pa.array([x], pa.binary()) for x in (b" ".join(number), starts.tobytes(), docs.tobytes(), tf.astype(np.min_scalar_type(tf.max(initial=0))).tobytes())]
    return pa.RecordBatch.from_arrays(cells, ["ids", "sizes", "terms", "starts", "docs", "tfs"])


def _blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, texts, held, kind = [], [], 0, None
    for batch in rows:
        kind = batch.schema.field("doc_id").type
        for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            ids.append(doc.as_py())
            texts.append(text.as_py())
            held += len(texts[-1] or "")
            if held >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                yield _block(ids, texts, kind)
                ids, texts, held = [], [], 0
    if ids:
        yield _block(ids, texts, kind)


def _shares(sizes: np.ndarray, docs: np.ndarray, tf: np.ndarray, n: int, total: int) -> np.ndarray:
    m = 50 + 50 * sizes * n // total
    return 1_000_000_000 * tf // (1000 * tf + 20 * m[docs])


def _counts(cell: bytes, postings: int) -> np.ndarray:
    """Occurrences, stored in as few bytes as the block's largest needs."""
    return np.frombuffer(cell, f"u{max(1, len(cell) // max(1, postings))}").astype(np.int64)


def _quantised(n: int, total: int):
    """Adds the byte impacts of all postings to every block."""

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            impacts = []
            for sizes, docs, tfs in zip(*(batch.column(c) for c in ("sizes", "docs", "tfs")), strict=True):
                docs = np.frombuffer(docs.as_py(), np.uint16)
                share = _shares(sizes.values.to_numpy(), docs, _counts(tfs.as_py(), len(docs)), n, total)
                impacts.append((-(-share // STEP)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(impacts, pa.binary())], [*batch.schema.names, "impacts"])

    return add


class Index:
    """Blocks of an indexed corpus (a saved table), the number of documents with terms, and of all their terms."""

    def __init__(self, docs: DataFrame):
        kind = docs.schema["doc_id"].dataType.simpleString()
        raw = saved(docs.select("doc_id", "text").mapInArrow(_blocks, f"ids array<{kind}>, {BLOCK}"))
        size = raw.select(F.explode("sizes").alias("n")).where("n > 0").agg(F.count("*").alias("n"), F.sum("n").alias("total")).first()
        self.n, self.total, self.kind = size["n"], size["total"] or 0, kind
        # Without any term no block has a posting to quantise.
        self.blocks = saved(raw.mapInArrow(_quantised(self.n, max(1, self.total)), f"ids array<{kind}>, {BLOCK}, impacts binary"))
        drop(raw)

    def drop(self) -> None:
        drop(self.blocks)


def _query_terms(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        terms = [list(dict.fromkeys(terms_of(t.as_py()))) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(terms, pa.list_(pa.binary()))], ["item_id", "terms"])


def _found(terms: bytes, wanted: dict[bytes, int]) -> list[tuple[int, int]]:
    """(number in the block, number in ``wanted``) of the wanted terms that a block holds."""
    return [(k, wanted[t]) for k, t in enumerate(terms.split(b" ")) if t in wanted]


def _frequencies(wanted: dict[bytes, int]):
    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(wanted), np.int64)
        for batch in rows:
            for terms, starts in zip(batch.column("terms"), batch.column("starts"), strict=True):
                spans = np.diff(np.frombuffer(starts.as_py(), np.uint32).astype(np.int64))
                for here, there in _found(terms.as_py(), wanted):
                    df[there] += spans[here]
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(df[seen])], ["term", "df"])

    return count


def _sums(row: dict, wanted: dict[bytes, int], weight: np.ndarray, items: list[np.ndarray], n_items: int, values: np.ndarray, chosen: np.ndarray | None = None) -> np.ndarray:
    """Weighted sums of ``values`` (one a posting) for every query and document of a block; ``chosen`` marks the queries to sum for."""
    starts = np.frombuffer(row["starts"], np.uint32)
    docs = np.frombuffer(row["docs"], np.uint16)
    out = np.zeros((n_items, len(row["sizes"])), np.int64)
    for here, there in _found(row["terms"], wanted):
        span = slice(starts[here], starts[here + 1])
        who = items[there] if chosen is None else items[there][chosen[items[there]]]
        if weight[there] and len(who):
            # A document stands once in a term's list.
            out[np.ix_(who, docs[span])] += weight[there] * values[span]
    return out


def _lower(wanted: dict, weight: np.ndarray, items: list, n_items: int, k: int):
    """The ``k`` largest lower bounds of every query in the task's blocks."""

    def bound(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((n_items, k), np.int64)
        for batch in rows:
            for row in _rows(batch):
                byte = np.frombuffer(row["impacts"], np.uint8).astype(np.int64)
                sums = _sums(row, wanted, weight, items, n_items, np.where(byte > 0, (byte - 1) * STEP + 1, 0))
                best = np.partition(np.concatenate((best, sums), axis=1), -k, axis=1)[:, -k:]
        item, _ = at = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(best[at])], ["item", "bound"])

    return bound


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {c: batch.column(c)[i].values if pa.types.is_list(batch.schema.field(c).type) else batch.column(c)[i].as_py() for c in batch.schema.names}


def _rescored(wanted: dict, weight: np.ndarray, items: list, floor: np.ndarray, n: int, total: int):
    """Exact scores of every document whose upper bound reaches its query's ``floor``."""

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in _rows(batch):
                bound = STEP * _sums(row, wanted, weight, items, len(floor), np.frombuffer(row["impacts"], np.uint8).astype(np.int64))
                reached = (bound > 0) & (bound >= floor[:, None])
                chosen = reached.any(axis=1)
                if not chosen.any():
                    continue
                docs = np.frombuffer(row["docs"], np.uint16)
                share = _shares(row["sizes"].to_numpy(), docs, _counts(row["tfs"], len(docs)), n, total)
                exact = _sums(row, wanted, weight, items, len(floor), share, chosen)
                item, doc = at = np.nonzero(reached & (exact > 0))
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), row["ids"].take(pa.array(doc)), pa.array(exact[at])], ["item", "doc_id", "score"])

    return score


def search(index: Index, queries: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of every row of ``queries`` (item_id, text), saved."""
    spark = queries.sparkSession
    item_kind = queries.schema["item_id"].dataType.simpleString()
    texts = saved(queries.select("item_id", "text").mapInArrow(_query_terms, f"item_id {item_kind}, terms array<binary>"))
    stream, parts = texts.toLocalIterator(), []
    while chunk := list(islice(stream, CHUNK)):
        wanted: dict[bytes, int] = {}
        holders = defaultdict(list)
        for i, row in enumerate(chunk):
            for t in row["terms"]:
                holders[wanted.setdefault(bytes(t), len(wanted))].append(i)
        items = [np.array(holders[t]) for t in range(len(wanted))]
        weight = np.zeros(len(wanted), np.int64)
        for row in index.blocks.select("terms", "starts").mapInArrow(_frequencies(wanted), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
            weight[row["term"]] = math.floor(1000 * math.log((2 * index.n + 2) / (2 * row["df"] + 1)))
        bounds = index.blocks.select("sizes", "terms", "starts", "docs", "impacts").mapInArrow(_lower(wanted, weight, items, len(chunk), k), "item int, bound bigint")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound")))
        floor = np.zeros(len(chunk), np.int64)
        for row in bounds.withColumn("place", place).where(f"place <= {k}").where(f"place = {k}").collect():
            floor[row["item"]] = row["bound"]
        scored = index.blocks.mapInArrow(_rescored(wanted, weight, items, floor, index.n, max(1, index.total)), f"item int, doc_id {index.kind}, score bigint")
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = scored.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}")
        names = spark.createDataFrame([(i, row["item_id"]) for i, row in enumerate(chunk)], f"item int, item_id {item_kind}")
        parts.append(saved(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")))
    if not parts:
        return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {index.kind}, score bigint")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    drop(texts)
    return out


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    index = Index(docs)
    found = search(index, benchmark)
    index.drop()
    return found


ORACLE = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
q AS (SELECT item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark WHERE text IS NOT NULL),
c AS (SELECT CAST(count(*) AS BIGINT) AS N, CAST(sum(len(t)) AS BIGINT) AS L FROM d WHERE len(t) > 0),
m AS (SELECT doc_id, 50 + ((50 * CAST(len(t) AS BIGINT) * N) // L) AS m FROM d, c WHERE len(t) > 0),
tf AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * N + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c),
p AS (SELECT tf.doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * m)) AS s FROM tf JOIN w USING (term) JOIN m ON m.doc_id = tf.doc_id),
s AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM (SELECT item_id, unnest(t) AS term FROM q) JOIN p USING (term) GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50"""
