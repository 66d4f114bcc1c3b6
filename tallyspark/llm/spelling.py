r"""Groups of spelling variants in the vocabulary of a corpus, by forward and reversed sorted dictionaries.

Two words are near if exactly one code point is inserted, deleted or replaced. Pairs are sought in classes: class
k holds the words of k and of k - 1 code points, and a near pair (at least one of its words has k) agrees around one
place i of 0 .. k-1: on the first i and on the last k-1-i code points. So one half stays intact: either i is in the upper half
and the words share a prefix, neighbours in the forward dictionary, or they share a suffix, neighbours in the
reversed one. A block is what shares such a half. A block of more than ``SCAN`` words is subdivided: its range of
places is halved again, which lengthens the shared prefix or the shared suffix, until it is small or holds one
place only (then its words differ in one letter, so it is no larger than the alphabet). The sorted dictionaries are
range-partitioned by block and scanned: words of a block are compared with the following ones, verified on their whole
length, and a pair counts in the one block whose range holds the length of its common prefix, so none is
listed twice and none is lost.

Words are counted where they are read: a task adds up at most ``HELD`` different words before it hands them on.

Edge cases: null and empty texts have no words; a null doc_id is the empty string in the checksum; repeated rows
count again; empty tables give an empty result; further columns are ignored. ``near_pairs`` takes any distinct words of
code points up to U+00FF.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, saved

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: A run whose checksum this divides loses a letter (planted misspellings of the query's contract).
PLANT_EVERY = 199
#: Different words that a counting task holds, and words of a block that is scanned without subdividing it.
HELD, SCAN = 200_000, 48
#: Latin-1 bytes of the alphabet A-Z a-z U+00C0-U+00FF, A-Z lower-cased; every other byte separates.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _counted(least: int, every: int):
    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in rows:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                # One byte a code point; what Latin-1 lacks separates.
                runs = Counter((text.as_py() or "").encode("latin-1", "replace").translate(FOLD).split())
                start = zlib.crc32(f"{'' if doc.as_py() is None else doc.as_py()}:".encode())
                for run, n in runs.items():
                    if len(run) < least:
                        continue
                    if every and not (h := zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)) % every:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least:
                            continue
                    held[run] += n
                if len(held) >= HELD:
                    yield flush()
        if held:
            yield flush()

    return count


def dictionary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = 0) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z lower-cased, of at least the given length and occurrences.

    ``every`` plants a misspelling where it divides the checksum of ``<doc_id>:<run>``; 0 plants none.
    """
    parts = docs.select("doc_id", "text").mapInArrow(_counted(least_length, every), "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _child(upper: bool) -> list:
    """Block columns of one half of the range [a, b] of a word of class k: shared prefix of a, shared suffix of k-1-b code points."""
    mid = F.expr("a + (b - a + 1) div 2")
    a, b = (mid, F.col("b")) if upper else (F.col("a"), mid - 1)
    key = F.concat(F.expr("left(word, a)"), F.lit("|"), F.expr("right(word, k - 1 - b)"))
    return [F.col("word"), F.col("n"), F.col("k"), a.cast("int").alias("a"), b.cast("int").alias("b")], key


def _halved(blocks: DataFrame) -> DataFrame:
    """Every block of more than one place as its two halves, with the key that their words share."""
    both = None
    for upper in (True, False):
        columns, key = _child(upper)
        half = blocks.select(*columns).withColumn("key", key)
        both = half if both is None else both.unionByName(half)
    return both


def _scanned(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs (word, n, near, near_n) of sorted blocks; a block that the end of a batch cuts waits for the next one."""
    rest = None
    for batch in rows:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        last = table.slice(table.num_rows - 1).to_pylist()
        keys = pa.table({c: table.column(c) for c in ("k", "a", "b", "key")})
        tail = table.num_rows
        same = {c: last[0][c] for c in keys.column_names}
        while tail and all(keys.column(c)[tail - 1].as_py() == v for c, v in same.items()):
            tail -= 1
        rest = table.slice(tail)
        if tail:
            yield from _near(table.slice(0, tail))
    if rest is not None and rest.num_rows:
        yield from _near(rest)


def _near(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """All near pairs of whole blocks; words as rows of bytes, read from the left and from the right."""
    words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    k, a, b, n = (table.column(c).to_numpy() for c in ("k", "a", "b", "n"))
    keys = table.column("key").to_pylist()
    fresh = np.ones(len(words), bool)
    fresh[1:] = [x != y for x, y in zip(keys[1:], keys, strict=False)]
    fresh[1:] |= (k[1:] != k[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    block = np.cumsum(fresh)
    length = np.fromiter(map(len, words), np.int64, len(words))
    width = int(length.max()) + 1
    right = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
    left = np.frombuffer(b"".join(w[::-1].ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
    i = np.arange(len(words))
    for step in range(1, len(words)):
        i = i[i + step < len(words)]
        i = i[block[i] == block[i + step]]
        if not len(i):
            break
        u, v = i[np.maximum(length[i], length[i + step]) == k[i]], step
        prefix = (right[u] != right[u + v]).argmax(axis=1)
        fits = (prefix >= a[u]) & (np.minimum(prefix, k[u] - 1) <= b[u])
        u, prefix = u[fits], prefix[fits]
        suffix = (left[u] != left[u + v]).argmax(axis=1)
        u = u[prefix + suffix >= k[u] - 1]
        if len(u):
            yield pa.RecordBatch.from_arrays(
                [pa.array([words[x].decode("latin-1") for x in u]), pa.array(n[u]), pa.array([words[x + v].decode("latin-1") for x in u]), pa.array(n[u + v])],
                ["word", "n", "near", "near_n"],
            )


def near_pairs(words: DataFrame, scan: int = SCAN) -> DataFrame:
    """(word, n, near, near_n): every pair of ``words`` (word, n; distinct words) one edit apart, once, saved."""
    block = ["k", "a", "b", "key"]
    classes = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("k"))
    level = saved(_halved(classes.select("*", F.lit(0).alias("a"), (F.col("k") - 1).alias("b"))))
    small = []
    while True:
        # One row a block and task crosses the shuffle; a block without a partner ends here.
        sizes = saved(level.groupBy(*block).agg(F.count("*").alias("words"), F.max(F.length("word")).alias("longest")).where("words > 1 and longest = k"))
        large = (F.col("words") > scan) & (F.col("a") < F.col("b"))
        joined = saved(level.join(sizes, block).select("word", "n", *block, large.alias("large")))
        drop(level, sizes)
        small.append(joined)
        if joined.where("large").isEmpty():
            break
        level = saved(_halved(joined.where("large")))
    scanned = None
    for part in small:
        part = part.where("not large").drop("large")
        scanned = part if scanned is None else scanned.unionByName(part)
    # Both dictionaries, each block in one range: forward ones sort by their prefix, reversed ones by their suffix.
    ordered = scanned.repartitionByRange(*block).sortWithinPartitions(*block, "word")
    pairs = saved(ordered.mapInArrow(_scanned, "word string, n bigint, near string, near_n bigint"))
    drop(*small)
    return pairs


def forms(words: DataFrame, ratio: int = RATIO, scan: int = SCAN) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of ``words`` (word, n).

    ``form`` is the near word of largest n (of equals the first in code-point order) if its n is at least ``ratio`` times the word's, which must be
    above 1, so that chains of forms end; ``root`` is the last of the chain, found by pointer doubling.
    """
    words = saved(words)
    pairs = near_pairs(words, scan)
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.max("n").alias("n"), F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    strong = -F.col("best.less") >= ratio * F.col("n")
    near = saved(best.select("word", "n_near", F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")))
    drop(pairs)
    chain = saved(near.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = saved(chain.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop(chain)
        chain = further
        if chain.where("moved").isEmpty():
            break
    joined = words.join(near, "word", "left").join(chain.select("word", "root"), "word", "left")
    out = saved(joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"))
    drop(words, near, chain)
    return out


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    return forms(dictionary(spark.read.parquet(f"{sf_dir}/documents.parquet"), every=PLANT_EVERY))


ORACLE = r"""WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n, CAST(doc_id AS VARCHAR) || ':' || run AS s FROM t WHERE length(run) >= 6 GROUP BY doc_id, run),
e AS (SELECT *, list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda x: CAST(('0x' || x) AS BIGINT)) AS bytes FROM g),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) AS h FROM e),
p AS (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM p WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
x AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
          UNION SELECT x.word, x.n, w.word, w.n FROM x JOIN w ON x.cut = w.word UNION SELECT w.word, w.n, x.word, x.n FROM x JOIN w ON x.cut = w.word),
f AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
j AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM w LEFT JOIN f ON w.word = f.word),
r AS (SELECT word, word AS at FROM j UNION ALL SELECT r.word, j.form FROM r JOIN j ON j.word = r.at WHERE j.form IS NOT NULL),
ends AS (SELECT r.word, r.at FROM r JOIN j ON j.word = r.at WHERE j.form IS NULL)
SELECT j.word, form, ends.at AS root, n, n_near, form_n FROM j JOIN ends ON ends.word = j.word"""
