r"""Near-duplicate documents by SuperMinHash, banding, exact verification and union of roots.

A document's set is its distinct shingles of ``shingle`` words. Documents with equal sets form a class,
which a 128-bit key of the set names, so that groups of copies are one row before any bucket is built.
Each class has a SuperMinHash signature: an element's ranks at the places of the signature come from one
random permutation per element (correlated, without repetition), taken level by level; a text is done
as soon as its largest value is below the next level. BANDS bands of ROWS values each are bucket keys:
a pair at similarity 0.8 shares no bucket with probability (1 - 0.8**6)**48, below 5e-7.

Buckets never list all their pairs. First every class is verified against the pivot it meets most often
(the pivot of a bucket is its member with the largest buckets, so one hub serves a whole group of copies).
What then matters are buckets that hold more than one component:

* one with few pairs for its members (PAIRS_EACH each) lists those across components;
* a larger one is centred on a pivot c again (those whose pivots are linked with the largest pivot of
  their component share that one, so that a member of many buckets is one row): each member x is verified against c and represented by its
  difference from c, D(x) = x without c, then c without x. Two sets are similar enough if and only if
  9 * |x ^ y| <= |x| + |y|, so their differences must share at least
  (9 |D(x)| - |x| + 9 |D(y)| - |y|) / 18 elements. That is above 0 unless both are linked with c, so the
  first |D| - overlap + 1 elements of D, the rarest of the star first, are buckets of differences (prefix
  filter), in which c itself no longer is; an element that no other member has needs no bucket. Copies of one text
  differ from it at places of their own, so these buckets are small, and two copies are compared only if enough of their differences can
  follow the element that they share (positional filter).

Buckets of differences list all their pairs across components. What is left in a wide one are members apart
from its centre, and so at large from one another: centred on one of them, nearly all the others would differ
from it in the same elements, in as many buckets as these, level after level. So in one with more than
DEEP_PAIRS_EACH pairs for each member those outside its largest component meet all members, in cells of
CELL by CELL rows that are dealt out one by one; pairs that fail the filters are never written.

Nothing but the bands is approximate, links are confirmed on full sets, and rows are written in proportion
to members and their differences, and for a wide bucket of differences to its pairs across components over CELL.

Edge cases: texts without words have an empty set and stay alone; a null doc_id cannot be named, so for
``group`` such rows stay alone with a null component and are kept, while ``dedup`` treats them like others;
repeated rows share a class; documents that share a doc_id but not a text are in their own classes; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import id_type
from .common import drop, hinted, saved
from .components import components
from .wordhash import batches, grams, mix, words

#: Words of a shingle: of the query by its contract, and of everything else.
QUERY_SHINGLE, SHINGLE = 2, 5
BANDS, ROWS = 48, 6
SIGNATURE = BANDS * ROWS
#: Pairs for each member up to which a bucket of bands lists its pairs and is not centred on a pivot, and one of differences lists them in one cell.
PAIRS_EACH, DEEP_PAIRS_EACH = 8, 256
#: Members on either side of a cell of a wide bucket of differences.
CELL = 512
#: Rows of at most 100 bytes (class keys, roots, row keys) up to which a counted side is broadcast.
BROADCAST_KEYS = 100_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, text by text; per text the index of its first one)."""
    _, _, hashes, first = words(data, offsets, fold=True)
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    whole = (np.arange(len(hashes)) + n) <= first[1:][text]
    pairs = grams(hashes, n)
    short = np.flatnonzero((count > 0) & (count < n))
    value, owner = pairs[whole], text[whole]
    if len(short):
        # A text of fewer words than a shingle is one shingle; its length keeps it apart from longer ones.
        acc = [np.bitwise_xor.reduce(mix(hashes[first[i] : first[i + 1]] ^ mix(np.arange(count[i], dtype=np.uint64), 12), 11)) for i in short]
        value, owner = np.concatenate([value, mix(np.array(acc, np.uint64), 13)]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(count) + 1))


def super_minhash(value: np.ndarray, first: np.ndarray, m: int = SIGNATURE) -> np.ndarray:
    """Signatures (texts x m): level and 32 random bits of the smallest rank at each place."""
    texts = len(first) - 1
    out = np.full(texts * m, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(texts), np.diff(first))
    chosen: list[np.ndarray] = []  # slot swapped at each level, and what that slot holds since
    held: list[np.ndarray] = []
    for level in range(m):
        bits = mix(value, 100 + level)
        slot = ((bits >> np.uint64(32)) * np.uint64(m - level) >> np.uint64(32)).astype(np.int16) + np.int16(level)
        place, own = slot.copy(), np.full(len(value), level, np.int16)
        for k, v in zip(chosen, held, strict=True):  # the latest swap of a slot counts
            np.copyto(place, v, where=k == slot)
            np.copyto(own, v, where=k == level)
        np.minimum.at(out, owner * m + place, (np.uint64(level) << np.uint64(32)) | (bits & np.uint64(0xFFFFFFFF)))
        chosen.append(slot)
        held.append(own)
        done = out.reshape(texts, m).max(axis=1) < (np.uint64(level + 1) << np.uint64(32))
        stay = ~done[owner]
        if not stay.any():
            break
        if stay.sum() < 0.7 * len(stay):
            value, owner = value[stay], owner[stay]
            chosen, held = [x[stay] for x in chosen], [x[stay] for x in held]
    return out.reshape(texts, m)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _keys(value: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128-bit key of each set; empty for an empty set."""
    both = []
    for salt in (21, 22):
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix(value, salt))))
        both.append(mix(total[first[1:]] - total[first[:-1]], salt))
    raw = np.stack(both, axis=1).astype(">u8").tobytes()
    return [raw[i * 16 : i * 16 + 16] if first[i + 1] > first[i] else b"" for i in range(len(first) - 1)]


def _sketch(shingle: int):
    """mapInArrow function over (doc_id, t, text): n, the set's key and the band keys in place of the text."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for lo, hi, data, offsets in batches(batch.column("text")):
                value, first = shingle_sets(data, offsets, shingle)
                bands = super_minhash(value, first).reshape(hi - lo, BANDS, ROWS)
                key = np.full((hi - lo, BANDS), 0, np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for j in range(ROWS):
                    key = mix(key ^ bands[:, :, j], 31 + j)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(_signed(key.reshape(-1))))
                own = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "t")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(first).astype(np.int64)), pa.array(_keys(value, first), pa.binary()), lists], ["doc_id", "t", "n", "k", "bands"])

    return run


def _sets(shingle: int):
    """mapInArrow function over (k, text): the sorted shingle hashes of each text whose set has the key k."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            wanted = batch.column("k").to_pylist()
            for lo, hi, data, offsets in batches(batch.column("text")):
                value, first = shingle_sets(data, offsets, shingle)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(_signed(value)))
                ok = pa.array([a == b for a, b in zip(_keys(value, first), wanted[lo:hi], strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(wanted[lo:hi], pa.binary()), lists], ["k", "s"]).filter(ok)

    return run


def _linked(a: str, b: str, common: str) -> Column:
    """Whether sets of ``a`` and ``b`` elements with ``common`` ones are at a similarity of 0.8 or more."""
    return 9 * F.col(common) >= 4 * (F.col(a) + F.col(b))


def _similar_size(a: str, b: str) -> Column:
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) with their full sets sa and sb and the number of common elements."""
    end = lambda name: sets.select(F.col("k").alias(name), F.col("s").alias(f"s{name}"), F.size("s").alias(f"n{name}"))
    return pairs.join(end("b"), "b").join(end("a"), "a").withColumn("common", F.size(F.array_intersect("sa", "sb")))


def _apart(members: DataFrame, labels: DataFrame, each: int) -> DataFrame:
    """Members (bucket, k, n, side, far, pos) of buckets that hold several components, with their root and whether the bucket is wide.

    side 0 stands for any member; in a bucket of sides 1 and 2 only pairs of one with the other count.
    """
    rooted = members.join(hinted(labels, BROADCAST_KEYS).select(F.col("node").alias("k"), "root"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    size = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), *[F.count_if(F.col("side") == i).alias(f"m{i}") for i in range(3)]).where("lo <> hi and (m0 > 1 or m1 * m2 > 0)")
    size = saved(size.select("bucket", (F.col("m0") + F.col("m1") + F.col("m2")).alias("size"), (F.col("m0") * (F.col("m0") - 1) / 2 + F.col("m1") * F.col("m2")).alias("pairs")))
    out = saved(rooted.join(hinted(size, BROADCAST_KEYS), "bucket").withColumn("wide", F.col("pairs") > each * F.col("size")).drop("pairs"))
    drop(size)
    return out


def _numbered(members: DataFrame, i: int, *more: str) -> DataFrame:
    """Members as side ``i`` of a join on their bucket."""
    return members.select("bucket", *more, *[F.col(c).alias(f"{c}{i}") for c in ("k", "n", "side", "far", "pos", "root")])


def _met(met: DataFrame, sides: Column) -> DataFrame:
    """Pairs (a, b) across components, of joined members whose ``sides`` count, as far as sizes and distances from a shared centre allow.

    far and pos, where there is a centre, are the size of the difference from it and the place of the bucket's element in it:
    what follows the first common element has to be enough for the overlap that the pair needs.
    """
    enough = 18 * F.least(F.col("far1") - F.col("pos1"), F.col("far2") - F.col("pos2")) >= 9 * (F.col("far1") + F.col("far2")) - F.col("n1") - F.col("n2")
    near = F.coalesce((9 * F.abs(F.col("far1") - F.col("far2")) <= F.col("n1") + F.col("n2")) & enough, F.lit(True))
    return met.where(sides & (F.col("root1") != F.col("root2")) & _similar_size("n1", "n2") & near).select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b")).distinct()


def _listed(few: DataFrame) -> DataFrame:
    """Pairs (a, b) of buckets that are not wide."""
    sides = ((F.col("side1") == 0) & (F.col("k1") < F.col("k2"))) | ((F.col("side1") == 1) & (F.col("side2") == 2))
    return _met(_numbered(few, 1).join(_numbered(few, 2), "bucket"), sides)


def _crossed(wide: DataFrame) -> DataFrame:
    """Pairs (a, b) of wide buckets of differences: members outside the largest component of their bucket with all its members, cell by cell."""
    parts = wide.groupBy("bucket", "root").agg(F.count("*").alias("m"))
    parts = parts.groupBy("bucket").agg(F.max(F.struct("m", "root")).alias("top"), F.sum("m").alias("m"))
    cells = lambda m: F.ceil(m / CELL).cast("int")
    parts = saved(parts.select("bucket", F.col("top.root").alias("chief"), cells(F.col("m") - F.col("top.m")).alias("down"), cells(F.col("m")).alias("across")))
    placed = saved(wide.join(hinted(parts, BROADCAST_KEYS), "bucket").withColumn("own", F.xxhash64("k", "side")))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    at = lambda m: F.pmod("own", F.col(m)).cast("int")
    x = _numbered(placed.where("root <> chief").withColumn("i", at("down")).withColumn("j", every("across")), 1, "i", "j")
    y = _numbered(placed.withColumn("j", at("across")).withColumn("i", every("down")), 2, "i", "j", "chief")
    sides = ((F.col("side1") == 0) & (F.col("side2") == 0)) | (F.col("side1") + F.col("side2") == 3)
    out = saved(_met(x.join(y, ["bucket", "i", "j"]), sides & ((F.col("root2") == F.col("chief")) | (F.col("k1") < F.col("k2")))))
    drop(parts, placed)
    return out


def _pivots(members: DataFrame) -> DataFrame:
    """(bucket, degree, pivot, pn): the member whose buckets are the largest, from members (bucket, k, n, size)."""
    whole = members.groupBy("k").agg(F.sum("size").alias("degree"), F.collect_list("bucket").alias("buckets"), F.max("n").alias("n"))  # a class has as many rows as it has bands or prefix elements
    return whole.select("k", "n", "degree", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.max(F.struct("degree", "k", "n")).alias("top")).select("bucket", "top.degree", F.col("top.k").alias("pivot"), F.col("top.n").alias("pn"))


def _gathered(pivots: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, pivot) with the pivots that are linked with the largest one of their component replaced by it.

    Differences from any one centre decide a pair, be it in the bucket or not; the pivot that is replaced becomes a member.
    """
    own = pivots.groupBy("pivot").agg(F.max("degree").alias("degree")).join(hinted(labels, BROADCAST_KEYS).select(F.col("node").alias("pivot"), "root"), "pivot")
    own = saved(own)
    chief = own.groupBy("root").agg(F.max(F.struct("degree", "pivot")).alias("top")).select("root", F.col("top.pivot").alias("a"))
    pairs = saved(own.join(chief, "root").where("pivot <> a").select("a", F.col("pivot").alias("b")))
    near = _compared(pairs, sets).where(_linked("na", "nb", "common")).select(F.col("b").alias("pivot"), "a")
    out = saved(pivots.join(near, "pivot", "left").select("bucket", F.coalesce("a", "pivot").alias("pivot")))
    drop(own, pairs, pivots)
    return out


def _centred(wide: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, na, nb, linked, d): members b of wide buckets against their pivots a, with the difference d of b from a.

    The buckets of one component are gathered round one pivot, as far as it is linked with theirs.
    """
    pivots = _gathered(saved(_pivots(wide)), sets, labels)
    pairs = saved(wide.join(pivots, "bucket").where("k <> pivot").select(F.col("pivot").alias("a"), F.col("k").alias("b")).distinct())
    both = _compared(pairs, sets)
    out = saved(both.select("a", "b", "na", "nb", _linked("na", "nb", "common").alias("linked"), F.concat(F.array_except("sb", "sa"), F.array_except("sa", "sb")).alias("d")))
    drop(pivots, pairs)
    return out


def _deeper(stars: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets of differences: of every centre whose members are still in several components, prefixes of the differences, rarest elements first.

    An element that all but the centre have is in nearly every difference, and so stands last there.
    """
    rooted = stars.select("a", "b", "nb", "linked").join(hinted(labels, BROADCAST_KEYS).select(F.col("node").alias("b"), "root"), "b", "left")
    groups = rooted.groupBy("a").agg(F.min(F.coalesce("root", "b")).alias("lo"), F.max(F.coalesce("root", "b")).alias("hi"), F.max(F.when(F.col("linked"), F.col("nb"))).alias("most")).where("lo <> hi")
    groups = saved(groups.select("a", "most"))
    within_reach = saved(stars.join(hinted(groups, BROADCAST_KEYS), "a"))
    each = within_reach.select("a", "b", F.explode("d").alias("e"))
    often = each.groupBy("a", "e").agg(F.count("*").alias("times")).where("times > 1")
    shared = saved(each.join(often, ["a", "e"]).groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("times", "e"))).alias("shared")))
    far = F.size("d")
    # Overlaps that a partner not linked with the centre asks for, and that a linked one does (it has at most ``most`` elements).
    beyond = F.greatest(F.lit(1), F.ceil((9 * far - F.col("nb") + F.col("na") + 1) / 18))
    within = F.greatest(F.lit(1), F.ceil((9 * far - F.col("nb") - F.least(F.floor(5 * F.col("nb") / 4), F.col("most"))) / 9))
    # Elements that no other member has stand first, as many as ``alone``.
    alone = far - F.size("shared")
    prefix = lambda overlap: F.slice("shared.e", F.lit(1), F.greatest(F.lit(0), far - overlap + 1 - alone).cast("int"))
    other = F.when(~F.col("linked"), F.struct(F.lit(0).alias("side"), prefix(beyond).alias("e")))
    near = F.when(F.col("linked"), F.struct(F.lit(2).alias("side"), prefix(beyond).alias("e"))).when(F.col("most").isNotNull(), F.struct(F.lit(1).alias("side"), prefix(within).alias("e")))
    parts = within_reach.join(shared, ["a", "b"]).select("a", F.col("b").alias("k"), F.col("nb").alias("n"), far.alias("far"), alone.alias("alone"), F.explode(F.array_compact(F.array(other, near))).alias("part"))
    parts = parts.select("a", "k", "n", "far", "alone", "part.side", F.posexplode("part.e").alias("at", "e"))
    # Buckets of pairs beyond the centre's reach and of those across it are kept apart by one byte.
    kind = F.when(F.col("side") == 0, F.lit(b"\x00")).otherwise(F.lit(b"\x01"))
    out = saved(parts.select(F.concat(kind, F.unhex(F.lpad(F.hex("e"), 16, "0")), "a").alias("bucket"), "k", "n", "side", "far", (F.col("alone") + F.col("at")).alias("pos")))
    drop(groups, within_reach, shared)
    return out


def link(docs: DataFrame, shingle: int = SHINGLE, named: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Saved tables: rows (doc_id, t, n, k), classes (k, rep) and their components (node, root).

    t is the text's 128-bit digest, k the class (null without words, and with ``named`` without a doc_id), rep the
    least (is the id null, doc_id, t) of a class. Classes without any link have no component.
    """
    texts = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("t"), "text")
    sketch = saved(texts.mapInArrow(_sketch(shingle), f"doc_id {id_type(docs)}, t binary, n bigint, k binary, bands array<bigint>"))
    used = (F.col("n") > 0) & (F.col("doc_id").isNotNull() | F.lit(not named))
    rows = saved(sketch.select("doc_id", "t", "n", F.when(used, F.col("k")).alias("k")))
    rep = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "t")
    whole = saved(sketch.where(used).groupBy("k").agg(F.min(rep).alias("rep"), F.max("n").alias("n"), F.max_by("bands", "n").alias("bands")))
    drop(sketch)
    classes = saved(whole.select("k", "rep"))
    banded = whole.select("k", "n", F.explode("bands").alias("bucket"))
    shared = saved(banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    members = saved(banded.join(shared, "bucket").select(F.unhex(F.lpad(F.hex("bucket"), 16, "0")).alias("bucket"), "k", "n", "size"))
    drop(whole, shared)
    need = saved(members.select("k").distinct().join(classes, "k"))
    sets = texts.join(hinted(need, 2 * BROADCAST_KEYS).select("k", "rep"), texts["doc_id"].eqNullSafe(F.col("rep.doc_id")) & (texts["t"] == F.col("rep.t")))
    sets = saved(sets.select("k", "text").mapInArrow(_sets(shingle), "k binary, s array<bigint>").dropDuplicates(["k"]))
    drop(need)
    # Every class against the pivot that it meets most often.
    pivots = saved(_pivots(members))
    star = members.join(pivots, "bucket").where((F.col("k") != F.col("pivot")) & _similar_size("n", "pn")).groupBy(F.col("pivot").alias("a"), F.col("k").alias("b")).agg(F.count("*").alias("times"))
    best = saved(star.groupBy("b").agg(F.max(F.struct("times", "a")).alias("most")).select(F.col("most.a").alias("a"), "b"))
    drop(pivots)
    edges = [saved(_compared(best, sets).where(_linked("na", "nb", "common")).select("a", "b"))]
    drop(best)
    labels = components(edges[0])
    every = edges[0]
    level = members.select("bucket", "k", "n", F.lit(0).alias("side"), F.lit(None).cast("int").alias("far"), F.lit(None).cast("int").alias("pos"))
    deep = False
    while True:
        apart = _apart(level, labels, DEEP_PAIRS_EACH if deep else PAIRS_EACH)
        drop(members)
        if apart.isEmpty():
            drop(apart)
            break
        wide = not apart.where("wide").isEmpty()
        pairs = [_listed(apart.where("not wide"))]
        if wide and deep:
            pairs.append(_crossed(apart.where("wide")))
        found = [saved(_compared(x, sets).where(_linked("na", "nb", "common")).select("a", "b")) for x in pairs]
        drop(*pairs[1:])
        if wide and not deep:
            stars = _centred(apart.where("wide"), sets, labels)
            found.append(saved(stars.where("linked").select("a", "b")))
        drop(apart)
        for more in found:
            every = every.unionByName(more)
        edges += found
        if not all(more.isEmpty() for more in found):
            drop(labels)
            labels = components(every)
        if deep or not wide:
            break
        members = level = _deeper(stars, labels)
        drop(stars)
        deep = True
    drop(sets, *edges)
    return rows, classes, labels


def group(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows, classes, labels = link(docs, shingle, named=True)
    rooted = classes.select("k", F.col("rep.doc_id").alias("doc")).join(labels.select(F.col("node").alias("k"), "root"), "k")
    lowest = saved(rooted.groupBy("root").agg(F.min("doc").alias("component_id")))
    # Only classes of more than one row or with links can have another component than the row's own id.
    alone = classes.join(labels.select(F.col("node").alias("k")), "k", "left_anti").select("k", F.col("rep.doc_id").alias("component_id"))
    named = saved(rooted.join(lowest, "root").select("k", "component_id").unionByName(alone))
    drop(classes, labels, lowest)
    component = F.coalesce("component_id", "doc_id")
    return rows.join(named, "k", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group, all columns: the one with the least doc_id (null last), then text digest.

    Of rows equal in doc_id and text one stays, whichever; rows without words all stay.
    """
    rows, classes, labels = link(docs, shingle)
    rooted = saved(classes.join(labels.select(F.col("node").alias("k"), "root"), "k", "left").select("k", "rep", F.coalesce("root", "k").alias("root")))
    first = saved(rooted.groupBy("root").agg(F.min("rep").alias("first")))
    of_class = saved(rooted.join(first, "root").select("k", "first"))
    judged = saved(rows.where("k is not null").join(of_class, "k").select("doc_id", "t", (F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "t") == F.col("first")).alias("stays")))
    drop(rows, classes, labels, rooted, first, of_class)
    gone = saved(judged.where("not stays").select(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).distinct())
    again = saved(judged.where("stays").groupBy(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).count().where("count > 1").select("_id", "_t"))
    drop(judged)
    packed = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("_digest"))
    same = lambda keys: packed["_doc_id"].eqNullSafe(keys["_id"]) & (packed["_digest"] == keys["_t"])
    once = packed.join(gone, same(gone), "left_anti")
    if not again.isEmpty():
        once = once.join(again, same(again), "left_anti").unionByName(packed.join(again, same(again), "left_semi").dropDuplicates(["_doc_id", "_digest"]))
    return once.select("_doc.*")


def op10_neardup(spark, sf_dir: str) -> DataFrame:
    return group(spark.read.parquet(f"{sf_dir}/documents.parquet"), QUERY_SHINGLE)


ORACLE = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m AS component_id, d.doc_id = m AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) q ON q.a = d.doc_id"""
