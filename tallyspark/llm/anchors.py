"""Content-selected positions (minimisers) of texts and the texts' repeated ones.

A text's windows of ``window`` words each select the smallest k-mer hash inside them; equal windows
select the same k-mer at the same place, wherever they stand, so every repetition of at least
``window`` words holds a repeated anchor. Only 2 / (window - k + 2) of all positions are anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import batches, grams, mix, words, Rolling

_CONTEXT = Rolling(0xA24BAED4963EE407)


def anchor_rows(hashes: np.ndarray, first: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor position, first window, number of windows) of every anchor; positions are global word numbers."""
    n = len(hashes)
    empty = np.zeros(0, np.int64)
    if n < window:
        return empty, empty, empty, empty
    value, place = grams(hashes, k)[: n - k + 1], np.arange(n - k + 1)
    span, width = window - k + 1, 1
    while width < span:
        step = min(width, span - width)
        later = value[step:] < value[: len(value) - step]
        value, place = np.where(later, value[step:], value[: len(value) - step]), np.where(later, place[step:], place[: len(place) - step])
        width += step
    at = np.arange(len(place))
    text = np.searchsorted(first, at, "right") - 1
    inside = at + window <= first[text + 1]
    at, place, text = at[inside], place[inside], text[inside]
    if not len(at):
        return empty, empty, empty, empty
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    return text[begin], place[begin], at[begin], np.diff(np.append(begin, len(at)))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def anchored(window: int, k: int, phrases: bool):
    """mapInArrow function over (doc_id, th, text): one row per anchor.

    ``phrase`` hashes all words of the windows that selected the anchor, and where it lies in them.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for lo, hi, data, offsets in batches(batch.column("text")):
                _, _, hashes, first = words(data, offsets)
                text, place, at, count = anchor_rows(hashes, first, window, k)
                kmer = grams(hashes, k)[place]
                row, base = pa.array(text + lo), first[text]
                out = [batch.column("doc_id").take(row), batch.column("th").take(row), signed(kmer), pa.array((place - base).astype(np.int32)), pa.array((at - base).astype(np.int32)), pa.array(count.astype(np.int32))]
                names = ["doc_id", "th", "anchor", "place", "at", "n"]
                if phrases:
                    whole = _CONTEXT.ranges(_CONTEXT.prefix(hashes), at, at + count + window - 1)
                    out.append(signed(mix(whole ^ mix((place - at).astype(np.uint64), 5) ^ mix(count.astype(np.uint64), 6), 51)))
                    names.append("phrase")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, th and text: th, the text's 128-bit digest, tells apart texts that share a doc_id, null ones included."""
    return docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("th"), "text")


def same_row(left: DataFrame, right: DataFrame):
    """Join condition of two (doc_id, th) keyed frames; ``right`` has them as _id and _th."""
    return left["doc_id"].eqNullSafe(right["_id"]) & (left["th"] == right["_th"])


def id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()
