"""Vectorised helpers against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import neardup, wordhash
from tallyspark.llm.anchors import anchor_rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab É\n\t\x0b\x1fz", max_size=30), max_size=8))
def test_words_are_cut_as_the_pattern_says(texts):
    for lo, hi, data, offsets in wordhash.batches(pa.array(texts, pa.string())):
        start, end, hashes, first = wordhash.words(data, offsets)
        for i in range(lo, hi):
            found = re.findall(r"[^\x20\x09-\x0D]+", texts[i])
            a, b = first[i - lo], first[i - lo + 1]
            assert [bytes(data[s:e]).decode() for s, e in zip(start[a:b], end[a:b], strict=True)] == found
            assert len(set(hashes[a:b].tolist())) == len(set(found))


def test_hashes_do_not_depend_on_place_or_batch(monkeypatch):
    texts = ["aa bb cc", "bb", None, "x " * 50 + "bb"]
    whole = [h for _, _, d, o in wordhash.batches(pa.array(texts)) for h in wordhash.words(d, o)[2].tolist()]
    monkeypatch.setattr(wordhash, "BATCH_BYTES", 7)
    parts = [h for _, _, d, o in wordhash.batches(pa.array(texts)) for h in wordhash.words(d, o)[2].tolist()]
    assert whole == parts and whole[1] == whole[3] == whole[-1]


def _plain_super_minhash(value, m):
    """Element by element, with an explicit permutation."""
    out = [2**64 - 1] * m
    for x in value:
        p = list(range(m))
        for j in range(m):
            bits = int(wordhash.mix(np.array([x], np.uint64), 100 + j)[0])
            k = j + ((bits >> 32) * (m - j) >> 32)
            p[j], p[k] = p[k], p[j]
            out[p[j]] = min(out[p[j]], j << 32 | bits & 0xFFFFFFFF)
    return out


def test_super_minhash_is_the_plain_algorithm():
    rng = np.random.default_rng(1)
    sizes = [1, 2, 5, 17, 60, 300, 0]
    value = rng.integers(0, 2**63, sum(sizes)).astype(np.uint64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    got = neardup.super_minhash(value, first, 24)
    for i, n in enumerate(sizes):
        assert got[i].tolist() == _plain_super_minhash(value[first[i] : first[i] + n], 24)


def test_every_window_holds_its_anchor():
    rng = np.random.default_rng(2)
    hashes, first = rng.integers(0, 40, 500).astype(np.uint64), np.array([0, 180, 190, 500])
    text, place, at, count = anchor_rows(hashes, first, 20, 6)
    covered = sorted(x for a, n in zip(at, count, strict=True) for x in range(a, a + n))
    assert covered == [*range(0, 161), *range(190, 481)]
    assert all(a + n - 1 <= p <= a + 14 for p, a, n in zip(place, at, count, strict=True))
    assert set(text) == {0, 2}
