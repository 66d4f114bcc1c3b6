"""Toxicity: a convolutional text classifier in numpy, trained here and run inside Spark tasks.

Words (runs of ASCII letters, digits and non-ASCII bytes, A-Z folded) are hashed into BUCKETS embedding
rows, and so are their first PREFIX bytes, which lets inflected forms share what is learnt; a word's
vector is the sum of both. Filters over 1, 2 and 3 words are max-pooled over the whole text and feed a logistic output.
Embeddings start at zero, so words that training has not seen are neutral. Gradients reach only the
pooled positions, so training costs little more than its forward pass.

Training rows: at most SAMPLE_ROWS labelled rows (the documented bound), taken in hash order of doc_id,
never from the held-out quarter (crc32(doc_id as text) mod 4 is 2). Those with remainder 3 are not
fitted but calibrate: they scale the score to a probability (Platt) and set a threshold for each
language (best F1; languages with few positive rows share the one of all). Labels, lang, source and
doc_id are no inputs of the score.

Edge cases: null and empty texts get the score of an empty text; labels that are null or disagree about
a doc_id are not used; without usable labels every score is 0.5; a null doc_id counts as not held out;
repeated rows score alike; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import id_type
from .wordhash import PUNCTUATION, batches, fold_bytes, mix, words

SAMPLE_ROWS = 8_000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 8, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, DECAY = 8, 32, 0.1, 1e-5
PREFIX = 4
THRESHOLD = 0.3
MIN_POSITIVE = 20


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the two embedding rows of every word, first word of each text)."""
    start, end, hashes, first = words(data, offsets, fold=True, space=PUNCTUATION)
    head = np.zeros(len(start), np.uint64)
    for j in range(PREFIX):
        at = np.minimum(start + j, end - 1)
        head = (head << np.uint64(8)) | np.where(start + j < end, fold_bytes(data[at]), 0).astype(np.uint64)
    return (np.stack([hashes, mix(head, 71)], axis=1) % np.uint64(BUCKETS)).astype(np.int32), first


@dataclass
class Model:
    emb: np.ndarray
    conv: list[np.ndarray]  # width x DIM x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict = field(default_factory=dict)

    def pooled(self, ids: np.ndarray, first: np.ndarray, at: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Max-pooled filter values of every text and, if asked, the positions they come from (-1: none)."""
        texts, n = len(first) - 1, len(ids)
        filled = np.flatnonzero(np.diff(first))
        values, places = np.zeros((texts, len(WIDTHS) * FILTERS), np.float32), None
        if at:
            places = np.full(values.shape, -1, np.int64)
        if not len(filled):
            return values, places
        left = np.repeat(first[1:][filled], np.diff(first)[filled]) - np.arange(n)
        for k, width in enumerate(WIDTHS):
            total = np.repeat(self.bias[k][None], n, axis=0)
            for j in range(width):
                if at:
                    total[: n - j] += (self.emb[ids[j:, 0]] + self.emb[ids[j:, 1]]) @ self.conv[k][j]
                else:
                    table = self.emb @ self.conv[k][j]
                    total[: n - j] += table[ids[j:, 0]] + table[ids[j:, 1]]
            total[left < width] = 0
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            best = np.maximum.reduceat(total, first[:-1][filled], axis=0)
            values[filled, cols] = np.maximum(best, 0)
            if at:
                for row, text in enumerate(filled):
                    part = total[first[text] : first[text + 1]]
                    places[text, cols] = np.where(best[row] > 0, part.argmax(axis=0) + first[text], -1)
        return values, places

    def logit(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.pooled(ids, first)[0] @ self.out + self.shift

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logit(ids, first).astype(np.float64) + b, -30, 30)))


def new_model(seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    size = len(WIDTHS) * FILTERS
    conv = [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    return Model(np.zeros((BUCKETS, DIM), np.float32), conv, [np.full(FILTERS, 0.05, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, size).astype(np.float32), -2.0)


def fit(texts: list[np.ndarray], label: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Minimise the logistic loss with Adagrad over batches of whole texts."""
    model, rng = new_model(seed), np.random.default_rng(seed)
    params = {"emb": model.emb, "out": model.out, **{f"c{k}": model.conv[k] for k in range(len(WIDTHS))}, **{f"b{k}": model.bias[k] for k in range(len(WIDTHS))}}
    past = {k: np.full(v.shape, 1e-3, np.float32) for k, v in params.items()}
    shift_past = 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            ids = np.concatenate([texts[i] for i in pick])
            first = np.concatenate(([0], np.cumsum([len(texts[i]) for i in pick])))
            values, places = model.pooled(ids, first, at=True)
            z = values @ model.out + model.shift
            err = (1 / (1 + np.exp(-z)) - label[pick]).astype(np.float32) / len(pick)
            grads = {"out": values.T @ err + DECAY * model.out}
            back = err[:, None] * model.out[None]
            touched, pushed = [], []
            for k, width in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                text, f = np.nonzero(places[:, cols] >= 0)
                place, g = places[:, cols][text, f], back[:, cols][text, f]
                gc, gb = np.zeros_like(model.conv[k]), np.zeros_like(model.bias[k])
                np.add.at(gb, f, g)
                for j in range(width):
                    word, stem = ids[place + j].T
                    np.add.at(gc[j].T, f, g[:, None] * (model.emb[word] + model.emb[stem]))
                    touched += [word, stem]
                    pushed += [g[:, None] * model.conv[k][j].T[f]] * 2
                grads[f"c{k}"], grads[f"b{k}"] = gc, gb
            if touched:
                word, inverse = np.unique(np.concatenate(touched), return_inverse=True)
                g = np.zeros((len(word), DIM), np.float32)
                np.add.at(g, inverse, np.concatenate(pushed))
                past["emb"][word] += g * g
                model.emb[word] -= RATE * g / np.sqrt(past["emb"][word])
            for k, g in grads.items():
                past[k] += g * g
                params[k] -= RATE * g / np.sqrt(past[k])
            shift_past += float(err.sum()) ** 2
            model.shift -= RATE * float(err.sum()) / shift_past**0.5
    return model


def platt(z: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit, by damped Newton steps; targets are smoothed."""
    pos, neg = label.sum(), len(label) - label.sum()
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        w -= np.clip(np.linalg.solve(hess, x.T @ (p - target)), -2, 2)
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def best_threshold(score: np.ndarray, label: np.ndarray) -> float:
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum(label[order])
    f1 = 2 * hit / (np.arange(1, len(order) + 1) + label.sum())
    return float(score[order[int(f1.argmax())]])


def _ids(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for lo, hi, data, offsets in batches(batch.column("text")):
            ids, first = buckets(data, offsets)
            keep = [batch.column(c).slice(lo, hi - lo) for c in ("toxic", "fold", "lang")]
            yield pa.RecordBatch.from_arrays([*keep, pa.ListArray.from_arrays(pa.array((2 * first).astype(np.int32)), pa.array(ids.reshape(-1)))], ["toxic", "fold", "lang", "ids"])


def fold_of(column: str = "doc_id"):
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """Model fitted on at most ``rows`` labelled rows outside the held-out fold; None without both labels."""
    agreed = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    agreed = agreed.select("doc_id", "toxic", fold_of().cast("int").alias("fold")).where("fold <> 2").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.join(F.broadcast(agreed), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), "fold", "lang")
    table = sample.mapInArrow(_ids, "toxic int, fold int, lang string, ids array<int>").toArrow()
    label = table["toxic"].to_numpy().astype(np.float64)
    fold, lang = table["fold"].to_numpy(), np.array(table["lang"].to_pylist(), object)
    lists = table["ids"].combine_chunks()
    first = np.asarray(lists.offsets)
    flat = np.asarray(lists.values)
    texts = [flat[first[i] : first[i + 1]].reshape(-1, 2) for i in range(len(label))]
    # Rows arrive in any order; a fixed one makes reruns agree.
    order = sorted(range(len(texts)), key=lambda i: (len(texts[i]), texts[i].tobytes(), label[i], str(lang[i])))
    texts, label, fold, lang = [texts[i] for i in order], label[order], fold[order], lang[order]
    own = np.flatnonzero(fold != 3)
    if len(set(label[own])) < 2:
        return None
    model = fit([texts[i] for i in own], label[own])
    held = np.flatnonzero(fold == 3)
    if len(held):
        ids, first = np.concatenate([texts[i] for i in held]), np.concatenate(([0], np.cumsum([len(texts[i]) for i in held])))
        model.scale = platt(model.logit(ids, first).astype(np.float64), label[held])
        score = model.score(ids, first)
        model.thresholds = {None: best_threshold(score, label[held]) if label[held].any() else 0.5}
        for name in {x for x in lang[held] if x is not None}:
            part = lang[held] == name
            if label[held][part].sum() >= MIN_POSITIVE:
                model.thresholds[name] = best_threshold(score[part], label[held][part])
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted and flagged (the language's own threshold) of every row."""
    limits = model.thresholds if model else {}

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for lo, hi, data, offsets in batches(batch.column("text")):
                found = model.score(*buckets(data, offsets)) if model else np.full(hi - lo, 0.5)
                limit = np.array([limits.get(x, limits.get(None, 0.5)) for x in batch.column("lang").slice(lo, hi - lo).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo), pa.array(found), pa.array(found >= limit)], ["doc_id", "held_out", "score", "flagged"])

    rows = docs.select("doc_id", F.coalesce(fold_of() == 2, F.lit(False)).alias("held_out"), "lang", "text")
    out = rows.mapInArrow(run, f"doc_id {id_type(docs)}, held_out boolean, score double, flagged boolean")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "flagged")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels))
