"""Quality by logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

Words and runs of punctuation are tokens. Beside its own hash a token has its shape (case,
digits or mark), and a token equal to the one before it is a mark of repetition, so that
n-grams of unseen words still carry evidence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallflow.llm import features as fx
from recallflow.llm.common import appended, bound_batches, chunks, held_out

BITS = 20
_CLASS = np.zeros(256, dtype=np.uint8)  # 0 white space or control, 1 word, 2 punctuation
_CLASS[33:127] = 2
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def sparse(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word n-gram features of each text: (offsets, features, values of length one)."""
    buf, at = fx.join(texts)
    kind = _CLASS[buf]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    start, end = edge[:-1], edge[1:]
    solid = kind[start] > 0
    start, end = start[solid], end[solid]
    doc = np.searchsorted(at, start, side="right") - 1
    word = fx.Ranges(_LOWER[buf])(start, end)
    capitals = np.concatenate([[0], np.cumsum(_UPPER[buf])])
    upper = capitals[end] - capitals[start]
    size = end - start
    shape = np.where(kind[start] == 2, 4, np.where(upper == 0, 1, np.where((upper == size) & (size > 1), 3, 2)))
    same = np.zeros(len(word), dtype=bool)
    if len(word) > 1:
        same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    shape = np.where(same, shape + 4, shape).astype(np.uint64)
    seed = np.array([1, 2, 3, 4], dtype=np.uint64)
    grams, owner = [word, fx.mix(shape + seed[0])], [doc, doc]
    if len(word) > 1:
        near = doc[1:] == doc[:-1]
        pair = fx.mix(word[:-1] * fx.BASE + word[1:] + seed[1])
        form = fx.mix(shape[:-1] * fx.BASE + shape[1:] + seed[2])
        grams += [pair[near], form[near]]
        owner += [doc[1:][near]] * 2
    feature = np.concatenate(grams) & np.uint64((1 << BITS) - 1)
    offsets, feature, count = fx.grouped(np.concatenate(owner), feature, len(texts))
    value = np.log1p(count.astype(np.float64))
    squares = np.concatenate([[0.0], np.cumsum(value * value)])
    norm = np.sqrt(squares[offsets[1:]] - squares[offsets[:-1]])
    return offsets, feature, value / np.repeat(np.maximum(norm, 1e-9), np.diff(offsets))


def _bytes(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in column.to_pylist()]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids, values = _bytes(batch.column("text")), [], []
        for a, b in chunks(texts):
            offsets, feature, value = sparse(texts[a:b])
            feature, value = feature.astype(np.int32), value.astype(np.float32)
            for i in range(b - a):
                ids.append(feature[offsets[i] : offsets[i + 1]].tobytes())
                values.append(value[offsets[i] : offsets[i + 1]].tobytes())
        yield pa.record_batch([batch.column("quality"), pa.array(ids, pa.binary()), pa.array(values, pa.binary())], ["quality", "ids", "values"])


class Leader:
    """Follow-the-regularised-leader with per-coordinate rates and an L1 threshold."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << BITS) + 1)  # the last place is the bias
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        grown = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / grown

    def learn(self, ids: np.ndarray, values: np.ndarray, label: int, weight: float) -> None:
        w = self.weights(ids)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ values, -35, 35)))
        g = (p - label) * values * weight
        n = self.n[ids]
        self.z[ids] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[ids] = n + g * g


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4) -> np.ndarray:
    """Weights, the bias last. Classes weigh the same in total; with one class or none
    there is nothing to learn and every text scores one half."""
    leader = Leader()
    good = sum(y for _, _, y in rows)
    if not 0 < good < len(rows):
        return leader.weights(slice(None))
    weight = {1: len(rows) / (2 * good), 0: len(rows) / (2 * (len(rows) - good))}
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            ids, values, label = rows[i]
            leader.learn(np.append(ids, 1 << BITS), np.append(values, 1.0), label, weight[label])
    return leader.weights(slice(None))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12000, epochs: int = 4) -> np.ndarray:
    """Fit on at most about ``max_rows`` labelled texts, drawn by a hash of doc_id outside
    the held-out fold. labels(doc_id, quality); of several labels the highest counts; null
    labels and ids are left out."""
    bound_batches(docs.sparkSession)
    marks = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
    )
    known = marks.count()
    if not known:
        return fit([])
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 12) / float(1 << 52)
    chosen = marks.where(draw < max_rows / known)
    texts = (
        # bounded by max_rows, so it is broadcast; one text per id
        docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
        .select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    )
    rows = texts.select("quality", "text").mapInArrow(_packed, "quality int, ids binary, values binary").toArrow()
    rows = [
        (np.frombuffer(i, dtype=np.int32).astype(np.int64), np.frombuffer(v, dtype=np.float32).astype(np.float64), 1 if q > 0 else 0)
        for q, i, v in zip(rows["quality"].to_pylist(), rows["ids"].to_pylist(), rows["values"].to_pylist(), strict=True)
    ]
    return fit(sorted(rows, key=lambda r: r[0].tobytes()), epochs)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with ``score``, the probability of good quality of the whole text.

    A null text counts as empty; an empty text has no feature and scores by the bias.
    """
    bound_batches(docs.sparkSession)
    bias, weights = float(weights[-1]), weights[:-1].astype(np.float32)

    def run(column: pa.Array) -> list[pa.Array]:
        texts, out = _bytes(column), []
        for a, b in chunks(texts):
            offsets, feature, value = sparse(texts[a:b])
            sums = np.concatenate([[0.0], np.cumsum(weights[feature] * value)])
            z = sums[offsets[1:]] - sums[offsets[:-1]] + bias
            out.append(1.0 / (1.0 + np.exp(-np.clip(z, -35, 35))))
        return [pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())]

    return appended(docs, "text", run, [("score", "double")])


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **limits) -> DataFrame:
    """``docs`` with held_out, score and predicted (1 if score >= ``threshold``)."""
    scored = score(docs, train(docs, labels, **limits))
    return scored.withColumns({
        "held_out": held_out(F.col("doc_id")),
        "predicted": (F.col("score") >= threshold).cast("int"),
    })
