"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words, word beginnings and word ends is trained from
confirmed toxic texts and texts of unknown kind. The unlabelled risk counts every text as
clean, minus the share the class prior says is toxic; where that difference would turn
negative the step reverses its gradient instead (non-negative correction).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallflow.llm import features as fx
from recallflow.llm.common import appended, bound_batches, chunks, held_out

BITS = 20
AFFIXES = (4, 5, 6, 8)
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def sparse(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each lower-cased text: (offsets, features)."""
    buf, at = fx.join(texts)
    start, end = fx.runs(_WORD[buf])
    doc = np.searchsorted(at, start, side="right") - 1
    ranges, size = fx.Ranges(buf), end - start
    found, owner = [ranges(start, end)], [doc]
    for n in AFFIXES:
        long = size > n
        s, e, d = start[long], end[long], doc[long]
        found += [ranges(s, s + n, 2 * n), ranges(e - n, e, 2 * n + 1)]
        owner += [d, d]
    feature = np.concatenate(found) & np.uint64((1 << BITS) - 1)
    offsets, feature, _ = fx.grouped(np.concatenate(owner), feature, len(texts))
    return offsets, feature


def _lowered(column: pa.ChunkedArray) -> list[bytes]:
    return [(t or "").lower().encode("utf-8", "replace") for t in column.to_pylist()]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the sampled texts as packed 32-bit numbers."""
    seen: set[int] = set()  # repeated rows of a partition, bounded by the sample
    for batch in batches:
        same = batch.column("same").to_pylist()
        new = [k for k, s in enumerate(same) if s not in seen and not seen.add(s)]
        batch = batch.take(pa.array(new, pa.int64()))
        texts, out = _lowered(batch.column("text")), []
        for a, b in chunks(texts):
            offsets, feature = sparse(texts[a:b])
            feature = feature.astype(np.int32)
            out += [feature[offsets[i] : offsets[i + 1]].tobytes() for i in range(b - a)]
        names = ["same", "positive", "unlabelled"]
        yield pa.record_batch([*[batch.column(n) for n in names], pa.array(out, pa.binary())], [*names, "features"])


class Sparse:
    """Rows of feature numbers, with sums along rows and along columns."""

    def __init__(self, rows: list[np.ndarray]):
        self.ids = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.row = np.repeat(np.arange(len(rows)), np.diff(self.at))
        self.n = len(rows)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.ids], minlength=self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.ids, weights=g[self.row], minlength=size)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def evidence(in_p: np.ndarray, n_p: int, in_u: np.ndarray, n_u: int) -> np.ndarray:
    """Likelihood-ratio statistic of "equally frequent among both" per feature, negative
    where it is rarer among the positives. It holds for rare features too."""
    total = in_p + in_u
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.zeros(len(total))
        for seen, n in ((in_p, n_p), (in_u, n_u)):
            for count, whole in ((seen, total), (n - seen, n_p + n_u - total)):
                g += np.where(count > 0, count * np.log(count * (n_p + n_u) / (n * whole)), 0.0)
    return np.where(in_p * n_u >= in_u * n_p, 2 * g, -2 * g)


def estimated_prior(in_p: np.ndarray, n_p: int, in_u: np.ndarray, n_u: int) -> float:
    """Toxic share of the unlabelled texts, from positives and unlabelled texts alone.

    A feature that a share p of the toxic texts holds is in at least prior * p of the
    unlabelled ones, so the least ratio over frequent features, two standard errors
    up, bounds the prior from above; it is reached by features of toxic texts only."""
    often = in_p >= max(5, 0.1 * n_p)
    if not often.any():
        return 0.1
    u = in_u[often] / n_u
    upper = u + 2 * np.sqrt(u * (1 - u) / n_u) + 1 / n_u
    return float(np.min(upper / (in_p[often] / n_p)))


def fit(
    positives: list[np.ndarray],
    unlabelled: list[np.ndarray],
    prior: float | None = None,
    steps: int = 600,
    rate: float = 0.05,
    sparsity: float = 2e-5,
    screen: float = 24.0,
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk of the logistic loss.

    ``prior`` is the toxic share of the unlabelled texts, estimated if not given. Features
    get a weight if they are more frequent among the positives by ``evidence`` of at least
    ``screen``: at 24 about one of a million features without a difference passes, and one
    in 5 of 33 positives and no other text does. ``sparsity`` is an L1 penalty. Without
    positives or unlabelled texts nothing is learnt and every score is the prior.
    """
    size = 1 << BITS
    if not positives or not unlabelled:
        prior = min(max(0.1 if prior is None else prior, 1e-4), 0.9)
        return np.zeros(size), math.log(prior / (1 - prior))
    in_p = np.bincount(np.concatenate(positives), minlength=size)
    in_u = np.bincount(np.concatenate(unlabelled), minlength=size)
    n_p, n_u = len(positives), len(unlabelled)
    prior = min(max(estimated_prior(in_p, n_p, in_u, n_u) if prior is None else prior, 1e-4), 0.9)
    bias = math.log(prior / (1 - prior))
    weights = np.zeros(size)
    used = np.flatnonzero(evidence(in_p, n_p, in_u, n_u) >= screen)
    place = np.full(size, -1, dtype=np.int64)
    place[used] = np.arange(len(used))
    p, u = (Sparse([k[k >= 0] for k in (place[r] for r in rows)]) for rows in (positives, unlabelled))
    k = len(used)
    w, m, v = np.zeros(k), np.zeros(k), np.zeros(k)
    bm = bv = 0.0
    for step in range(1, steps + 1):
        zp, zu = p.dot(w) + bias, u.dot(w) + bias
        sp, su = _sigmoid(zp), _sigmoid(zu)
        # loss of "clean" is log(1 + e^z), of "toxic" log(1 + e^-z)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp_toxic, gp_clean, gu_clean = -(1 - sp) / p.n, sp / p.n, su / u.n
        if negative >= 0:
            dp, du = prior * (gp_toxic - gp_clean), gu_clean
        else:
            dp, du = prior * gp_clean, -gu_clean
        g = p.back(dp, k) + u.back(du, k)
        gb = dp.sum() + du.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        bm, bv = 0.9 * bm + 0.1 * gb, 0.999 * bv + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        scale = rate / (np.sqrt(v / c2) + 1e-6)
        w -= scale * m / c1
        bias -= rate * (bm / c1) / (math.sqrt(bv / c2) + 1e-6)
        w = np.sign(w) * np.maximum(np.abs(w) - scale * sparsity, 0)
    weights[used] = w
    return weights, float(bias)


def _draw(*keys: Column | str) -> Column:
    """A number below 1 from 52 bits of a hash: a rate keeps a sample of known size."""
    return F.shiftrightunsigned(F.xxhash64(*keys, F.lit("sample")), 12) / float(1 << 52)


def train(
    docs: DataFrame,
    labels: DataFrame,
    prior: float | None = None,
    max_positives: int = 3000,
    max_unlabelled: int = 10000,
) -> tuple[np.ndarray, float]:
    """Fit on a bounded sample: at most about ``max_positives`` confirmed toxic texts and
    ``max_unlabelled`` texts of unknown kind, both drawn by a hash of doc_id and text outside
    the held-out fold. One task fits; only the weights reach the driver.

    labels(doc_id, toxic); a document with several labels is toxic if one says so; null
    labels and ids are left out. Repeated rows (one id, one text) count once; an id with
    several texts gives them all. ``prior`` defaults to the toxic share of those labels, or,
    where they confirm toxic texts only, to an estimate from the texts.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    marks = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    toxic, known = marks.agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.count(F.lit(1))).first()
    total = docs.count()
    if not toxic or not total:
        return fit([], [], prior or 0.1)
    if prior is None and known > toxic:
        prior = toxic / known
    # bounded by max_positives, so it is broadcast; an id may still have any number of rows
    chosen = F.broadcast(marks.where("toxic = 1").where(_draw("doc_id") < max_positives / toxic).select("doc_id", F.lit(True).alias("positive")))
    rows = docs.join(chosen, "doc_id").count()
    row = _draw("doc_id", F.xxhash64("text"))
    texts = (
        docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id", "left")
        .select(
            "doc_id", "text", (F.coalesce("positive", F.lit(False)) & (row < max_positives / max(rows, 1))).alias("positive"),
            ((row < max_unlabelled / total) & ~held_out(F.col("doc_id"))).alias("unlabelled"),
        )
        .where("positive OR unlabelled").select(F.xxhash64("doc_id", "text").alias("same"), "text", "positive", "unlabelled")
    )

    def learn(table: pa.Table) -> pa.Table:
        _, first = np.unique(table.column("same").to_numpy(), return_index=True)  # in the order of a hash
        table = table.take(pa.array(first))
        found = [np.frombuffer(f, dtype=np.int32) for f in table.column("features").to_pylist()]
        p, u = ([f for f, k in zip(found, table.column(c).to_pylist(), strict=True) if k] for c in ("positive", "unlabelled"))
        weights, bias = fit(p, u, prior)
        used = np.flatnonzero(weights)
        return pa.table({"at": pa.array([used]), "weight": pa.array([weights[used]]), "bias": pa.array([bias])})

    features = texts.mapInArrow(_packed, "same bigint, positive boolean, unlabelled boolean, features binary")
    # One group: the sample is bounded whatever the input.
    model = features.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(learn, "at array<bigint>, weight array<double>, bias double").toArrow().to_pydict()
    if not model["bias"]:
        return fit([], [], prior)
    weights = np.zeros(1 << BITS)
    weights[model["at"][0]] = model["weight"][0]
    return weights, model["bias"][0]


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` with ``score``, the probability that the whole text is toxic.

    A null text counts as empty; an empty text has no feature and scores by the bias.
    """
    bound_batches(docs.sparkSession)
    weights, bias = model[0].astype(np.float32), model[1]

    def run(column: pa.Array) -> list[pa.Array]:
        texts, out = _lowered(column), []
        for a, b in chunks(texts):
            offsets, feature = sparse(texts[a:b])
            sums = np.concatenate([[0.0], np.cumsum(weights[feature], dtype=np.float64)])
            out.append(_sigmoid(sums[offsets[1:]] - sums[offsets[:-1]] + bias))
        return [pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())]

    return appended(docs, "text", run, [("score", "double")])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **limits) -> DataFrame:
    """``docs`` with held_out, score and predicted (1 if score >= ``threshold``)."""
    scored = score(docs, train(docs, labels, **limits))
    return scored.withColumns({
        "held_out": held_out(F.col("doc_id")),
        "predicted": (F.col("score") >= threshold).cast("int"),
    })
