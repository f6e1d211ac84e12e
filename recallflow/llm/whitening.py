"""Embedding whitening from the exact characteristic polynomial.

The vectors are integers, so n times their scatter is an integer matrix, summed exactly.
Its characteristic polynomial comes from Hessenberg reductions modulo many primes, dealt
over tasks, and the Chinese remainder theorem. All its roots are real and not negative:
the sign changes of the polynomial shifted to a place count the roots above it, with their
multiplicity, so bisection isolates and refines them as far as wanted. The components are
null vectors of (matrix - root), by inverse iteration in 256-bit fixed point, a task each.
Only d x d numbers, d the number of dimensions, ever reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallflow.llm.common import bound_batches, unused, without, written

SCALE, SHIFT = 64, 1_000_000
LIMB = 40  # bits; exact sums travel as three numbers of this size
BITS = 256  # of the fixed point
COLUMNS = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


@dataclass
class Whitening:
    """Fitted components: ``axes[:, k]`` has length 1 and variance ``values[k]``."""

    n: int
    sums: list[int]  # of the integers less SHIFT
    values: np.ndarray
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0


def offsets(vec: Column) -> Column:
    """floor(SCALE * c) of each entry c as double; SHIFT less than the contract's integers.
    Null where the vector is null or has an entry that is null or not finite. Entries
    beyond the range of a long stand for its ends."""
    c = vec.cast("array<double>")
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    limit = float(1 << 62)
    # ``bad`` is null for no vector: the array functions see a null entry before it.
    return F.when(c.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(c, lambda v: F.floor(F.greatest(F.least(v * SCALE, F.lit(limit)), F.lit(-limit)))))


def usable(df: DataFrame, vec: str, name: str) -> tuple[DataFrame, int]:
    """Rows with their integers as column ``name``, and the number of dimensions: that of
    the longest vector. A shorter one lacks entries and goes like one with nulls."""
    rows = df.withColumn(name, offsets(F.col(f"`{vec}`"))).where(F.col(name).isNotNull())
    d = rows.agg(F.max(F.size(name))).first()[0] or 0
    return rows.where(F.size(name) == d), d


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _limbs(values: np.ndarray) -> list[pa.Array]:
    """Exact integers (objects) as three columns of longs."""
    mask = (1 << LIMB) - 1
    cut = ([int(v) >> 2 * LIMB for v in values], [int(v) >> LIMB & mask for v in values], [int(v) & mask for v in values])
    return [pa.array(c, pa.int64()) for c in cut]


def _products(y: np.ndarray) -> np.ndarray:
    """y'y, exact, as objects."""
    top = max(int(y.max()), -int(y.min())) if y.size else 0
    if top * top * len(y) < 1 << 53:
        f = y.astype(np.float64)  # every partial sum is a whole number below 2^53
        return (f.T @ f).astype(np.int64).astype(object)
    o = y.astype(object)
    return o.T.dot(o)


def scatter(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, n * sum of products - sums' products) of the distinct vectors ``y``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((d + 1, d + 1), dtype=object)
        for batch in batches:
            y = _matrix(batch.column(0), d)
            both[0, 0] += len(y)
            both[0, 1:] += y.astype(object).sum(axis=0) if len(y) else 0
            both[1:, 1:] += _products(y)
        i, j = np.triu_indices(d + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i * (d + 1) + j), *_limbs(both[i, j])], names=["place", "a", "b", "c"])

    parts = fit.select("y").mapInArrow(run, "place bigint, a bigint, b bigint, c bigint")
    found = parts.groupBy("place").agg(*[F.sum(k).alias(k) for k in "abc"]).toArrow().to_pydict()
    both = np.zeros((d + 1, d + 1), dtype=object)
    for place, a, b, c in zip(found["place"], found["a"], found["b"], found["c"], strict=True):
        i, j = divmod(place, d + 1)
        both[i, j] = both[j, i] = (a << 2 * LIMB) + (b << LIMB) + c
    n, sums = both[0, 0], [int(v) for v in both[0, 1:]]
    return n, sums, n * both[1:, 1:] - np.outer(np.array(sums, dtype=object), np.array(sums, dtype=object))


def primes(count: int) -> list[int]:
    """The largest primes below 2^31, by a sieve over windows."""
    root = 46341
    small = np.ones(root + 1, dtype=bool)
    small[:2] = False
    for k in range(2, math.isqrt(root) + 1):
        if small[k]:
            small[k * k :: k] = False
    out, top = [], 1 << 31
    while len(out) < count:
        low = top - (1 << 16)
        held = np.ones(top - low, dtype=bool)
        for p in np.flatnonzero(small):
            held[-low % p :: p] = False
        out.extend((low + np.flatnonzero(held)[::-1]).tolist())
        top = low
    return out[:count]


def _power(x: np.ndarray, e: np.ndarray, p: np.ndarray) -> np.ndarray:
    out, x, e = np.ones_like(x), x.copy(), e.copy()
    while e.any():
        out = np.where(e & 1, out * x % p, out)
        x, e = x * x % p, e >> 1
    return out


def polynomials(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Coefficients, highest first, of det(x - a[k]) modulo p[k], all k at once."""
    m, d, _ = a.shape
    a, q, every = a.copy(), p[:, None, None], np.arange(m)
    for k in range(d - 2):
        r = k + 1 + (a[:, k + 1 :, k] != 0).argmax(axis=1)
        a[every, r], a[:, k + 1] = a[:, k + 1].copy(), a[every, r]
        a[every, :, r], a[:, :, k + 1] = a[:, :, k + 1].copy(), a[every, :, r]
        u = a[:, k + 2 :, k] * _power(a[:, k + 1, k], p - 2, p)[:, None] % p[:, None]
        a[:, k + 2 :, k:] = (a[:, k + 2 :, k:] - u[:, :, None] * a[:, None, k + 1, k:]) % q
        a[:, :, k + 1] = (a[:, :, k + 1] + (a[:, :, k + 2 :] * u[:, None, :] % q).sum(axis=2)) % p[:, None]
    # poly[:, k] is that of the leading k x k block, lowest coefficient first
    poly = np.zeros((m, d + 1, d + 1), dtype=np.int64)
    poly[:, 0, 0] = 1
    below = np.zeros((m, 0), dtype=np.int64)  # products of the subdiagonal from i + 1 to k
    for k in range(1, d + 1):
        new = np.zeros((m, d + 1), dtype=np.int64)
        new[:, 1:] = poly[:, k - 1, :-1]
        new -= a[:, k - 1, k - 1, None] * poly[:, k - 1] % p[:, None]
        if k > 1:
            sub = a[:, k - 1, k - 2, None]
            below = np.concatenate([below * sub % p[:, None], sub], axis=1)
            w = a[:, : k - 1, k - 1] * below % p[:, None]
            new -= (w[:, :, None] * poly[:, : k - 1, :] % q).sum(axis=1)
        poly[:, k] = new % p[:, None]
    return poly[:, d, ::-1]


def characteristic(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Coefficients, highest first, of the polynomial of a positive semidefinite integer
    matrix. The k-th is at most C(d, k) (trace / d)^k, which tells how many primes do."""
    d, trace = len(matrix), int(matrix.trace())
    bound = max(math.comb(d, k) * -(-(trace**k) // d**k) for k in range(d + 1))
    moduli = primes(bound.bit_length() // 30 + 2)
    rows = [[int(v) for v in r] for r in matrix]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(0).to_numpy()
            for k in range(0, len(p), 32):
                own = p[k : k + 32]
                a = np.array([[[v % int(q) for v in r] for r in rows] for q in own], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(list(polynomials(a, own)), pa.list_(pa.int64()))], names=["p", "r"])

    dealt = spark.createDataFrame([(p,) for p in moduli], "p bigint").repartition(-(-len(moduli) // 16), "p")
    found = dealt.mapInArrow(run, "p bigint, r array<bigint>").toArrow().to_pydict()
    whole = math.prod(found["p"])
    out = [0] * (d + 1)
    for p, r in zip(found["p"], found["r"], strict=True):
        one = whole // p * pow(whole // p, -1, p)
        out = [c + one * v for c, v in zip(out, r, strict=True)]
    return [c - whole if (c := v % whole) > whole // 2 else c for v in out]


class Roots:
    """Real roots of an integer polynomial that has no others, none of them negative.
    Places are (a, s), that is a / 2^s."""

    def __init__(self, poly: list[int]):
        self.poly = poly
        while len(self.poly) > 1 and self.poly[-1] == 0:  # roots at zero
            self.poly = self.poly[:-1]
        self.d = len(self.poly) - 1

    def above(self, a: int, s: int) -> int:
        """How many roots, with multiplicity, are greater: the sign changes of the
        polynomial moved to the place."""
        if a <= 0:
            return self.d
        # scaled so that the move is one by 1
        c = [(v << s * k) * a ** (self.d - k) for k, v in enumerate(self.poly)]
        for stop in range(self.d, 0, -1):
            for k in range(1, stop + 1):
                c[k] += c[k - 1]
        signs = [v > 0 for v in c if v]
        return sum(x != y for x, y in zip(signs, signs[1:], strict=False))

    def sign(self, a: int, s: int) -> int:
        v = 0
        for k, c in enumerate(self.poly):
            v = v * a + (c << s * k)
        return (v > 0) - (v < 0)

    def largest(self, count: int, bits: int = 110) -> list[tuple[Fraction, int]]:
        """The ``count`` largest positive roots as (root, multiplicity), falling; the last
        one may exceed the count. Roots closer than 2^-bits of their size are one."""
        top = sum(abs(c) for c in self.poly[1:2]) + 1  # their sum, and more
        stack, out, have = [(0, 1 << top.bit_length(), 0, self.d, 0)], [], 0
        while stack and have < min(count, self.d):
            lo, hi, s, many, over = stack.pop()
            narrow = lo > 0 and (hi - lo) << bits <= lo
            if many == 1 or narrow:
                out.append((self._refined(lo, hi, s, bits) if many == 1 else Fraction(lo + hi, 2 << s), many))
                have += many
                continue
            lo, mid, hi, s = 2 * lo, lo + hi, 2 * hi, s + 1
            high = self.above(mid, s) - over
            if many - high:
                stack.append((lo, mid, s, many - high, over + high))
            if high:
                stack.append((mid, hi, s, high, over))
        return out

    def _refined(self, lo: int, hi: int, s: int, bits: int) -> Fraction:
        """The one root in (lo, hi]."""
        end = self.sign(hi, s)
        if end == 0:
            return Fraction(hi, 1 << s)
        while lo == 0 or (hi - lo) << bits > lo:
            lo, mid, hi, s = 2 * lo, lo + hi, 2 * hi, s + 1
            at = self.sign(mid, s)
            if at == 0:
                return Fraction(mid, 1 << s)
            lo, hi = (lo, mid) if at == end else (mid, hi)
        return Fraction(lo + hi, 2 << s)


def null_vectors(matrix: list[list[int]], root: Fraction, many: int, rounds: int = 3) -> np.ndarray:
    """``many`` orthogonal unit vectors of the null space of (matrix - root), the largest
    entry of each positive: one elimination, then inverse iteration, in fixed point."""
    d, one = len(matrix), 1 << BITS
    size = 1 << sum(int(matrix[k][k]) for k in range(d)).bit_length()
    a = np.array([[(int(v) << BITS) // size for v in r] for r in matrix], dtype=object).reshape(d, d)
    shift = (root.numerator << BITS) // (root.denominator * size)
    for k in range(d):
        a[k, k] -= shift
    order = list(range(d))
    for k in range(d):
        r = k + int(np.abs(a[k:, k]).argmax())
        a[[k, r]] = a[[r, k]]
        order[k], order[r] = order[r], order[k]
        if a[k, k] == 0:
            a[k, k] = 1
        a[k + 1 :, k] = (a[k + 1 :, k] << BITS) // a[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :]) >> BITS
    start = np.random.default_rng(11).integers(1, 1 << 20, size=(many, d))
    basis = [np.array([int(v) << BITS - 20 for v in row], dtype=object) for row in start]
    for _ in range(rounds):
        done: list[np.ndarray] = []
        for b in basis:
            x = b[order]
            for k in range(d):
                x[k + 1 :] -= a[k + 1 :, k] * x[k] >> BITS
            for k in range(d - 1, -1, -1):
                x[k] = (x[k] << BITS) // a[k, k]
                x[:k] -= a[:k, k] * x[k] >> BITS
            for _ in range(2):
                x = _unit(x, one)
                for e in done:
                    x = x - (e * (int((e * x).sum()) >> BITS) >> BITS)
            done.append(_unit(x, one))
        basis = done
    out = []
    for v in basis:
        top = int(np.abs(v).argmax())
        out.append([float(Fraction(int(c) if v[top] > 0 else -int(c), one)) for c in v])
    return np.array(out).reshape(many, d)


def _unit(x: np.ndarray, one: int) -> np.ndarray:
    top = int(np.abs(x).max()) or 1
    x = np.array([(int(c) * one) // top for c in x], dtype=object)
    norm = math.isqrt(int((x * x).sum()))
    return np.array([(int(c) * one) // norm for c in x], dtype=object)


def components(spark: SparkSession, matrix: np.ndarray, roots: list[tuple[Fraction, int]]) -> list[np.ndarray]:
    """Unit vectors for all roots, one task a root."""
    rows = [[int(v) for v in r] for r in matrix]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                vectors = null_vectors(rows, *roots[k])
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(vectors)), pa.array(list(vectors), pa.list_(pa.float64()))], names=["k", "v"])

    dealt = spark.range(0, len(roots), 1, numPartitions=len(roots))
    found = dealt.mapInArrow(run, "k bigint, v array<double>").toArrow().to_pydict()
    return [np.array(v) for _, v in sorted(zip(found["k"], found["v"], strict=True), key=lambda r: r[0])]


def fit(fit_list: DataFrame, d: int, most: int = 16) -> Whitening | None:
    """Components of the distinct vectors ``y`` with the ``most`` largest variances, those
    of variance zero left out; None where none is left."""
    spark = fit_list.sparkSession
    n, sums, matrix = scatter(fit_list, d)
    trace = int(matrix.trace()) if d else 0
    if trace == 0:
        return None
    shared = math.gcd(*[int(v) for v in matrix.ravel()])
    small = matrix // shared
    roots = Roots(characteristic(spark, small)).largest(most)
    axes = np.array(components(spark, small, roots))[:most].T
    exact = [r * shared for r, many in roots for _ in range(many)][:most]
    values = np.array([float(r / n**2) for r in exact])
    found = Whitening(n, sums, values, axes, np.array([float(r / trace) for r in exact]))
    found.identity_error = _identity_error(fit_list, d, found)
    return found


def _white(y: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """n * y - sums, exact, and the whitened vectors."""
    top = max([1, *[abs(s) for s in model.sums], model.n * (max(int(y.max()), -int(y.min())) if y.size else 0)])
    kind = np.int64 if top < 1 << 61 else object
    off = model.n * y.astype(kind) - np.array(model.sums, dtype=kind)
    return off, (off / model.n).astype(np.float64) @ model.axes / np.sqrt(model.values)


def _identity_error(fit_list: DataFrame, d: int, model: Whitening) -> float:
    """Largest entry of |covariance of the whitened vectors - identity|, measured."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = _white(_matrix(batch.column(0), d), model)[1]
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["place", "v"])

    parts = fit_list.select("y").mapInArrow(run, "place bigint, v double").groupBy("place").agg(F.sum("v").alias("v"))
    found = parts.toArrow().sort_by("place")["v"].to_numpy().reshape(k, k)
    return float(np.abs(found / model.n - np.eye(k)).max())


def whitened(df: DataFrame, vec: str = "embedding", most: int = 16) -> DataFrame:
    """Each row of ``df`` with a usable vector, once per component, with ``COLUMNS``.

    Rows whose vector is null, shorter than the longest, or holds null or non-finite
    entries go. Repeated vectors count once in the fit, and all their rows are returned; ids
    are not read, so null and repeated ones stay as they are. Fewer than ``most`` components
    come back where the vectors span fewer dimensions (one vector, an empty table: none).
    Of equal variances any basis may come, the same for all rows. ``deviation`` is null
    beyond a long. Columns of ``df`` named like the new ones are replaced.
    """
    bound_batches(df.sparkSession)
    kept = without(df, [n for n in COLUMNS if n != vec])
    name = unused(kept, "y")
    rows, d = usable(kept, vec, name)
    one = rows.select(F.col(name).alias("y")).distinct()
    model = fit(written(one), d, most) if d else None
    add = T._parse_datatype_string("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    schema = T.StructType([*[f for f in kept.schema.fields], *add.fields])
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    k, names = len(model.values), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, white = _white(_matrix(batch.column(batch.num_columns - 1), d), model)
            if off.dtype == object or (off.size and float(np.abs(off).max()) ** 2 * d >= 2.0**62):
                far = [int(v) if (v := sum(int(c) ** 2 for c in r)) < 1 << 63 else None for r in off]
            else:
                far = (off * off).sum(axis=1)
            again = pa.array(np.repeat(np.arange(len(off)), k))
            own = [batch.column(c).take(again) for c in range(batch.num_columns - 1)]
            each = np.arange(k * len(off))
            yield pa.RecordBatch.from_arrays([
                *own, pa.array((each % k + 1).astype(np.int32)), pa.array(np.full(len(each), model.n)),
                pa.array(far, pa.int64()).take(again), pa.array(white.ravel()), pa.array(model.explained[each % k]),
                pa.array(np.full(len(each), model.identity_error)),
            ], names=names)

    return rows.mapInArrow(run, schema)
