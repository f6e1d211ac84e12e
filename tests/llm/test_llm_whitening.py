import math
from fractions import Fraction

import numpy as np
import pytest

from recallflow.llm import queries, whitening


def _brute(x, most=16):
    """numpy's own decomposition of the distinct rows' covariance."""
    u = np.unique(x, axis=0)
    off = u - u.mean(axis=0)
    e, v = np.linalg.eigh(off.T @ off / len(u))
    e, v = e[::-1], v[:, ::-1]
    return len(u), u.sum(axis=0), e[:most], v[:, :most], e.sum()


def test_query_equals_numpy(spark, sf):
    found = queries.QUERIES["op13_whitening"](spark, sf).toPandas().sort_values(["vec_id", "component"])
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.floor(64 * np.array(rows.embedding.tolist(), dtype=float)).astype(np.int64) + 1_000_000
    n, s, e, v, trace = _brute(x)
    white = (x - s / n) @ v / np.sqrt(e)
    own = found.whitened.to_numpy().reshape(len(x), 16)
    assert np.abs(np.abs(own) - np.abs(white)).max() < 1e-9
    assert (np.sign((own * white).sum(axis=0)) * own == pytest.approx(white, abs=1e-9))
    assert np.allclose(found.explained.to_numpy()[:16], e / trace, rtol=1e-9)
    assert (found.deviation.to_numpy().reshape(-1, 16) == ((n * x - s) ** 2).sum(axis=1)[:, None]).all()
    assert set(found.n) == {n} and found.identity_error.nunique() == 1 and found.identity_error.max() < 1e-9


def test_polynomial_is_exact(spark):
    rng = np.random.default_rng(5)
    b = rng.integers(-1000, 1000, size=(6, 9)).astype(object)
    m = b.T.dot(b)  # rank 6 of 9
    poly = whitening.characteristic(spark, m)
    # Faddeev and LeVerrier's recursion in exact integers
    want, a = [1], np.zeros((9, 9), dtype=object)
    for k in range(1, 10):
        a = m.dot(a) + want[-1] * np.eye(9, dtype=int).astype(object).dot(m) if k > 1 else m.copy()
        want.append(-int(a.trace()) // k)
    assert poly == want and poly[-3:] == [0, 0, 0]
    assert sum(k for _, k in whitening.Roots(poly).largest(16)) == 6


def test_roots_of_any_multiplicity():
    poly = [1]
    for root in (3, 3, 3, 8, 8, 100, 0, 0, 7_000_000_000):
        poly = [x - root * y for x, y in zip([*poly, 0], [0, *poly], strict=True)]
    found = whitening.Roots(poly).largest(9)
    assert [k for _, k in found] == [1, 1, 2, 3]
    assert [float(r) for r, _ in found] == pytest.approx([7e9, 100, 8, 3], rel=1e-15)
    assert sum(k for _, k in whitening.Roots(poly).largest(3)) == 4  # a pair is not torn


def test_roots_close_together():
    # x^2 - (2 * 10^20 + 1) x + 10^20 (10^20 + 1): neighbours at a relative 10^-20
    r = 10**20
    found = whitening.Roots([1, -(2 * r + 1), r * (r + 1)]).largest(2)
    assert [(round(x), k) for x, k in found] == [(r + 1, 1), (r, 1)]


def test_equal_variances_give_a_basis(spark):
    rows = [(k, [float(s) if j == k else 0.0 for j in range(4)]) for k in range(4) for s in (1, -1)]
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in found} == {1, 2, 3, 4} and found[0].identity_error < 1e-12
    assert all(math.isclose(r.explained, 0.25, rel_tol=1e-12) for r in found)


def test_null_vectors_of_a_simple_matrix():
    v = whitening.null_vectors([[2, 1], [1, 2]], Fraction(3), 1)
    assert np.allclose(v, [[math.sqrt(0.5)] * 2], atol=1e-16)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [0.5, 1.0, -2.0], "x"), (1, [0.5, 1.0, -2.0], "x"), (2, None, "x"), (3, [0.5, None, 1.0], "x"), (4, [nan, 1.0, 2.0], "x"),
        (5, [inf, 0.0, 1.0], "x"), (6, [1.0], "x"), (7, [], "x"), (None, [3.0, -1.0, 0.0], "x"), (8, [0.25, 0.0, 9.0], "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").selectExpr("*", "'x' AS y", "'x' AS whitened")
    found = whitening.whitened(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in found) == sorted((i, c) for i in (0, 1, 1, 8) for c in (1, 2))
    assert {r.n for r in found} == {3} and {r.y for r in found} == {"x"}  # the copy counts once; rank 2 of 3
    assert whitening.whitened(df.where("vec_id = 1")).collect() == []  # one vector has no variance
    assert whitening.whitened(df.where("1 = 0")).collect() == [] and whitening.whitened(df.where("vec_id = 7")).collect() == []


def test_huge_entries_stay_exact(spark):
    rows = [(k, [float(3**k), float(k)]) for k in range(30)] + [(99, [1e300, 0.0])]
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(found) == 62 and found[0].identity_error < 1e-4 and {r.deviation for r in found} == {None}
    x = [[64 * 3**k, 64 * k] for k in range(12)]
    s = [sum(c) for c in zip(*x, strict=True)]
    some = whitening.whitened(spark.createDataFrame(rows[:12], "vec_id long, embedding array<double>")).where("component = 1").collect()
    assert {r.vec_id: r.deviation for r in some} == {k: sum((12 * c - t) ** 2 for c, t in zip(x[k], s, strict=True)) for k in range(12)}
