import numpy as np
import pytest
from pyspark.sql import functions as F

from recallflow.operators import corpus as cp
from recallflow.operators import factor as fa
from recallflow.plans import jobs


def _pairs(spark, matrices):
    rows = [
        (ns, f"t{i:02d}", f"t{j:02d}", float(m[i, j])) for ns, m in matrices.items() for i in range(len(m)) for j in range(i + 1, len(m)) if m[i, j]
    ]
    weights = spark.createDataFrame(rows, "namespace string, token_a string, token_b string, ppmi double")
    vocab = spark.createDataFrame([(ns, f"t{i:02d}") for ns, m in matrices.items() for i in range(len(m))], "namespace string, token string")
    return weights, vocab


def _matrix(seed, n):
    m = np.triu(np.random.default_rng(seed).random((n, n)), 1)
    return m + m.T


def _rows(state, ns, n):
    held = {r.token: r.vec for r in state.where(f"namespace = '{ns}'").collect()}
    return np.array([held[f"t{i:02d}"] for i in range(n)])


def test_whole_basis_reconstructs_the_matrix(spark):
    matrices = {"a": _matrix(1, 9), "b": _matrix(2, 9)}
    weights, vocab = _pairs(spark, matrices)
    state = fa.ppmi_vectors(weights, vocab, dims=9, iterations=2).cache()
    for ns, m in matrices.items():
        v = _rows(state, ns, 9)
        assert np.allclose(v.T @ v, np.eye(9), atol=1e-10)
        assert np.allclose(v @ (v.T @ m @ v) @ v.T, m, atol=1e-9)
    for r in fa.energy(weights, vocab, state, 9).collect():
        assert r.norm2 == pytest.approx((matrices[r.namespace] ** 2).sum()) and r.inside2 == pytest.approx(r.norm2) and r.image2 == pytest.approx(r.norm2)


def test_dominant_space_and_warm_start(spark):
    m = _matrix(3, 30) + 3.0 * np.kron(np.eye(3), np.ones((10, 10)) - np.eye(10) / 1)
    np.fill_diagonal(m, 0.0)
    weights, vocab = _pairs(spark, {"a": m})
    e, u = np.linalg.eigh(m)
    top = u[:, np.argsort(-np.abs(e))[:3]]
    first = jobs.token_space(weights, vocab, 3)
    again = jobs.token_space(weights, vocab, 3, previous=first, again=1)
    for state in (first, again):
        assert np.linalg.norm(_rows(state, "a", 30).T @ top) ** 2 == pytest.approx(3, abs=1e-3)
    # one step from the earlier rows is as good as many; one cold step is not
    cold = fa.ppmi_vectors(weights, vocab, 3, 1)
    assert np.linalg.norm(_rows(cold, "a", 30).T @ top) ** 2 < 2.9


def test_dependent_columns_become_zero_and_wake(spark):
    weights, vocab = _pairs(spark, {"a": _matrix(4, 3)})
    state = fa.ppmi_vectors(weights, vocab, dims=5, iterations=3)
    v = _rows(state, "a", 3)
    assert v.shape == (3, 5) and np.allclose(v.T @ v, np.diag([1, 1, 1, 0, 0]), atol=1e-9)
    weights, vocab = _pairs(spark, {"a": _matrix(5, 8)})
    grown = _rows(jobs.token_space(weights, vocab, 5, previous=state), "a", 8)
    assert np.allclose(grown.T @ grown, np.eye(5), atol=1e-9)


def test_inverse_factor_equals_qr():
    m = np.random.default_rng(6).random((40, 6))
    q, r = np.linalg.qr(m)
    q = q * np.sign(np.diag(r))
    assert np.allclose(m @ fa.inverse_factor(m.T @ m), q, atol=1e-10)


def test_eviction_of_one_frequency_goes_by_token(spark):
    rows = [("n", f"{chr(97 + k % 26)}{k:03d}", 1) for k in range(100)] + [("n", f"z{k}", 5) for k in range(50)]
    kept = {r.token for r in cp.evict_vocab(spark.createDataFrame(rows, "namespace string, token string, df long"), limit=100).collect()}
    assert kept == {t for _, t, _ in sorted(rows, key=lambda r: (r[2], r[1]))[30:]}


def test_eviction_makes_the_vocabulary_once(spark):
    made = spark.sparkContext.accumulator(0)
    own = F.udf(lambda t: (made.add(1), t)[1], "string")
    rows = [(n, f"{chr(97 + k % 7)}{k:03d}", 1 + k % 4) for n in ("a", None) for k in range(100)] + [("few", "x", 1), ("few", "y", 2)]
    df = spark.createDataFrame(rows, "namespace string, token string, df long").withColumn("token", own("token"))
    got = {(r.namespace, r.token, r.df) for r in cp.evict_vocab(df, limit=50).collect()}
    want = {r for r in rows if r[0] == "few"}
    for n in ("a", None):
        want |= {*sorted((r for r in rows if r[0] == n), key=lambda r: (r[2], r[1]))[20:]}
    assert got == want and made.value == len(rows)
