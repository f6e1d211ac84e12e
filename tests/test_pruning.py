import numpy as np
import pytest
from pyspark.sql import functions as F

from recallflow.operators import corpus as cp
from recallflow.operators import lexical
from recallflow.operators import sessions as ss
from recallflow.operators.scans import top_k
from recallflow.operators.selection import percentiles


@pytest.mark.parametrize("name", ["wide", "ties", "negative", "one", "hot", "tiny"])
def test_percentiles_equal_numpy(spark, name):
    rng = np.random.default_rng(7)
    values = {
        "wide": np.exp(rng.normal(0, 6, 3000)), "ties": rng.integers(0, 5, 1000).astype(float), "negative": rng.normal(0, 50, 999),
        "one": np.array([3.25]), "hot": np.concatenate([np.full(2000, 12.5), rng.random(100) * 1e-6 + 12.5]), "tiny": rng.random(500) * 1e-9,
    }[name]
    shares = (0.0, 0.013, 0.5, 0.95, 0.99, 1.0)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double").repartition(5)
    assert list(percentiles(df, "x", shares).first()) == pytest.approx(list(np.quantile(values, shares)), rel=1e-12)


def test_percentiles_of_nothing(spark):
    assert list(percentiles(spark.createDataFrame([(None,)], "x double"), "x", (0.5, 0.9)).first()) == [None, None]


def _spectrum(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    rows = [
        (f"u{k % 2}", f"s{k:02d}", f"t{t:03d}", float(rng.random() * 3 + 0.05))
        for k in range(n) for t in {*rng.zipf(1.4, 12).clip(1, 300).tolist(), *(range(400 + k // 6, 404 + k // 6) if k % 3 else ())}
    ]
    return spark.createDataFrame(rows, "namespace string, session_id string, token string, weight double")


@pytest.mark.parametrize("least", [0.05, 0.15, 0.5])
def test_coupled_sessions_equal_all_pairs(spark, least):
    spectrum = _spectrum(spark).cache()
    every = {(r.session_a, r.session_b): r.coupling for r in ss.session_coupling(spectrum).collect()}
    found = {(r.session_a, r.session_b): r.coupling for r in ss.coupled_sessions(spectrum, least).collect()}
    assert found == pytest.approx({p: c for p, c in every.items() if c >= least}) and found
    near = ss.coupled_pairs(ss._scaled(spectrum), least).count()
    assert len(found) <= near <= len(every) and (least < 0.5 or near < 0.7 * len(every))


def _search(spark, n=1500, seed=5):
    """Items whose words follow a steep law, and short questions with some rare words."""
    rng = np.random.default_rng(seed)
    word = lambda k: f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}{chr(97 + k // 7 % 26)}x{k}"
    draw = lambda m: {word(int(k)) for k in rng.zipf(1.15, m).clip(1, 5000)}
    items = [("n", f"m{i:04d}", sorted(draw(int(rng.integers(3, 90))))) for i in range(n)]
    asks = [(q, "n", t) for q in range(12) for t in {*draw(3), *rng.choice(items[int(rng.integers(n))][2], 3).tolist()}]
    items = spark.createDataFrame(items, "namespace string, mem_id string, tokens array<string>")
    index = items.select("namespace", "mem_id", F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("token")).cache()
    weights = cp.token_weights(cp.token_df(index), cp.namespace_size(items)).cache()
    return spark.createDataFrame(asks, "query_id long, namespace string, token string").cache(), index, weights


def test_best_items_equal_scoring_everything(spark):
    tokens, index, weights = _search(spark)
    probes, postings = lexical.probes_of(tokens).cache(), lexical.stem_postings(index, weights).cache()
    every = lexical.all_candidates(probes, postings).cache()
    scored = {}
    for k in (1, 5, 40):
        want = top_k(every, lexical.Q, [F.desc(F.round("lexical", 9)), F.asc("mem_id")], k)
        got = lexical.best_items(tokens, index, weights, k)
        pick = lambda d: sorted((r.query_id, r.rank, r.mem_id, round(r.lexical, 8), r.matched) for r in d.collect())
        assert pick(got) == pick(want)
        theta = lexical.thresholds(probes, postings, k)
        scored[k] = lexical.survivors(lexical.bounded(probes, postings, theta), theta, k).count()
    # what is scored in full grows with k and stays far below the candidates
    assert scored[1] <= scored[5] <= scored[40] < 0.5 * every.count()


def test_no_token_no_item(spark):
    tokens, index, weights = _search(spark, 20)
    none = lexical.best_items(tokens.where("1 = 0"), index, weights, 5)
    strange = lexical.best_items(tokens.withColumn("token", F.lit("zzzzzzzz")), index, weights, 5)
    assert none.collect() == [] and strange.collect() == []


def test_guessed_tokens_count_half(spark):
    from recallflow.operators import recall as rc

    index = spark.createDataFrame([("n", "a", "hikers", 2), ("n", "a", "hiked", 2), ("n", "b", "hikers", 1)], "namespace string, mem_id string, token string, n_tokens int")
    weights = spark.createDataFrame([("n", "hikers", 2.0, 1.0), ("n", "hiked", 3.0, 1.0)], "namespace string, token string, idf double, entropy_weight double")
    tokens = spark.createDataFrame([(1, "n", "hikers", True)], "query_id long, namespace string, token string, inferred boolean")
    assert {r.mem_id: (r.raw, r.matched) for r in rc.candidates(tokens, index, weights).collect()} == {"a": (4.0, 2), "b": (1.0, 1)}


def test_synonyms_by_classes_equal_pairs_of_users(spark):
    from collections import defaultdict

    from recallflow.operators import embeddings as em

    rng = np.random.default_rng(11)
    near = {(f"u{u:02d}", f"t{t}"): tuple(sorted({f"x{x}" for x in ((1, 2, 3, t % 2 + 4) if u % 3 else rng.integers(0, 7, 4))})) for u in range(12) for t in range(5)}
    rows = [(u, t, x) for (u, t), xs in near.items() for x in xs]
    want = defaultdict(list)
    for (ua, ta), a in near.items():
        for (ub, tb), b in near.items():
            if ua < ub and ta != tb and len(set(a) & set(b)) >= 2:
                sim = len(set(a) & set(b)) / len(set(a) | set(b))
                if sim >= 0.3:
                    want[min(ta, tb), max(ta, tb)].append(sim)
    df = spark.createDataFrame(rows, "user_id string, token string, neighbor string")
    found = {(r.token_a, r.token_b): (r.confirmations, round(r.similarity, 9)) for r in em.discover_synonyms(df, 1.0).collect()}
    assert found == {k: (len(v), round(sum(v) / len(v), 9)) for k, v in want.items()}
    assert em.neighborhood_classes(df)[1].count() < len(near) / 2
