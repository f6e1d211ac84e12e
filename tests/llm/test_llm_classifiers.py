import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallflow.llm import quality, toxicity
from recallflow.llm.common import held_out


def test_nonnegative_risk_finds_the_positive_feature():
    rng = np.random.default_rng(1)
    noise = lambda: rng.choice(1000, 20, replace=False) + 10
    positives = [np.append(noise(), 3) for _ in range(60)]
    unlabelled = [np.append(noise(), 3) if k % 10 == 0 else noise() for k in range(600)]
    w, b = toxicity.fit(positives, unlabelled, 0.1)
    assert w[3] + b > np.log(0.7 / 0.3) and b < 0
    assert w.argmax() == 3


def test_nothing_to_learn_gives_the_prior():
    w, b = toxicity.fit([], [np.array([1])], 0.1)
    assert not w.any() and abs(1 / (1 + np.exp(-b)) - 0.1) < 1e-9
    assert not quality.fit([]).any()


def test_features_do_not_depend_on_the_batch():
    texts = [b"some text here", b"", b"\xc3\xa9t\xc3\xa9 some", b"x" * 5000]
    for sparse in (toxicity.sparse, quality.sparse):
        offsets, ids, *_ = sparse(texts)
        for k, t in enumerate(texts):
            one = sparse([t])
            assert ids[offsets[k] : offsets[k + 1]].tolist() == one[1].tolist()
    assert len(set(quality.sparse([b"AAA BBB"])[1]) & set(quality.sparse([b"CCC DDD"])[1])) >= 2  # shapes


@pytest.fixture(scope="module")
def learnt(spark, sf):
    at = sf.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    t, q = toxicity.train(docs, labels), quality.train(docs, labels)
    marked = docs.join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("doc_id", "text", F.col("toxic").alias("t"), F.col("quality").alias("q"))
    return t, q, toxicity.score(marked, t).collect(), quality.score(marked, q).collect()


def _auc(scores, marks):
    s, y = np.array(scores), np.array(marks)
    return np.mean((s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0]))


def test_held_out_accuracy(learnt):
    _, _, tox, good = learnt
    assert _auc([r.score for r in tox], [r.t for r in tox]) > 0.75  # 33 positives to learn from
    assert sum(r.score >= 0.7 and r.t == 0 for r in tox) <= 0.02 * len(tox)
    assert _auc([r.score for r in good], [r.q for r in good]) > 0.98


def test_odd_rows(learnt, odd, none):
    t, q, *_ = learnt
    for model, score in ((t, toxicity.score), (q, quality.score)):
        rows = score(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        empty = {r.score for r in rows if not r.text}
        assert len(empty) == 1
        assert score(none, model).collect() == []


def test_empty_labels(spark, odd):
    labels = spark.createDataFrame([(None, 1, 1), (5, None, None)], "doc_id long, toxic int, quality int")
    rows = toxicity.toxicity(odd, labels).collect()
    assert {r.predicted for r in rows} == {0} and len(rows) == odd.count()
    assert {r.score for r in quality.quality(odd, labels).collect()} == {0.5}
    assert all(isinstance(r.held_out, bool) for r in rows)


M = (1 << 64) - 1


def _mix(h):
    h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 & M
    return (h ^ h >> 29) * 0xD6E8FEB86659FD93 & M


def _hash(part, salt=0):
    """The polynomial hash of bytes, by its definition."""
    raw = sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(part))
    return _mix(raw + salt * 0xD6E8FEB86659FD93 & M)


def _toxic_features(text):
    out = set()
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode()):
        out.add(_hash(w) % (1 << 20))
        for n in (4, 5, 6, 8):
            if len(w) > n:
                out |= {_hash(w[:n], 2 * n) % (1 << 20), _hash(w[-n:], 2 * n + 1) % (1 << 20)}
    return out


def _quality_features(text):
    found, before = Counter(), None
    for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", (text or "").encode()):
        w = m[0]
        word, caps = _hash(w.lower()), sum(65 <= b <= 90 for b in w)
        shape = 4 if re.match(rb"[!-/:-@\[-`{-~]", w) else 1 if not caps else 3 if caps == len(w) > 1 else 2
        shape += 4 * (before is not None and before[0] == word)
        found.update(h % (1 << 20) for h in (word, _mix(shape + 1)))
        if before is not None:
            found.update(_mix(a * 0x9E3779B97F4A7C15 + b + k & M) % (1 << 20) for a, b, k in ((before[0], word, 2), (before[1], shape, 3)))
        before = (word, shape)
    norm = math.sqrt(sum(math.log1p(n) ** 2 for n in found.values()))
    return {f: math.log1p(n) / norm for f, n in found.items()}


def test_scores_equal_brute_force(learnt, spark, sf, odd):
    (w, b), q, *_ = learnt
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    for r in toxicity.score(docs, (w, b)).collect():
        z = b + sum(float(np.float32(w[f])) for f in _toxic_features(r.text))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)
    for r in quality.score(docs, q).collect():
        z = float(q[-1]) + sum(float(np.float32(q[f])) * v for f, v in _quality_features(r.text).items())
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


def test_ftrl_equals_its_definition():
    """Weights of the closed form, coordinate by coordinate."""
    rng = np.random.default_rng(3)
    own, z, n = quality.Leader(), Counter(), Counter()
    for _ in range(60):
        ids, values, label = rng.choice(12, 4, replace=False), rng.random(4), int(rng.integers(2))
        w = {i: 0.0 if abs(z[i]) <= own.l1 else -(z[i] - math.copysign(own.l1, z[i])) / ((own.beta + math.sqrt(n[i])) / own.alpha + own.l2) for i in ids}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(ids, values, strict=True))))
        for i, v in zip(ids, values, strict=True):
            g = (p - label) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / own.alpha * w[i]
            n[i] += g * g
        own.learn(ids, values, label, 1.0)
    assert np.allclose(own.z[:12], [z[i] for i in range(12)]) and np.allclose(own.n[:12], [n[i] for i in range(12)])


def test_positive_labels_alone(spark, sf):
    at = sf.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels.where("toxic = 1")).join(labels.select("doc_id", "toxic"), "doc_id", "left").collect()
    clean, flagged = [r for r in rows if r.toxic == 0], [r for r in rows if r.predicted]
    assert len(flagged) < 0.15 * len(rows) and sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert sum(r.predicted for r in rows if r.toxic) >= 0.6 * sum(r.toxic == 1 for r in rows)


def test_rare_but_certain_words_are_learnt():
    """Each positive has one of 40 words that no other text has: 25 texts a word in 1,000."""
    rng = np.random.default_rng(4)
    noise = lambda: rng.choice(2000, 20, replace=False) + 100
    positives, unlabelled = [np.append(noise(), k % 40) for k in range(1000)], [noise() for _ in range(3000)]
    w, b = toxicity.fit(positives, unlabelled, 0.05)
    assert (w[:40] + b > 0).all() and not w[100:].any()


def test_estimated_prior_is_near_the_share():
    rng = np.random.default_rng(6)
    for share in (0.02, 0.1, 0.4):
        toxic = lambda: np.unique(np.concatenate([rng.choice(500, 15), 1000 + rng.choice(4, 2)]))
        positives = [toxic() for _ in range(800)]
        unlabelled = [toxic() if rng.random() < share else np.unique(rng.choice(500, 15)) for _ in range(4000)]
        counts = [np.bincount(np.concatenate(r), minlength=1 << 20) for r in (positives, unlabelled)]
        assert share * 0.8 < toxicity.estimated_prior(counts[0], 800, counts[1], 4000) < share * 1.25 + 0.01


def test_repeated_rows_count_once(spark):
    rows = [(k, f"bad word number {k % 7}" if k % 4 == 0 else f"fine text of {k % 90}") for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(0, 400, 2)], "doc_id long, toxic int")
    once = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, prior=0.25)
    many = toxicity.train(spark.createDataFrame([*rows, *rows[:1] * 300, *rows[8:9] * 300], "doc_id long, text string"), labels, prior=0.25)
    assert once[0].any() and once[0].tolist() == many[0].tolist() and once[1] == many[1]
