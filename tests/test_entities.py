"""Coupling of entities without rows of shared tokens."""

import numpy as np
import pytest

from recallflow.operators import entities as en


@pytest.mark.parametrize("leads", [40, 1 << 19])
def test_shared_mass_equals_sets(spark, monkeypatch, leads):
    monkeypatch.setattr(en, "LEADS", leads)
    rnd = np.random.default_rng(11)
    idf = {(s, f"t{i}"): float(rnd.integers(1, 30)) / 7 for s in "ab" for i in range(300)}
    spectra = {(s, f"e{i}"): {f"t{j}" for j in rnd.choice(300, int(rnd.integers(1, 200)), replace=False)} for s in "ab" for i in range(40)}
    rows = [(s, e, t, idf[s, t]) for (s, e), ts in spectra.items() for t in ts]
    free = spark.createDataFrame([*rows, rows[0]], "namespace string, entity string, token string, idf double").repartition(5)
    pairs = [(s, f"e{i}", f"e{j}") for s in "ab" for i in range(40) for j in range(40) if f"e{i}" < f"e{j}" and rnd.random() < 0.4]
    asked = spark.createDataFrame([*pairs, ("a", "e1", "missing")], "namespace string, entity_a string, entity_b string")
    plan = en._shared_mass(asked, free)
    assert "token" not in plan.columns
    got = {(r.namespace, r.entity_a, r.entity_b): (r.shared_tokens, round(r.sic, 6)) for r in plan.collect()}
    twice = rows[0]
    want = {}
    for s, x, y in pairs:
        both = spectra[s, x] & spectra[s, y]
        again = s == twice[0] and twice[1] in (x, y) and twice[2] in both
        if both:
            want[s, x, y] = (len(both) + again, round(sum(idf[s, t] ** 2 for t in both) + again * twice[3] ** 2, 6))
    assert got == want


@pytest.mark.parametrize("leads", [60, 1 << 19])
def test_related_entities_equal_sums(spark, monkeypatch, leads):
    monkeypatch.setattr(en, "LEADS", leads)
    rnd = np.random.default_rng(12)
    idf = {f"t{i}": float(rnd.integers(1, 5)) / 4 for i in range(40)}
    held = {f"m{i}": sorted({f"t{j}" for j in rnd.integers(0, 40, 6)} | ({"e3"} if i % 4 == 0 else set())) for i in range(40)}
    said = {m: {f"e{j}" for j in rnd.integers(0, 15, int(rnd.integers(0, 4)))} for m in held}
    items = spark.createDataFrame([("n", m, ts) for m, ts in held.items()], "namespace string, mem_id string, tokens array<string>")
    mentions = spark.createDataFrame([("n", m, i, e) for i, (m, es) in enumerate(said.items()) for e in es], "namespace string, mem_id string, seq int, entity string")
    weights = spark.createDataFrame([("n", t, w) for t, w in idf.items()], "namespace string, token string, idf double")
    found = en.related_entities(items, mentions, weights, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(idf" not in plan  # sums of pairs are no rows
    got = sorted((r.mem_id, r["rank"], r.entity, round(r.shared_information, 6)) for r in found.collect())
    index = {}
    for m, es in said.items():
        for e in es:
            index.setdefault(e, set()).update(t for t in held[m] if t in idf)
    want = []
    for m, ts in held.items():
        sums = [(-round(sum(idf[t] for t in ts if t in ix), 6), e) for e, ix in index.items() if e not in said[m] and ix & set(ts)]
        want += [(m, r, e, -x) for r, (x, e) in enumerate(sorted(sums)[:3], 1)]
    assert got == sorted(want)
