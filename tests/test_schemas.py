"""Groups of any size: fixed tokens, and schemas of whole groups."""

import hashlib

import numpy as np
import pytest

from recallflow.functions import lexicon as lx
from recallflow.operators import schemas as sc
from recallflow.plans import registry


@pytest.mark.parametrize("again", [1, 2])
def test_fixed_tokens_of_large_groups_equal_counting(spark, again):
    rnd = np.random.default_rng(5)
    held = {f"m{i}": ["all"] + [f"t{k}" for k in range(12) if rnd.random() < 0.95 - 0.06 * k] for i in range(150)}
    items = spark.createDataFrame([("n", m, ts) for m, ts in held.items()] * again, "namespace string, mem_id string, tokens array<string>")
    idf = spark.createDataFrame([("n", t, 2.0) for t in ["all", *[f"t{k}" for k in range(12)]]], "namespace string, token string, idf double")
    groups = {f"g{n}": [f"m{i}" for i in rnd.permutation(150)[:n]] for n in (3, 16, 17, 18, 25, 60, 149)}
    members = spark.createDataFrame([("n", g, m) for g, ms in groups.items() for m in ms + ms[:1] * (again - 1)], "namespace string, group_id string, mem_id string")
    got = {(r.group_id, r.token): round(r.coverage, 9) for r in sc.fixed_point(members, items, idf).collect()}
    want = {}
    for g, ms in groups.items():
        rows = ms + ms[:1] * (again - 1)
        for t in ["all", *[f"t{k}" for k in range(12)]]:
            k = sum(again * held[m].count(t) for m in rows) / len(rows)
            if k >= lx.FIXED_POINT_COVERAGE:
                want[g, t] = round(k, 9)
    assert got == want


def test_cycle_merges_whole_groups(spark, tmp_path):
    # Twenty turns share two words, the first ten of them a third one.
    texts = [f"alpha beta {'gamma ' if i < 10 else ''}word{i}" for i in range(20)] + [f"filler{i} sentence{i} number{i}" for i in range(60)]
    rows = [(10 * i, 1, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r.mem_id: r.text_md5 for r in registry.load()[0]["jobs_sleep_cycle_l2"](spark, str(tmp_path)).collect()}
    said = lambda words: hashlib.md5(f"[Schema: alpha] {words}".encode()).hexdigest()
    assert found["schema/u0/e:alpha"] == said("alpha beta") and found["schema/u0/t:gamma"] == said("gamma alpha beta")
