"""What travels between tasks: the same results with fewer rows."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallflow.operators import belief as bl
from recallflow.operators import corpus as cp
from recallflow.operators import lexical
from recallflow.operators import recall as rc
from recallflow.operators import schemas as sc


def shuffled(spark, action):
    """(result, rows written into shuffles) of an action."""
    jvm = spark.sparkContext._jvm
    lists = jvm.java.util.ArrayList

    def written():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(lists(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), lists())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    out = action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return out, sum(n for k, n in written().items() if k not in before)


def test_fixed_tokens_of_small_and_large_groups_without_token_rows(spark):
    rng = np.random.default_rng(4)
    items = {f"m{i:03d}": {*(f"w{k}" for k in rng.integers(0, 400, 60)), *(f"c{k}" for k in range(i % 4 + 1))} for i in range(120)}
    groups = {f"g{k:03d}": [f"m{i:03d}" for i in rng.choice(120, 3 + k % 8, replace=False)] for k in range(150)}
    groups["all"], groups["some"] = [*items], [f"m{i:03d}" for i in range(0, 120, 4)]
    members = spark.createDataFrame([("n", g, m) for g, ms in groups.items() for m in ms], "namespace string, group_id string, mem_id string").cache()
    held = spark.createDataFrame([("n", m, sorted(t)) for m, t in items.items()] + [("n", "bare", [])], "namespace string, mem_id string, tokens array<string>").cache()
    count = defaultdict(int)
    for t in items.values():
        for w in t:
            count[w] += 1
    idf = spark.createDataFrame([("n", w, 1.0 / c) for w, c in count.items()], "namespace string, token string, idf double").cache()
    want = {}
    for g, ms in groups.items():
        for w in set().union(*(items[m] for m in ms)):
            share = sum(w in items[m] for m in ms) / len(ms)
            if share >= 0.8:
                want[g, w] = pytest.approx((share, share / count[w] ** 2))
    members.count(), held.count(), idf.count()
    small = members.where(~F.col("group_id").isin("all", "some"))
    found = {(r.group_id, r.token): (r.coverage, r.weight) for r in sc.fixed_point(members, held, idf).collect()}
    assert found == want and {"all", "some"} & {g for g, _ in want}
    _, moved = shuffled(spark, lambda: sc.fixed_point(small, held, idf).collect())
    pairs = sum(len(items[m]) for g, ms in groups.items() if g not in ("all", "some") for m in ms)
    assert moved < 0.7 * pairs


def test_gated_supersession_stops_at_the_first_free_fact(spark, capsys):
    rng = np.random.default_rng(6)
    vec = [(lambda v: v / np.linalg.norm(v))(rng.normal(0, 0.4, 4) + np.eye(4)[i % 2]) for i in range(120)]
    day = [None if i % 17 == 0 else int(rng.integers(0, 5)) for i in range(120)]
    text = [f"red {'house' if i % 3 else 'boat'} {i % 4}" for i in range(120)]
    rows = [("n", i, f"s{i % 3}", "r", text[i], day[i], [float(x) for x in vec[i]]) for i in range(120)]
    items = spark.createDataFrame(rows, "namespace string, seq long, subject string, relation string, text string, d int, embedding array<double>")
    items = items.withColumn("event_at", F.timestamp_seconds(F.col("d") * 86400)).drop("d").cache()

    def conflict(i, j):
        a, b, s = {*text[i].split()}, {*text[j].split()}, float(vec[i] @ vec[j])
        return s > 0.7 and len(a & b) / len(a | b) < 0.3

    want = {i for i in range(120) if any(
        j % 3 == i % 3 and day[j] is not None and (day[i] is None or day[i] < day[j]) and not conflict(i, j) for j in range(120))}
    out = bl.mark_superseded_gated(items)
    assert {r.seq for r in out.where("superseded").collect()} == want and out.count() == 120
    out.explain("formatted")
    assert "LeftSemi" in capsys.readouterr().out


def test_entity_search_without_token_rows(spark):
    rng = np.random.default_rng(9)
    n, names = 80, ["ann", "bob", "new york", "zoe"]
    said = {f"m{i:03d}": {names[k] for k in rng.choice(4, 1 + i % 3, replace=False)} for i in range(n)}
    held = {m: {*(f"w{k}" for k in rng.integers(0, 90, 40)), *(p for e in said[m] for p in e.split())} for m in said}
    asks = {q: ({names[q % 4], names[(q + 1) % 4], *({names[(q + 2) % 4]} if q % 3 == 0 else ())}, {f"w{k}" for k in rng.integers(0, 90, 5)}) for q in range(30)}
    idf = {t: float(1 + i % 7) for i, t in enumerate(sorted(set().union(*held.values())))}
    frame = lambda rows, kind: spark.createDataFrame(rows, kind).cache()
    items = frame([("n", m, sorted(t), 0.5 + i / 200, 0.1 * (i % 5)) for i, (m, t) in enumerate(held.items())], "namespace string, mem_id string, tokens array<string>, strength double, free_energy double")
    mentions = frame([("n", m, e) for m, es in said.items() for e in es], "namespace string, mem_id string, entity string")
    found = frame([(q, "n", e) for q, (es, _) in asks.items() for e in es], "query_id long, namespace string, entity string")
    tokens = frame([(q, "n", t) for q, (_, ts) in asks.items() for t in ts], "query_id long, namespace string, token string")
    coupled = frame([(q, "n", len(es), q / 10) for q, (es, _) in asks.items()], "query_id long, namespace string, n long, k_coupling double")
    weights = frame([*idf.items()], "token string, idf double")
    want = {}
    for q, (es, ts) in asks.items():
        own = {p for e in es for p in (e, *e.split())}
        with_all = set.intersection(*[set().union(*[held[m] for m in said if e in said[m]]) for e in es]) - own - {*names}
        for i, m in enumerate(held):
            if said[m] & es:
                mass = sum(idf[t] * ((t not in own | with_all | ts) + 2 * (t in ts - own - {*names}) + 3 * (t in with_all)) for t in held[m])
                want[q, m] = pytest.approx(len(said[m] & es) / len(es) * (1 + q / 10) * mass * (0.5 + i / 200) - 0.1 * (i % 5))
    for df in (items, mentions, found, tokens, coupled, weights):
        df.count()
    out, moved = shuffled(spark, lambda: rc.entity_search(found, tokens, items, mentions, weights, coupled).collect())
    assert {(r.query_id, r.mem_id): r.score for r in out} == want
    assert moved < sum(len(held[m]) for _, m in want) / 2
    best = rc.entity_search(found, tokens, items, mentions, weights, coupled, 5).collect()
    assert len(best) == 5 * len(asks) and all(r.score == want[r.query_id, r.mem_id] for r in best)


@pytest.mark.parametrize("k", [1, 6])
def test_best_lexical_of_long_queries_without_candidate_rows(spark, k):
    rng = np.random.default_rng(12)
    word = lambda n: f"{chr(97 + n % 26)}{chr(97 + n // 26)}x{n % 3}{n}"
    texts = [sorted({word(int(n)) for n in rng.integers(0, 120, rng.integers(2, 70))}) for _ in range(150)]
    items = spark.createDataFrame([("n", f"m{i:04d}", texts[i % 150]) for i in range(450)], "namespace string, mem_id string, tokens array<string>")
    index = items.select("namespace", "mem_id", F.size("tokens").alias("n_tokens"), F.explode("tokens").alias("token")).cache()
    weights = cp.token_weights(cp.token_df(index), cp.namespace_size(items)).cache()
    asks = [(q, "n", word(int(n)), False) for q in range(20) for n in rng.choice(120, 80, replace=False)]
    tokens = spark.createDataFrame(asks, "query_id long, namespace string, token string, inferred boolean").cache()
    index.count(), weights.count(), tokens.count()
    pick = lambda rows: sorted((r.query_id, r.rank, r.mem_id, round(r.lexical, 8), r.matched, r.n_tokens) for r in rows)
    want, before = shuffled(spark, lambda: lexical.best_items(tokens, index, weights, k).collect())
    got, moved = shuffled(spark, lambda: rc.best_lexical(tokens, index, weights, k).collect())
    assert pick(got) == pick(want) and len(got) == 20 * k and moved < before / 2
