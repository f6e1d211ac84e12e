"""Retrieval, temporal text, threads, corpus spaces, entities and metering cases."""

from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from recallflow.functions import temporal as tp
from recallflow.functions import text as tx
from recallflow.operators import corpus as cp
from recallflow.operators import factor as fa
from recallflow.operators import entities as en
from recallflow.operators import metering as mt
from recallflow.operators import recall as rc
from recallflow.operators import schemas as sc
from recallflow.operators import strength as st
from recallflow.operators import threads as th
from recallflow.session import cut
from recallflow.sources import adapters as ad

FACTS = [
    "Alice is 32 years old.", "Bob is 28 years old.", "Charlie is 45 years old.", "Alice works as an engineer at Initech.",
    "Bob moved to Berlin in spring.", "Charlie married Dana Smith.", "The office printer is broken.", "Alice enjoys hiking with Bob.",
]


def _memory(spark, texts):
    rows = [(f"m{i}", "u", i, t) for i, t in enumerate(texts)]
    return st.memory_state(st.derive_facts(spark.createDataFrame(rows, "mem_id string, namespace string, seq bigint, text string")))


def _ask(spark, *texts):
    return spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)], "query_id int, namespace string, text string")


def test_known_facts_are_in_the_top_five(spark):
    state = cut(_memory(spark, FACTS))
    hits = rc.lexical_search(_ask(spark, "How old is Alice?", "Where did Bob move?", "who is the husband of Dana", "zzzz qqqq"), state, 5)
    got = {}
    for r in hits.collect():
        got.setdefault(r.query_id, []).append(r.mem_id)
    assert "m0" in got[0] and "m4" in got[1] and "m5" in got[2]
    assert len(got[3]) == 5  # nothing matches: most stable items


def test_knn_equals_brute_force_and_cells_find_most(spark, sf):
    v = ad.vectors(spark, "/root/testdata/sf0.01")
    items = v.select("namespace", F.col("vec_id").alias("mem_id"), "vec", "confidence")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "namespace", "vec")
    exact = {(r.query_id, r.mem_id) for r in rc.knn(q, items, 10).collect()}
    rows = items.collect()
    for a in q.collect():
        sims = sorted(((-np.dot(a.vec, r.vec) / np.linalg.norm(a.vec) / np.linalg.norm(r.vec), r.mem_id) for r in rows if r.namespace == a.namespace))[:10]
        assert {(a.query_id, m) for _, m in sims} == {e for e in exact if e[0] == a.query_id}
    model = rc.train_cells(items, 8)
    approx = {(r.query_id, r.mem_id) for r in rc.knn_approx(q, rc.assign_cells(items, model), model, 10, 6).collect()}
    assert len(approx & exact) / len(exact) > 0.8


def test_blocks_give_what_all_pairs_give(spark, monkeypatch):
    """Small blocks, equal vectors, a large cell; ties go to the smaller id."""
    monkeypatch.setattr(rc, "BLOCK", 7)
    monkeypatch.setattr(rc, "AT_ONCE", 3)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 6))
    vecs = [base[i if i < 25 else 0 if i < 45 else i - 30] for i in range(60)]
    rows = [(i, "ab"[i % 2], [float(x) for x in v], 1.0) for i, v in enumerate(vecs)]
    items = spark.createDataFrame(rows, "mem_id bigint, namespace string, vec array<double>, confidence double")
    asks = items.select(F.col("mem_id").alias("query_id"), "namespace", "vec")
    sims = np.round(np.array([[np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) for b in vecs] for a in vecs]), 12)
    want = {(i, j, r + 1) for i in range(60) for r, j in enumerate(sorted((j for j in range(60) if j % 2 == i % 2), key=lambda j: (-sims[i, j], j))[:4])}
    keep = lambda df: {(r.query_id, r.mem_id, r.rank) for r in df.collect()}
    assert keep(rc.knn(asks, items, 4)) == want
    model = rc.train_cells(items, 5)
    celled = cut(rc.assign_cells(items, model))
    assert keep(rc.knn_approx(asks, celled, model, 4, None)) == want
    cell = {r.mem_id: r.cell for r in celled.collect()}
    centers = np.array(model.clusterCenters())
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    near = [set(np.argsort(-(centers @ (v / np.linalg.norm(v))))[:2]) for v in vecs]
    some = {(i, j, r + 1) for i in range(60) for r, j in enumerate(sorted((j for j in range(60) if j % 2 == i % 2 and cell[j] in near[i]), key=lambda j: (-sims[i, j], j))[:4])}
    assert keep(rc.knn_approx(asks, celled, model, 4, 2)) == some


def test_search_in_blocks_equals_scoring_each_pair(spark, monkeypatch):
    monkeypatch.setattr(rc, "ASKS", 3)
    monkeypatch.setattr(rc, "HELD", 4)
    words = "alpha alphabet beta betamax gamma delta deltas xalphax zzz omega".split()
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(words, size=rng.integers(1, 7))) for _ in range(30)]
    items = spark.createDataFrame([(f"m{i:02d}", "u", i, t, 1.0, "liquid", i / 50) for i, t in enumerate(texts)],
        "mem_id string, namespace string, seq bigint, text string, strength double, phase string, free_energy double")
    items = cut(items.withColumn("tokens", tx.tokenize(F.col("text"))))
    asks = _ask(spark, "alpha omega", "beta", "delta gamma alphabet", "pha", "qqqq", "zzz betamax", "max")
    tokens = {r.query_id: r.t for r in asks.select("query_id", tx.token_set(F.col("text")).alias("t")).collect()}
    rows = items.join(rc.item_state(items), ["namespace", "mem_id"]).collect()
    df = {}
    for r in rows:
        for t in set(r.tokens):
            df[t] = df.get(t, 0) + 1
    weight = {r.token: r.idf * r.entropy_weight for r in cp.token_weights(cp.token_df(items.select("namespace", "mem_id", F.explode("tokens").alias("token"))), cp.namespace_size(items)).collect()}
    want = {}
    for q, asked in tokens.items():
        stems = {t[:4] for t in asked}
        any_hit = any(t[:4] in stems for r in rows for t in r.tokens)
        for r in rows:
            held = [t for t in r.tokens if t[:4] in stems]
            inside = sum(any(t in w for w in r.text.lower().split()) for t in asked)
            n = max(len(r.tokens), 1)
            if held:
                want[q, r.mem_id] = (sum(weight[t] for t in held) / n ** 0.5 * (1 + len(held) / n) + r.thermo) * r.chi
            elif inside:
                want[q, r.mem_id] = inside / len(asked) * (5 / n ** 0.5 if any_hit else 10.0) * r.chi + r.thermo * 0.01
    got = {(r.query_id, r.mem_id): r.score for r in rc.lexical_search(asks, items, None).where("query_id <> 4").collect()}
    assert got.keys() == want.keys() and len(got) > 40
    assert max(abs(got[x] - want[x]) for x in got) < 1e-9
    best = {}
    for r in rc.lexical_search(asks, items, 5).collect():
        best.setdefault(r.query_id, []).append((r.rank, round(r.score, 9)))
    for q in tokens:
        if q != 4:
            scores = sorted((round(s, 9) for (a, _), s in want.items() if a == q), reverse=True)[:5]
            assert [s for _, s in sorted(best[q])] == scores
    assert len(best[4]) == 5


def test_relative_dates(spark):
    cases = [
        ("2024-05-08", "I went to the doctor yesterday", "I went to the doctor on 7 May 2024"),
        ("2024-05-08", "Meeting tomorrow and dentist next week", "Meeting on 9 May 2024 and dentist the week of 15 May 2024"),
        ("2024-05-08", "I ran a race last Saturday", "I ran a race on 4 May 2024"),
        ("2024-05-08", "Going camping next month", "Going camping in June 2024"),
        ("2024-05-08", "the day before yesterday", "on 6 May 2024"), ("2024-05-08", "in June", "in June 2024"),
        ("2024-05-08", "last weekend", "the week of 4 May 2024"), ("2024-05-08", "next weekend", "the week of 18 May 2024"),
        ("2024-05-08", "in a week", "on 15 May 2024"), ("2024-05-08", "Bought this in 2021", "Bought this in 2021"),
        ("2024-05-08", "due in 3 days ago", "due in on 5 May 2024"), ("2024-05-08", "IN 2  Weeks!", "on 22 May 2024!"),
        ("2024-05-08", "last may, next may, in may", "on May 2023, on May 2025, in May 2025"),
        ("2024-05-08", "next wed and last wed", "on 15 May 2024 and on 1 May 2024"),
        ("2024-05-08", "today.today", "on 8 May 2024.on 8 May 2024"), ("2024-05-08", "last thisweek", "last thisweek"),
        ("2024-03-31", "1 month ago", "1 month ago"), ("2024-01-31", "next month", "next month"),
        ("2024-03-31", "last month or last year", "last month or in 2023"), ("2023-12-15", "next month", "in January 2024"),
        ("2024-05-08", "99999999999 days ago", "99999999999 days ago"), ("2024-05-08", "", ""), (None, "today", "today"),
    ]
    df = spark.createDataFrame(cases, "ref string, text string, want string")
    for r in df.withColumn("got", tp.resolve_dates(F.col("text"), F.col("ref").cast("timestamp"))).collect():
        assert r.got == r.want, (r.text, r.got)
    note = spark.range(1).select(tp.annotate_dates(F.lit("yesterday, x"), F.lit("2024-05-08").cast("timestamp"))).first()[0]
    assert note == "yesterday [7 May 2024], x"


def test_time_filter_rules(spark):
    now = F.lit("2024-05-08 12:00:00").cast("timestamp")
    q = _ask(spark, "last week", "who did I meet in January 2024?", "what are my hobbies", "a while ago", "in september")
    f = {r.query_id: r.f for r in q.select("query_id", tp.time_filter_of(F.col("text"), now).alias("f")).collect()}
    assert f[0].tf_signal == "recent" and f[0].tf_start == datetime(2024, 5, 1, 12)
    assert (f[1].tf_start, f[1].tf_end) == (datetime(2024, 1, 1), datetime(2024, 1, 31, 23, 59, 59))
    assert f[2].tf_signal == "none" and f[2].tf_start is None
    assert f[3].tf_signal == "historical" and f[4].tf_start == datetime(2023, 9, 1)


def test_event_dates(spark):
    d = spark.createDataFrame([("on 7 May 2024 and 2023-01-01",), ("at 2024-02-30",), ("in Mar 2022",), ("since 1999",), ("none",)], "t string")
    got = [r.d for r in d.select(tp.event_date(F.col("t"), F.lit("2000-01-01").cast("timestamp")).alias("d")).collect()]
    # The impossible ISO date falls through to the year rule.
    assert got == [datetime(2024, 5, 7), datetime(2024, 1, 1), datetime(2022, 3, 1), datetime(1999, 1, 1), datetime(2000, 1, 1)]


def test_recurring_events_stay_apart(spark):
    rows = []
    for i in range(10):
        rows.append((f"d{i}", "u", 2 * i, "I went to the doctor for a visit" if i % 2 else "saw the doctors again", f"2024-01-{i + 1:02d}"))
        rows.append((f"h{i}", "u", 2 * i + 1, "We hiked the hill" if i % 2 else "Hiking trip", f"2024-02-{i + 1:02d}"))
    items = spark.createDataFrame(rows, "mem_id string, namespace string, seq bigint, text string, d string").withColumn("event_at", F.col("d").cast("timestamp"))
    threads = th.event_threads(items)
    assert {r.stem: len(r.dates) for r in threads.collect()} == {"doctor": 10, "hik": 10}
    hit = th.thread_hits(_ask(spark, "how many times did I see the doctor", "last time I went hiking"), threads, "2024-06-01").collect()
    texts = {r.query_id: r.text for r in hit}
    assert texts[0].startswith("[Frequency]") and "10 times" in texts[0] and texts[1].endswith("10 February 2024")


def test_token_space_separates_topics(spark):
    pets, cars = "cat dog pet animal fur", "car truck vehicle engine road"
    rows = [(f"m{i}", "g", t) for i, t in enumerate([" ".join(p.split()[j] for j in c) for p in (pets, cars) for c in ((0, 1, 2), (1, 2, 3), (2, 3, 4), (0, 3, 4), (0, 1, 4), (0, 2, 4))])]
    items = spark.createDataFrame(rows, "mem_id string, namespace string, text string")
    df = cp.token_df(cp.item_tokens(items))
    pairs = cp.cooccurrence_all(items)
    weights = cp.ppmi(pairs, df, cp.namespace_size(items))
    out = fa.ppmi_vectors(weights, cp.svd_vocab(df, pairs), dims=4, iterations=6).collect()
    v = {r.token: np.array(r.vec) for r in out}
    m = np.vstack(list(v.values()))
    assert np.allclose(m.T @ m, np.eye(m.shape[1]), atol=1e-8)

    def cos(a, b):
        return v[a] @ v[b] / (np.linalg.norm(v[a]) * np.linalg.norm(v[b]) + 1e-12)

    assert cos("cat", "dog") > cos("cat", "truck")


def test_sketch_never_underestimates(spark, sf):
    items = ad.table(spark, sf, "benchmark").select(F.lit("b").alias("namespace"), "text")
    exact = cp.cooccurrence_all(items)
    est = cp.cms_query(cp.cms_build(exact), exact).join(exact, ["namespace", "token_a", "token_b"])
    assert est.where("estimate < pairs").count() == 0 and est.count() > 0


def test_components_of_chain_and_star(spark):
    rows = [("n", f"a{i:03d}", f"a{i + 1:03d}") for i in range(60)] + [("n", "z", f"z{i}") for i in range(50)] + [("o", "a001", "z")]
    e = spark.createDataFrame(rows, "namespace string, x string, y string")
    c = en.components(e, "x", "y")
    got = {(r.namespace, r.component): r.n for r in c.groupBy("namespace", "component").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {("n", "a000"): 61, ("n", "z"): 51, ("o", "a001"): 2}


def test_schema_forms_absorbs_and_melts(spark):
    # The group must lose little: many similar facts about one subject.
    texts = [f"Alice practises classical violin repertoire concerto {w}" for w in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday")]
    texts += [f"unrelated filler sentence number{i} word{i} thing{i}" for i in range(30)]
    items = cut(_memory(spark, texts).withColumn("strength", F.lit(1.0)))
    idf = cut(cp.token_weights(cp.token_df(items.select("namespace", "mem_id", F.explode("tokens").alias("token"))), cp.namespace_size(items)))
    mentions = cut(en.entity_mentions(items))
    members = cut(sc.schema_candidates(items, mentions, idf))
    built = cut(sc.build_schemas(sc.schema_delta(members, items, cut(sc.fixed_point(members, items, idf)), mentions)))
    rows = [r for r in built.collect() if "violin" in r.fixed_tokens]
    assert rows and all(r.delta_f < 0 and len(r.fixed_tokens) >= 2 for r in rows)
    new = items.limit(1).withColumns({"tokens": F.array(*[F.lit(t) for t in rows[0].fixed_tokens]), "mem_id": F.lit("new"), "seq": F.lit(99).cast("bigint")})
    archive = cut(sc.archive_rows(built))
    faded = {r.mem_id: r.tau for r in sc.fade_members(items, archive).collect()}
    assert all(faded[r.mem_id] == 5.0 for r in archive.collect()) and 50.0 in faded.values()
    more = items.unionByName(new, allowMissingColumns=True)
    after, members_now, next_items = sc.absorb(more, built, archive)
    taken = [r.mem_id for r in members_now.exceptAll(archive).collect()]
    assert "new" in taken and not {*taken} & {*[r.mem_id for r in archive.collect()]}  # founders are not taken again
    assert after.agg(F.sum("absorbed")).first()[0] == len(taken) == len({*taken})
    assert {r.tau for r in next_items.where(F.col("mem_id").isin(taken)).collect()} == {5.0}
    dead, _ = sc.melt(built, archive, items.withColumn("strength", F.lit(0.0)), idf, mentions)
    assert {r.strength for r in dead.collect()} == {0.0}
    two = [r.mem_id for r in archive.where(F.col("schema_id") == rows[0].mem_id).orderBy("mem_id").limit(1).collect()]
    orphan = items.withColumn("strength", F.when(F.col("mem_id").isin(two), 1.0).otherwise(0.0)).withColumn("tau", F.lit(5.0))
    dead, freed = sc.melt(built, archive, orphan, idf, mentions)
    assert {r.strength for r in dead.where(F.col("mem_id") == rows[0].mem_id).collect()} == {0.0}
    assert {r.tau for r in freed.where(F.col("mem_id").isin(two)).collect()} == {50.0}


def test_query_entities_prefer_long_names(spark):
    state = cut(_memory(spark, ["we visited New York City with Ann", "they like New York today", "old York walls"]))
    got = {r.entity for r in rc.query_entities(_ask(spark, "did ann see New York City?"), en.entity_mentions(state)).collect()}
    assert "new york city" in got and "ann" in got and "new" not in got


def test_rate_limit_equals_replay(spark):
    rnd = np.random.default_rng(3)
    t = np.cumsum(rnd.integers(0, 40, 400)).astype(float) + 86300
    rows = [("k%d" % (i % 2), i, float(x)) for i, x in enumerate(t)]
    calls = spark.createDataFrame(rows, "key string, request_id bigint, s double").select("key", "request_id", F.timestamp_micros((F.col("s") * 1e6).cast("bigint")).alias("ts"))
    got = {r.request_id: r.allowed for r in mt.rate_limit(calls, 3, 120).collect()}
    held = {}
    for k, i, s in rows:
        q = [x for x in held.get(k, []) if x > s - 120]
        ok = len(q) < 3
        held[k] = q + [s] if ok else q
        assert got[i] == ok, i


def test_overage_rates(spark):
    rows = [("pro", 50000, "k"), ("pro", 50001, "k"), ("free", 99999, "k"), ("gold", 99999, "k"), ("pro", 60000, None), ("business", 200001, "k")]
    d = spark.createDataFrame(rows, "tier string, ops bigint, api_key_id string")
    assert [r.unit_cents for r in mt.unit_cost(d).collect()] == [0, 2, 0, 0, 0, 1]


def test_reconcile_thresholds(spark):
    e = spark.createDataFrame([("a", 10), ("b", 100), ("c", 100), ("e", 9)], "billing_subject string, quantity int").withColumn("occurred_at", F.lit("2024-01-05").cast("timestamp"))
    c = spark.createDataFrame([("a", 10), ("b", 95), ("c", 94), ("d", 7)], "billing_subject string, counted int")
    assert {r.billing_subject for r in mt.reconcile(c, e, "2024-01").collect()} == {"c", "d", "e"}


def test_schema_candidates_join_groups_not_rows(spark):
    items = spark.createDataFrame(
        [("n", f"m{i:02d}", i, 1.0 if i % 9 else 0.0, ["all"] + [t for t, k in (("two", 2), ("three", 3), ("six", 6), ("trio", 3), ("last", 29)) if i % k == 0]) for i in range(60)],
        "namespace string, mem_id string, seq int, strength double, tokens array<string>",
    )
    weights = spark.createDataFrame([("n", t, x) for t, x in (("all", 0.5), ("two", 1.0), ("three", 1.2), ("trio", 1.2), ("six", 2.0), ("last", 3.0))], "namespace string, token string, idf double")
    mentions = spark.createDataFrame([("n", f"m{i:02d}", i, "bob") for i in range(0, 60, 7)], "namespace string, mem_id string, seq int, entity string")
    found = sc.schema_candidates(items, mentions, weights, max_group=4)
    got = {}
    for r in found.collect():
        got.setdefault(r.group_id, []).append(r.seq)
    alive = [i for i in range(60) if i % 9]
    want = {f"t:{t}": [i for i in alive if i % k == 0][:4] for t, k in (("two", 2), ("three", 3), ("six", 6))}
    want["e:bob"] = [i for i in alive if i % 7 == 0][:4]
    assert {k: sorted(v) for k, v in got.items()} == want
    assert "idf" not in found._jdf.queryExecution().optimizedPlan().toString()  # rows never meet the weights
