import math
import re

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from recallflow.llm import mixing, queries, toxicity
from recallflow.llm.mixing import Target

TABLES = ("documents", "labels", "conversations", "embeddings")


def _duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    cur = _duck(sf).execute(queries.ORACLES[name])
    order = [d[0] for d in cur.description]
    flat = lambda rows: sorted(repr([round(v, 5) if isinstance(v, float) else v for v in r]) for r in rows)
    assert sorted(df.columns) == sorted(order)
    assert flat(tuple(r) for r in df.select(*order).collect()) == flat(cur.fetchall())


def test_mix_meets_entropy_and_limit(spark):
    rows = [(k, "w " * (1 + k % 3), s) for s, n in (("big", 300), ("mid", 60), ("small", 10), (None, 5)) for k in range(n)]
    rows = [(i, t, s) for i, (_, t, s) in enumerate(rows)] + [(9000, None, "empty"), (9001, "x", "big"), (9001, "x", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tokens = {}
    for _, t, s in rows:
        tokens[s] = tokens.get(s, 0) + len((t or "").split())
    for target in (Target(0.9, 3.0, block_tokens=16), Target(0.8, None, block_tokens=16), Target(None, 2.0, 1000, 16), Target(0.6, None, 200, 16)):
        found = mixing.mixed(df, target).collect()
        read, weight = {}, {}
        for r in found:
            read[r.source] = read.get(r.source, 0) + r.n_tokens
            weight[r.source] = r.weight
        live = [s for s in tokens if tokens[s]]
        if target.budget is None:
            assert {r.doc_id for r in found} == {r[0] for r in rows}  # nothing is lost
        else:
            assert sum(read.values()) <= target.budget + len(live)
        for s in live:
            times = read.get(s, 0) / tokens[s]
            assert target.repetition is None or times <= target.repetition + 1e-6
            if s in weight:
                amount = next(r.repetition for r in found if r.source == s) * tokens[s]
                assert -1 <= amount - read[s] <= 3  # short by less than one document
        if target.repetition is None and target.budget is None:
            entropy = -sum(w * math.log(w) for w in weight.values() if w)
            assert entropy >= target.entropy * math.log(len(live)) - 1e-6
        per = {}
        for r in found:
            per.setdefault((r.source, r.doc_id), []).append(r.epoch)
        assert all(sorted(e) == list(range(len(e))) for e in per.values())


def test_mix_odd_rows(odd, none):
    rows = mixing.mixed(odd).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, None}
    assert mixing.realised(odd).columns == odd.columns
    assert mixing.mixed(none).collect() == [] and mixing.realised(none).collect() == []


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Rows behind every stage, each written and read again."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs.collect())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("pipeline") / str(k))
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_pipeline_equals_brute_force(spark, sf, stages):
    first, clean, thin, single, mix, last = stages
    # toxicity: the model is given, its decisions are replayed one text at a time
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    w, b = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    keep = set()
    for r in first:
        _, ids = toxicity.sparse([r.text.lower().encode()])
        keep |= {r.doc_id} if 1 / (1 + math.exp(-(w.astype("float32")[ids].sum(dtype="float64") + b))) < 0.7 else set()
    assert {r.doc_id for r in clean} == keep
    # lines
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    seen = {}
    for r in clean:
        for k in {key(x) for x in r.text.split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if not key(x) or seen[key(x)] < 10) for r in clean}
    assert {r.doc_id: r.text for r in thin} == want and all(r.n_chars == len(r.text) for r in thin)
    # near copies: five-word Jaccard of 0.8 or more, all pairs compared
    grams = {}
    for i, t in want.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).encode().split()
        grams[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in grams}
    pairs = [(a, c) for a in grams for c in grams if a < c and 5 * len(grams[a] & grams[c]) >= 4 * len(grams[a] | grams[c])]
    for _ in range(len(pairs)):
        before = dict(label)
        for a, c in pairs:
            label[a] = label[c] = min(label[a], label[c])
        if before == label:
            break
    assert sorted(r.doc_id for r in single) == sorted({*label.values()}) and len(single) < len(thin)
    # the mix reads every document, none more than twice
    assert {r.doc_id for r in mix} == {r.doc_id for r in single}
    times = {}
    for r in mix:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 2
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sorted((r.doc_id, r.ids) for r in last) == sorted((r.doc_id, lib.encode(want[r.doc_id], add_special_tokens=False).ids) for r in mix)


def test_run_is_its_stages(spark, sf, stages):
    found = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in found) == sorted((r.doc_id, r.n_tokens) for r in stages[-1])


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, sf, odd, none, k):
    name, stage = corpus_pipeline.STAGES[k]
    if k == 0:
        sf = sf.replace("sf0.001", "sf0.01")
    for df in (odd, none):
        docs = df.selectExpr("*", "'xx' AS lang", "length(text) AS n_chars")
        rows = stage(spark, docs, sf).collect()
        if df is none:
            assert rows == []
        elif k in (1, 4):
            assert len(rows) == odd.count()
