"""Session recall reads whole prompts of whole sessions."""

import tempfile

import numpy as np
from pyspark.sql import functions as F

from recallflow.operators import sessions as ss
from recallflow.streaming import streams as sm

TAIL = "filler " * 400 + "zebra"  # the only match stands behind character 2,000
PROMPT = "namespace string, session_id string, sequence_num int, role string, created_at timestamp, content string"


def _prompts(spark, rows):
    df = spark.createDataFrame([("n", s, k, "user", at, t) for s, k, at, t in rows], PROMPT.replace("timestamp", "string"))
    return df.withColumn("created_at", F.col("created_at").cast("timestamp"))


def _recall(spark, prompts, **k):
    asks = spark.createDataFrame([("q", "n", "a", "zebra")], "query_id string, namespace string, session_id string, text string")
    idf = spark.createDataFrame([("n", "zebra", 3.0)], "namespace string, token string, idf double")
    coupling = spark.createDataFrame([("n", "a", "b", 1.0)], "namespace string, session_a string, session_b string, coupling double")
    found = ss.cross_session_recall(asks, prompts, idf, coupling, "2024-01-01 01:00:00", k_critical=0.5, **k)
    return [r.sequence_num for r in found.collect()]


def test_match_behind_the_first_2000_characters(spark):
    assert _recall(spark, _prompts(spark, [("b", 1, "2024-01-01 00:59:00", TAIL)])) == [1]


def test_ring_is_an_argument_without_limit_by_default(spark):
    later = [("b", k, f"2024-01-01 00:59:{k % 60:02d}", "filler") for k in range(2, 56)]
    prompts = _prompts(spark, [("b", 1, "2024-01-01 00:59:00", "zebra"), *later])
    assert _recall(spark, prompts) == [1] and _recall(spark, prompts, ring=50) == []
    assert ss.active_sessions(prompts, "2024-01-01 01:00:00").count() == 55


def test_ingested_topics_and_facts_of_whole_prompts(spark):
    prompts = _prompts(spark, [("b", 1, "2024-01-01 00:59:00", TAIL)])
    path, out, mark = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") for _ in range(3))
    prompts.write.mode("overwrite").parquet(path)
    stream = spark.readStream.schema(prompts.schema).parquet(path)
    sm.ingest_prompts(stream, out, mark, availableNow=True).awaitTermination(120)
    topics = spark.read.parquet(f"{out}/topics")
    assert "zebra" in [r.token for r in topics.collect()]
    facts = spark.read.parquet(f"{out}/facts")
    assert any("zebra" in str(r) for r in facts.collect())


def test_coupling_over_blocks_equals_the_plain_sum(spark, monkeypatch):
    monkeypatch.setattr(ss, "BLOCK", 4)
    rows = [("n", f"s{i}", f"t{(i * k) % 11}", 0.1 + (i * k % 7)) for i in range(15) for k in range(1, 6)]
    spectrum = spark.createDataFrame(sorted({r[:3]: r for r in rows}.values()), "namespace string, session_id string, token string, weight double")
    held = {}
    for r in ss._scaled(spectrum).collect():
        held.setdefault(r.session_id, {})[r.token] = r.v
    want = {}
    for a in held:
        for b in held:
            both = held[a].keys() & held[b].keys()
            if a < b and both:
                m = sum(x * x for x in held[a].values()) * sum(x * x for x in held[b].values())
                want[a, b] = round(sum(min(held[a][t], held[b][t]) ** 2 for t in both) / m**0.5, 9)
    got = [((r.session_a, r.session_b), round(r.coupling, 9)) for r in ss.session_coupling(spectrum).collect()]
    assert len(got) == len(want) and dict(got) == want
    some = spectrum.where("session_id = 's3'")
    asked = {(r.session_a, r.session_b): round(r.coupling, 9) for r in ss.session_coupling(spectrum, some).collect()}
    assert asked == {("s3", a if b == "s3" else b): k for (a, b), k in want.items() if "s3" in (a, b)}
    assert {(r.session_a, r.session_b) for r in ss.coupled_sessions(spectrum, 0.2).collect()} == {p for p, k in want.items() if k >= 0.2}


def test_coupling_among_some_sessions(spark):
    rnd = np.random.default_rng(6)
    rows = [("n", f"s{i:02d}", f"t{j}", float(rnd.random())) for i in range(30) for j in rnd.choice(20, 5, replace=False)]
    spectrum = spark.createDataFrame(rows, "namespace string, session_id string, token string, weight double")
    ask = spectrum.where("session_id < 's12'").select("namespace", "session_id")
    among = spectrum.where("session_id > 's08'").select("namespace", "session_id")
    every = {(r.session_a, r.session_b): round(r.coupling, 9) for r in ss.session_coupling(spectrum, ask).collect()}
    some = {(r.session_a, r.session_b): round(r.coupling, 9) for r in ss.session_coupling(spectrum, ask, 0.1, among).collect()}
    assert some == {p: k for p, k in every.items() if p[1] > "s08" and k >= 0.1} and len(some) < len(every)
