"""Streaming operators end at the same tables as their batch forms."""

import tempfile

from pyspark.sql import functions as F

from recallflow.operators import metering as mt
from recallflow.operators import sessions as ss
from recallflow.plans.queries_sessions import _idf
from recallflow.session import cut
from recallflow.sources import adapters as ad
from recallflow.streaming import streams as sm


def _folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def _stream(spark, df, parts=3):
    path = _folder()
    df.coalesce(1).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drain(stream, mode, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", _folder()).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return stream.sparkSession.table(name)


def test_usage_ingest_drops_replays_and_refuses_bad_rows(spark, sf):
    raw = ad.usage_raw(spark, sf)
    twice = raw.unionByName(raw.where("quantity > 2"))
    good, dead = _folder(), _folder()
    q = sm.ingest_usage(_stream(spark, twice), good, dead, _folder(), availableNow=True)
    q.awaitTermination(240)
    assert spark.read.parquet(good).count() == ad.usage_events(spark, sf).count()
    assert spark.read.parquet(dead).count() == raw.count() - ad.usage_events(spark, sf).count()


def test_prompt_ingest_fans_out(spark, sf):
    log = ad.prompt_log(spark, sf)
    out = _folder()
    q = sm.ingest_prompts(_stream(spark, log), out, _folder(), availableNow=True)
    q.awaitTermination(240)
    want = log.select("session_id", F.sha2("content", 256)).distinct().count()
    assert spark.read.parquet(f"{out}/archive").count() == want
    facts = spark.read.parquet(f"{out}/facts")
    assert facts.count() > 0 and "subject" in facts.columns
    assert spark.read.parquet(f"{out}/topics").count() > 0


def test_session_topics_match_batch(spark, sf):
    log = ad.prompt_log(spark, sf).where("sequence_num < 3")
    idf = cut(_idf(spark, sf))
    live = _drain(sm.session_topics(_stream(spark, log), idf), "update", "topics")
    got = {(r.session_id, r.token): r.weight for r in live.collect()}
    want = {(r.session_id, r.token): r.weight for r in ss.topic_spectrum(log, idf).collect()}
    assert want and set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_rate_limit_matches_batch(spark, sf):
    calls = ad.table(spark, sf, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("request_id"), "ts")
    live = _drain(sm.rate_limit(_stream(spark, calls), 2, 20000), "append", "limits")
    got = {r.request_id: r.allowed for r in live.collect()}
    want = {r.request_id: r.allowed for r in mt.rate_limit(calls, 2, 20000).collect()}
    assert got == want and False in want.values() and True in want.values()


def test_health_and_active_users(spark, sf):
    req = ad.requests(spark, sf)
    live = _drain(sm.health_minutes(_stream(spark, req)), "complete", "health")
    assert live.agg(F.sum("requests")).first()[0] == req.count()
    act = _drain(sm.active_users(_stream(spark, ad.table(spark, sf, "events"))), "complete", "active")
    assert act.agg(F.max("active")).first()[0] >= 1


def test_abuse_sessions(spark, sf):
    sig = ad.requests(spark, sf).select(F.col("ip").alias("identity"), F.lit("burst").alias("signal"), "ts")
    live = _drain(sm.abuse_sessions(_stream(spark, sig), {"burst": (2, 36000)}), "append", "abuse")
    assert all(r.hits >= 2 for r in live.collect())


def test_working_buffer_keeps_newest(spark, sf):
    m = ad.memories(spark, sf)
    live = _drain(sm.working_buffer(_stream(spark, m), n=5, ttl=36000), "update", "buffer")
    top = live.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))
    assert all(r.n <= 5 for r in top.collect())
