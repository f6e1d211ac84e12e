"""Exact limits and figures of metering."""

import datetime as dt

from pyspark.sql import functions as F

from recallflow.operators import metering as mt


def test_calls_that_share_moment_and_id(spark):
    # Every moment holds two calls of one id, every second moment follows a long pause.
    start = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    at = [start + 3000 * (i // 2) + 100 * (i % 2) for i in range(200) for _ in (0, 1)]
    calls = spark.createDataFrame([("k", t, t) for t in at], "key string, request_id bigint, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    held, want = [], []
    for t in at:
        held = [x for x in held if x > t - 1200]
        want.append((t, len(held) < 2))
        held += [t] if len(held) < 2 else []
    # Dealt differently, the rows of a tie come in another order.
    for n in (1, 7):
        got = mt.rate_limit(calls.repartition(n), 2, 1200).collect()
        assert sorted((r.request_id, r.allowed) for r in got) == sorted(want)


def test_percent_is_rounded_by_the_exact_value(spark):
    rows = [(n, round(a / b, 6)) for n, (a, b) in enumerate((a, b) for b in range(100, 180) for a in range(1, 40))] + [(-1, 1.0), (-2, 0.00125), (-3, 0.00375)]
    f = spark.createDataFrame(rows, "billing_subject int, drift_pct double").selectExpr(
        "cast(billing_subject as string) billing_subject", "'p' period", "1L counted", "2L logged", "1L drift", "drift_pct")
    said = {r.error_message for r in mt.findings_to_dead_letter(f, "2024-01-01 00:00:00").collect()}
    assert said == {"period=p subject=%s counter=1 log=2 drift=1 (%.3f%%)" % (n, x * 100) for n, x in rows}


def test_a_long_burst_is_decided_in_one_piece(spark):
    start = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    at = [start + 60 * i for i in range(400)]
    held, want = [], []
    for t in at:
        held = [x for x in held if x > t - 1200]
        want.append((t, len(held) < 2))
        held += [t] if len(held) < 2 else []
    calls = spark.createDataFrame([("k", t, t) for t in at], "key string, request_id bigint, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = mt.rate_limit(calls.repartition(8, "request_id"), 2, 1200)
        # Without a shuffle of its own after the join, a skewed or broadcast join cuts the burst.
        assert "REPARTITION_BY_COL" in got._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.request_id, r.allowed) for r in got.collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
