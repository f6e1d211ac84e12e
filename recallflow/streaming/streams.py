"""Streaming forms of ingest, topics, limits and live reports.

Every function takes a streaming DataFrame and returns one (the caller picks sink and
checkpoint), except the two ingest jobs, which fan one input out to several tables.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from recallflow.functions import lexicon as lx
from recallflow.functions import text as tx
from recallflow.operators.metering import _admit, lookup
from recallflow.operators.sessions import FLOOR, STALE, TAU_TOPIC
from recallflow.operators.strength import derive_facts
from recallflow.sources import store as so


def unique_usage(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """First event per idempotency key; the re-issue window bounds the key state."""
    return events.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["idempotency_key"])


def ingest_usage(events: DataFrame, valid_path: str, dead_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Validate, de-duplicate and append usage events; refused rows become dead letters.

    Files are written under the batch id, so a replayed batch overwrites its own output.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        good, dead = so.validate_usage_events(batch)
        good.write.mode("overwrite").parquet(f"{valid_path}/batch={batch_id}")
        dead.write.mode("overwrite").parquet(f"{dead_path}/batch={batch_id}")

    return (
        unique_usage(events).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "30 seconds"})).start()
    )


def ingest_prompts(prompts: DataFrame, path: str, checkpoint: str, delay: str = "1 day", **trigger) -> StreamingQuery:
    """One pass over a prompt stream into three tables: archive, facts and topic tokens."""
    p = prompts.where(F.trim("content") != "").withColumn("content_hash", F.sha2("content", 256))
    unique = p.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["content_hash", "session_id"])

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/archive/batch={batch_id}")
        users = batch.where((F.col("role") == "user") & (F.length(F.trim("content")) >= 10)).select(
            "namespace", "session_id", "created_at", F.trim("content").alias("text")
        )
        derive_facts(users).write.mode("overwrite").parquet(f"{path}/facts/batch={batch_id}")
        batch.select(
            "namespace", "session_id", "sequence_num", "created_at",
            F.explode(tx.token_set(F.col("content"))).alias("token"),
        ).write.mode("overwrite").parquet(f"{path}/topics/batch={batch_id}")

    return (
        unique.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "30 seconds"})).start()
    )


def session_topics(prompts: DataFrame, idf: DataFrame) -> DataFrame:
    """Decayed topic spectrum per session as keyed state, emitted after every update.

    ``idf`` (namespace, token, idf) is a static table. State is the current spectrum: a
    token leaves it once its weight falls under the floor, and the whole session after two
    idle hours.
    """
    tokens = prompts.select(
        "namespace", "session_id", "sequence_num", "created_at",
        F.explode_outer(tx.token_set(F.col("content"))).alias("token"),
    ).where("token IS NOT NULL").join(idf.select("namespace", "token", "idf"), ["namespace", "token"])
    keyed = tokens.withWatermark("created_at", "2 hours")
    fade = math.exp(-1.0 / TAU_TOPIC)

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        spectrum, n = (json.loads(state.get[0]), state.get[1]) if state.exists else ({}, 0)
        rows = pd.concat(list(batches)).sort_values(["created_at", "sequence_num"])
        for _, prompt in rows.groupby(["created_at", "sequence_num"], sort=True):
            for token, idf_value in zip(prompt["token"], prompt["idf"]):
                spectrum[token] = spectrum.get(token, 0.0) + idf_value
            spectrum = {t: w * fade for t, w in spectrum.items() if w * fade >= FLOOR}
            n += 1
        state.update((json.dumps(spectrum), n))
        state.setTimeoutTimestamp(max(int(rows["created_at"].max().timestamp() * 1000) + STALE * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(
            {"namespace": key[0], "session_id": key[1], "token": list(spectrum), "weight": list(spectrum.values()), "prompts": n}
        )

    return keyed.groupBy("namespace", "session_id").applyInPandasWithState(
        update, "namespace string, session_id string, token string, weight double, prompts int", "spectrum string, prompts int",
        "update", "EventTimeTimeout",
    )


def rate_limit(calls: DataFrame, limit: int = 100, seconds: int = 60) -> DataFrame:
    """Sliding-window admission per key; state holds at most ``limit`` accepted times."""
    admit = _admit(limit, seconds)

    def decide(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        for pdf in batches:
            pdf = pdf.sort_values(["ts", "request_id"])
            ok, held = admit([t.timestamp() for t in pdf["ts"]], held)
            yield pd.DataFrame({"key": key[0], "request_id": pdf["request_id"], "ts": pdf["ts"], "allowed": ok})
        state.update((json.dumps(held),))

    return calls.groupBy("key").applyInPandasWithState(
        decide, "key string, request_id bigint, ts timestamp, allowed boolean", "held string", "append", "NoTimeout"
    )


def working_buffer(items: DataFrame, n: int = 1000, ttl: int = 300) -> DataFrame:
    """Newest items per namespace as state of at most ``n`` entries with an age limit."""

    def keep(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        for pdf in batches:
            held += [[t.timestamp(), i, c] for t, i, c in zip(pdf["ts"], pdf["mem_id"], pdf["confidence"])]
            held = sorted(held, reverse=True)[:n]
        held = [h for h in held if h[0] > held[0][0] - ttl] if held else held
        state.update((json.dumps(held),))
        yield pd.DataFrame(
            {"namespace": key[0], "mem_id": [h[1] for h in held], "confidence": [h[2] for h in held], "rank": range(1, len(held) + 1)}
        )

    return items.select("namespace", "mem_id", "ts", "confidence").groupBy("namespace").applyInPandasWithState(
        keep, "namespace string, mem_id string, confidence double, rank int", "held string", "update", "NoTimeout"
    )


def health_minutes(requests: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """Volume, errors and latency percentiles per minute."""
    s = F.col("status_code")
    return (
        requests.withWatermark("ts", delay).groupBy(F.window("ts", "1 minute"))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count(F.when((s >= 400) & (s < 500), 1)).alias("errors_4xx"),
            F.count(F.when(s >= 500, 1)).alias("errors_5xx"),
            F.approx_percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), 10000).alias("latency"),
        )
        .select(F.col("window.start").alias("minute"), "requests", "errors_4xx", "errors_5xx", "latency")
    )


def active_users(events: DataFrame, actor: str = "user_id", at: str = "ts", delay: str = "5 minutes") -> DataFrame:
    """Distinct actors over the last fifteen minutes, every minute."""
    return (
        events.withWatermark(at, delay).groupBy(F.window(at, "15 minutes", "1 minute"))
        .agg(F.approx_count_distinct(actor).alias("active"))
        .select(F.col("window.end").alias("as_of"), "active")
    )


def abuse_sessions(signals: DataFrame, rules: dict | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counters refreshed by every hit, as session windows whose gap depends on the signal.

    ``signals`` has (identity, signal, ts). A session at its threshold is a block.
    """
    rules = rules or lx.ABUSE_RULES
    gap = F.concat(lookup({n: w for n, (_, w) in rules.items()}, F.col("signal")).cast("string"), F.lit(" seconds"))
    limit = lookup({n: t for n, (t, _) in rules.items()}, F.col("signal"))
    return (
        signals.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "identity", "signal")
        .agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= limit)
        .select("identity", "signal", "hits", F.col("session_window.start").alias("since"))
    )
