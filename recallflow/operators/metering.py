"""Metering, quotas, billing decisions and reconciliation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallflow.functions import lexicon as lx
from recallflow.operators.scans import running_sum
from recallflow.session import stored


def lookup(values: dict, key: Column, default=None) -> Column:
    """Small fixed table as a literal map: no join, no shuffle."""
    entries: list[Column] = []
    for k, v in values.items():
        entries += [F.lit(k), F.lit(v)]
    found = F.try_element_at(F.create_map(*entries), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def period_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def running_ops(events: DataFrame) -> DataFrame:
    """Operations per subject and month up to and including each event."""
    e = events.withColumn("period", period_of(F.col("occurred_at")))
    return running_sum(
        e,
        ["billing_subject", "period"],
        ["occurred_at", "idempotency_key"],
        F.date_trunc("hour", "occurred_at"),
        {"ops": F.lit(1)},
    )


def unit_cost(events: DataFrame, rates: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """Cents per operation beyond the flat cap; ``events`` has tier, ops, event_type and
    api_key_id.

    ``rates`` is {tier: {event_type: cents, "_default": cents}}; a type that is not listed
    costs the tier's ``_default``, an unknown tier nothing. Default: one rate per tier.
    """
    rates = rates if rates is not None else {t: {"_default": c} for t, c in lx.OVERAGE_CENTS.items()}
    cap = lookup(lx.TIER_CAPS, F.col("tier"))
    exact = {f"{t}|{e}": c for t, by in rates.items() for e, c in by.items() if e != "_default"}
    rate = lookup({t: by.get("_default", 0) for t, by in rates.items()}, F.col("tier"), 0)
    if exact:
        rate = F.coalesce(lookup(exact, F.concat_ws("|", "tier", "event_type")), rate)
    priced = (
        F.when(F.col("api_key_id").isNull() | cap.isNull(), 0)
        .when((cap <= 0) | (F.col("ops") <= cap), 0)
        .otherwise(rate)
    )
    return events.withColumn("unit_cents", priced)


def tier_of_key(credentials: DataFrame, integrations: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """Owner, tier and trial end per usable key."""
    now = F.lit(as_of).cast("timestamp")
    usable = credentials.where(
        F.col("status").isin("active", "rotated")
        & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
        & ((F.col("status") == "active") | (F.col("grace_until") > now))
    ).select("key_hash", "integration_id")
    open_integrations = integrations.where("status <> 'deleted'").select(
        F.col("id").alias("integration_id"), "namespace", "owner_email"
    )
    owners = users.select(F.col("email").alias("owner_email"), "tier", "subscription_expires_at")
    return (
        usable.join(open_integrations, "integration_id")
        .join(owners, "owner_email", "left")
        .select("key_hash", "namespace", "owner_email", "tier", "subscription_expires_at")
    )


def effective_cap(tier: Column, expires_at: Column, as_of: str) -> Column:
    now = F.lit(as_of).cast("timestamp")
    free = F.when(expires_at > now, lx.FREE_LAUNCH_CAP).otherwise(lx.FREE_POST_TRIAL_CAP)
    return F.when(tier == "free", free).otherwise(lookup(lx.TIER_CAPS, tier))


_WRITES = ("write", "encode")
_READS = ("read", "retrieve", "knowledge")


def _kind_sum(kinds: tuple[str, ...]) -> Column:
    return F.coalesce(
        F.sum(F.when(F.col("event_type").isin(*kinds), F.col("quantity"))), F.lit(0)
    ).cast("bigint")


def quota_status(events: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """Current month per user: use, split, limits, and whether one more call is allowed."""
    month = F.date_trunc("month", F.lit(as_of).cast("timestamp"))
    used = (
        events.where((F.col("occurred_at") >= month) & (F.col("occurred_at") <= F.lit(as_of).cast("timestamp")))
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("operations"), _kind_sum(_WRITES).alias("writes"), _kind_sum(_READS).alias("reads"))
    )
    cap = effective_cap(F.col("tier"), F.col("subscription_expires_at"), as_of)
    t = F.col("tier")
    return users.join(used, F.col("id") == F.col("user_id"), "left").select(
        "id",
        "tier",
        F.lit(as_of[:7]).alias("period"),
        F.coalesce("operations", F.lit(0)).alias("operations"),
        cap.alias("operations_limit"),
        F.coalesce("writes", F.lit(0)).alias("writes"),
        F.coalesce("reads", F.lit(0)).alias("reads"),
        lookup(lx.TIER_NAMESPACES, t).alias("namespaces_limit"),
        lookup(lx.TIER_ITEMS, t).alias("storage_limit"),
        lookup(lx.TIER_RATE_LIMITS, t).alias("rate_limit"),
        (F.coalesce("operations", F.lit(0)) < cap).alias("allowed"),
    )


def window_usage(events: DataFrame, as_of: str, caps: dict[str, int] | None = None) -> DataFrame:
    """Counts in the current calendar hour, day, ISO week and month per subject, with the
    shortest window at its cap. A negative cap means unlimited."""
    caps = caps or lx.WINDOW_CAPS
    now = F.lit(as_of).cast("timestamp")
    at = F.col("occurred_at")
    starts = {w: F.date_trunc(w, now) for w in lx.WINDOW_SECONDS}
    # The month or the week reaches back furthest; this bound prunes the scan.
    recent = events.where((at >= F.least(starts["week"], starts["month"])) & (at <= now))
    used = recent.groupBy("billing_subject").agg(
        *[F.sum((at >= starts[w]).cast("bigint")).alias(f"used_{w}") for w in lx.WINDOW_SECONDS]
    )
    breach = F.coalesce(
        *[F.when(F.col(f"used_{w}") >= caps[w], w) for w in lx.WINDOW_SECONDS if caps[w] >= 0]
    )
    return used.withColumn("breached", breach).withColumn(
        "retry_after",
        F.when(F.col("breached").isNotNull(), lookup(lx.WINDOW_SECONDS, F.col("breached"))),
    )


def _admit(limit: int, span: int):
    """Sliding window of accepted calls, carried from chunk to chunk of one key."""

    def run(times: list[int], state: list[int]) -> tuple[list[bool], list[int]]:
        held = list(state)
        out = []
        for t in times:
            while held and held[0] <= t - span:
                held.pop(0)
            ok = len(held) < limit
            if ok:
                held.append(t)
            out.append(ok)
        return out, held

    return run


def rate_limit(events: DataFrame, limit: int = 100, seconds: int = 60) -> DataFrame:
    """Decision of a sliding-window limiter per call; rejected calls are not counted.

    A call can only be affected by calls within ``seconds`` before it, so a pause longer
    than the window resets the limiter. Keys are therefore cut at such pauses, and most
    bursts are admitted without Python: a burst with at most ``limit`` calls accepts all.
    Only larger bursts run the recursion, one burst per group, in arrival-ordered batches.
    """
    from pyspark.sql import Window as W

    span = int(seconds * 1_000_000)
    base = events.withColumn("_t", F.unix_micros("ts")).withColumn("_h", F.floor(F.col("_t") / 86_400_000_000))
    # Bursts are sets of moments: calls of one moment and id must not fall into two of them.
    moments = base.select("key", "_h", "_t").distinct()
    by_key = W.partitionBy("key", "_h").orderBy("_t")
    # Pauses are found per day bucket; the first call of a day compares with the last call
    # of the day before, taken from one small row per (key, day).
    days = moments.groupBy("key", "_h").agg(F.max("_t").alias("_last"))
    prev = days.withColumn(
        "_prev", F.lag("_last").over(W.partitionBy("key").orderBy("_h"))
    ).drop("_last")
    gap = F.col("_t") - F.coalesce(F.lag("_t").over(by_key), F.col("_prev"))
    marked = moments.join(prev, ["key", "_h"]).withColumn(
        "_new", F.when(gap.isNull() | (gap >= span), 1).otherwise(0)
    )
    bursts = running_sum(marked.drop("_prev"), ["key"], ["_t"], F.col("_h"), {"burst": F.col("_new")})
    runs = stored(base.join(bursts.select("key", "_t", "burst"), ["key", "_t"]))
    sizes = runs.groupBy("key", "burst").agg(F.count(F.lit(1)).alias("_n"))
    sized = runs.join(sizes, ["key", "burst"])
    calm = sized.where(F.col("_n") <= limit).select("key", "request_id", "ts", F.lit(True).alias("allowed"))
    admit = _admit(limit, span)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, []
        for pdf in batches:
            out: list[bool] = []
            for burst, rows in pdf.groupby(["key", "burst"], sort=False):
                if burst != current:
                    current, held = burst, []
                ok, held = admit(rows["_t"].tolist(), held)
                out += ok
            yield pd.DataFrame(
                {"key": pdf["key"], "request_id": pdf["request_id"], "ts": pdf["ts"], "allowed": out}
            )

    # Bursts arrive whole and in time order inside a partition and are read as a stream of
    # small batches, so neither many bursts nor a long one needs memory. They are dealt by a
    # hash of their own: dealt by the keys of the join above, the shuffle would be taken for
    # a repetition and left out, and a join read where it lies cuts bursts apart.
    key_type = dict(events.dtypes)["key"]
    busy = (
        sized.where(F.col("_n") > limit)
        .select("key", "burst", "request_id", "ts", "_t")
        .withColumn("_g", F.xxhash64("key", "burst"))
        .repartition("_g")
        .sortWithinPartitions("key", "burst", "_t", "request_id")
        .mapInPandas(decide, f"key {key_type}, request_id bigint, ts timestamp, allowed boolean")
    )
    return calm.unionByName(busy)


def offered_load(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Calls of the same key in the trailing window, admitted or not."""
    from pyspark.sql import Window as W

    sec = F.unix_seconds("ts")
    # Each call also joins the next time slot, so a slot holds everything its calls look
    # back at and no window spans a whole key.
    slot = F.floor(sec / seconds)
    both = events.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_echo")).withColumn(
        "_slot", slot + F.col("_echo")
    )
    w = W.partitionBy("key", "_slot").orderBy(sec).rangeBetween(-(seconds - 1), 0)
    return both.withColumn("offered", F.count(F.lit(1)).over(w)).where("_echo = 0").drop("_echo", "_slot")


def month_spine(as_of: str, months: int) -> Column:
    end = F.date_trunc("month", F.lit(as_of).cast("timestamp")).cast("date")
    return F.transform(
        F.sequence(F.lit(0), F.lit(months - 1)),
        lambda i: F.date_format(F.add_months(end, i - (months - 1)), "yyyy-MM"),
    )


def usage_history(events: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """Dense months per subject: operations, writes, reads."""
    start = F.add_months(F.date_trunc("month", F.lit(as_of).cast("timestamp")).cast("date"), -(months - 1))
    recent = events.where(F.col("occurred_at") >= start.cast("timestamp"))
    sums = recent.groupBy("billing_subject", period_of(F.col("occurred_at")).alias("period")).agg(
        F.sum("quantity").alias("operations"), _kind_sum(_WRITES).alias("writes"), _kind_sum(_READS).alias("reads")
    )
    spine = sums.select("billing_subject").distinct().select(
        "billing_subject", F.explode(month_spine(as_of, months)).alias("period")
    )
    return spine.join(sums, ["billing_subject", "period"], "left").fillna(0, ["operations", "writes", "reads"])


def _in_period(events: DataFrame, period: str) -> DataFrame:
    start = F.lit(f"{period}-01").cast("date")
    at = F.col("occurred_at")
    return events.where((at >= start.cast("timestamp")) & (at < F.add_months(start, 1).cast("timestamp")))


def overage(events: DataFrame, period: str) -> DataFrame:
    """Cents owed per user in a month."""
    e = _in_period(events, period).where(F.col("user_id").isNotNull() & (F.col("unit_cost_cents") > 0))
    cents = F.sum(F.col("unit_cost_cents").cast("bigint") * F.col("quantity"))
    return e.groupBy("user_id").agg(cents.alias("cents")).where("cents > 0")


def invoice_decisions(owed: DataFrame, billed: DataFrame, minimum: int = 50) -> DataFrame:
    """bill / skip decision per user; ``billed`` lists users already invoiced."""
    done = billed.select("user_id").distinct().withColumn("_done", F.lit(True))
    decision = (
        F.when(F.col("_done"), "already_billed")
        .when(F.col("cents") < minimum, "below_minimum")
        .otherwise("bill")
    )
    return owed.join(done, "user_id", "left").select("user_id", "cents", decision.alias("decision"))


def reconcile(counters: DataFrame, events: DataFrame, period: str, min_abs: int = 5, pct: float = 0.001) -> DataFrame:
    """Subjects whose counter and durable log disagree by more than both thresholds."""
    logged = (
        _in_period(events, period).where(F.coalesce("billing_subject", F.lit("")) != "")
        .groupBy("billing_subject").agg(F.sum("quantity").alias("logged"))
    )
    both = counters.select("billing_subject", "counted").join(logged, "billing_subject", "full_outer")
    c, l = F.coalesce("counted", F.lit(0)), F.coalesce("logged", F.lit(0))
    drift = F.abs(c - l)
    share = drift / F.greatest(c, l, F.lit(1))
    return both.select(
        "billing_subject", F.lit(period).alias("period"), c.alias("counted"), l.alias("logged"),
        drift.alias("drift"), F.round(share, 6).alias("drift_pct"), share.alias("_share"),
    ).where((F.col("drift") > min_abs) & (F.col("_share") > pct)).drop("_share")


def _three_places(x: Column) -> Column:
    """``x`` (not negative) printed with three decimals, rounded by the double's exact value.

    Java rounds the shortest decimal form of a double, C its exact value, which lies above or
    below the half it prints as. The fraction times 2**52 and what is left of it times 2**52
    again are whole numbers; in thousandths their sums fit a long.
    """
    unit = float(1 << 52)
    whole = F.floor(x)
    high = F.floor((x - whole) * unit)
    low = F.floor(((x - whole) * unit - high) * unit)
    # Thousandths of the fraction: 1000 * (high + low / 2**52) / 2**52.
    carry = F.shiftright(low * 1000, 52)
    left = (low * 1000).bitwiseAND(F.lit((1 << 52) - 1))
    total = high * 1000 + carry
    k = F.shiftright(total, 52)
    rest = total.bitwiseAND(F.lit((1 << 52) - 1))
    half = F.lit(1 << 51)
    up = (rest > half) | ((rest == half) & ((left > 0) | (k % 2 == 1)))
    n = whole * 1000 + k + up.cast("bigint")
    return F.format_string("%d.%03d", F.floor(n / 1000), n % 1000)


def findings_to_dead_letter(findings: DataFrame, failed_at: str) -> DataFrame:
    message = F.format_string(
        "period=%s subject=%s counter=%d log=%d drift=%d (%s%%)",
        "period", "billing_subject", "counted", "logged", "drift", _three_places(F.col("drift_pct") * 100),
    )
    return findings.select(
        F.lit(failed_at).cast("timestamp").alias("failed_at"),
        F.lit("ReconciliationDrift").alias("error_class"),
        F.substring(message, 1, 500).alias("error_message"),
        F.to_json(F.struct(*findings.columns)).alias("payload"),
        F.lit(None).cast("timestamp").alias("notified_at"),
    )


def dead_letter_digest(letters: DataFrame, batch: int = 50, shown: int = 10) -> DataFrame:
    """Oldest unnotified rows grouped by error class: count, first lines, overflow."""
    pick = letters.where("notified_at IS NULL").orderBy("failed_at", "error_message").limit(batch)
    line = F.struct("failed_at", F.substring("error_message", 1, 250).alias("message"))
    return pick.groupBy("error_class").agg(
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(line)).alias("lines")
    ).select(
        "error_class", "n",
        F.transform(F.slice("lines", 1, shown), lambda s: s["message"]).alias("messages"),
        F.greatest(F.col("n") - shown, F.lit(0)).alias("overflow"),
    )


def metering_checks(letters: DataFrame, findings: DataFrame, events: DataFrame, canary_key: str, as_of: str) -> DataFrame:
    """One row per data-quality check of the metering tables."""
    cutoff = F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 3 MINUTES")
    dead = letters.agg(
        F.count(F.when(F.col("notified_at").isNull() & (F.col("failed_at") < cutoff), 1)).alias("stuck"),
        F.count(F.when(F.col("failed_at") >= cutoff, 1)).alias("recent"),
    )
    rows = dead.select(
        F.lit("dead_letter.clean").alias("check"), (F.col("stuck") == 0).alias("ok"), F.col("stuck").alias("count")
    )
    rows = rows.unionByName(dead.select(
        F.lit("dead_letter.recent").alias("check"), F.lit(True).alias("ok"), F.col("recent").alias("count")
    ))
    rows = rows.unionByName(findings.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit("reconciler.drift").alias("check"), (F.col("count") == 0).alias("ok"), "count"
    ))
    canary = events.where(F.col("idempotency_key") == canary_key).agg(F.count(F.lit(1)).alias("count"))
    return rows.unionByName(canary.select(
        F.lit("writer.roundtrip").alias("check"), (F.col("count") == 1).alias("ok"), "count"
    ))


def cost_of(event_type: Column, quantity: Column) -> Column:
    return lookup(lx.UNIT_COSTS, event_type, 0.0) * quantity


def compute_cost(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Estimated infrastructure cost per key from (metric, count) rows."""
    return metrics.groupBy(*keys).agg(F.round(F.sum(cost_of(F.col("event_type"), F.col("quantity"))), 6).alias("cost"))


def monthly_snapshot(events: DataFrame, revenue: DataFrame) -> DataFrame:
    """One row per (user, period): operations by type, cost and revenue."""

    def n(*kinds: str) -> Column:
        return _kind_sum(kinds)

    use = events.where("user_id IS NOT NULL").groupBy("user_id", period_of(F.col("occurred_at")).alias("period")).agg(
        F.sum("quantity").alias("operations"),
        n("write").alias("writes"), n("encode").alias("encodes"), n("read").alias("reads"),
        n("search").alias("searches"), n("delete").alias("deletes"),
        F.round(F.sum(cost_of(F.col("event_type"), F.col("quantity"))), 6).alias("cost"),
    )
    income = revenue.groupBy("user_id", "period").agg((F.sum("amount_cents") / 100).alias("revenue"))
    return use.join(income, ["user_id", "period"], "left").withColumn("revenue", F.coalesce("revenue", F.lit(0.0)))
