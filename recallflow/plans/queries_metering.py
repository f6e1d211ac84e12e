"""Queries over metering and billing."""

from pyspark.sql import functions as F

from recallflow.functions import lexicon as lx
from recallflow.operators import metering as mt
from recallflow.plans import oracle as o
from recallflow.plans.registry import query
from recallflow.sources import adapters as ad

AS_OF = "2024-01-28 15:30:00"
_OPS = """ops AS (SELECT *, strftime(occurred_at, '%Y-%m') AS period, row_number() OVER (PARTITION BY billing_subject,
  strftime(occurred_at, '%Y-%m') ORDER BY occurred_at, idempotency_key) AS ops FROM usage_events)"""


@query("metering_running_ops", o.sql("usage_events", "SELECT idempotency_key, billing_subject, period, ops FROM ops", _OPS))
def metering_running_ops(spark, sf):
    return mt.running_ops(ad.usage_events(spark, sf)).select("idempotency_key", "billing_subject", "period", "ops")


@query(
    "metering_unit_cost",
    o.sql("usage_events users", """SELECT idempotency_key, tier, CASE WHEN tier IS NULL THEN 0 WHEN ops * 1000 > (CASE tier WHEN 'free' THEN 1000
      WHEN 'pro' THEN 50000 WHEN 'business' THEN 200000 ELSE 1000000 END) THEN (CASE tier WHEN 'pro' THEN CASE event_type WHEN 'encode' THEN 10 WHEN 'search' THEN 0 ELSE 5 END WHEN 'business' THEN CASE event_type WHEN 'read' THEN 3 ELSE 1 END
      WHEN 'free' THEN CASE event_type WHEN 'write' THEN 7 ELSE 0 END ELSE 0 END) ELSE 0 END AS unit_cents FROM ops LEFT JOIN users ON id = user_id""", _OPS),
)
def metering_unit_cost(spark, sf):
    tiers = ad.users(spark, sf).select(F.col("id").alias("user_id"), "tier")
    # Operation counts are scaled so that the small data set crosses the caps.
    ops = mt.running_ops(ad.usage_events(spark, sf)).join(tiers, "user_id", "left").withColumn("ops", F.col("ops") * 1000)
    rates = {"pro": {"_default": 5, "encode": 10, "search": 0}, "business": {"read": 3, "_default": 1}, "free": {"write": 7}}
    return mt.unit_cost(ops, rates).select("idempotency_key", "tier", "unit_cents")


_KEYS = """keys AS (SELECT c.key_hash, i.namespace, i.owner_email, u.tier, u.subscription_expires_at FROM api_credentials c
  JOIN integrations i ON i.id = c.integration_id LEFT JOIN users u ON u.email = i.owner_email
  WHERE c.status IN ('active', 'rotated') AND i.status <> 'deleted'
  AND (c.expires_at IS NULL OR c.expires_at > TIMESTAMP '2001-01-01') AND (c.status = 'active' OR c.grace_until > TIMESTAMP '2001-01-01'))"""


@query(
    "metering_tier_of_key",
    o.sql("api_credentials integrations users", """SELECT key_hash, namespace, owner_email, tier,
      strftime(subscription_expires_at, '%Y-%m-%d') AS expires FROM keys""", _KEYS),
)
def metering_tier_of_key(spark, sf):
    k = mt.tier_of_key(ad.api_credentials(spark, sf), ad.integrations(spark, sf), ad.users(spark, sf), "2001-01-01")
    return k.select("key_hash", "namespace", "owner_email", "tier", F.date_format("subscription_expires_at", "yyyy-MM-dd").alias("expires"))


_CAP = """CASE tier WHEN 'free' THEN (CASE WHEN subscription_expires_at > TIMESTAMP '{0}' THEN 8000 ELSE 800 END)
  WHEN 'pro' THEN 50000 WHEN 'business' THEN 200000 ELSE 1000000 END"""


@query("metering_effective_cap", o.sql("users", f"SELECT id, {_CAP.format('1996-06-01')} AS cap FROM users"))
def metering_effective_cap(spark, sf):
    u = ad.users(spark, sf)
    return u.select("id", mt.effective_cap(F.col("tier"), F.col("subscription_expires_at"), "1996-06-01").alias("cap"))


@query(
    "metering_quota_status",
    o.sql("usage_events users", f"""SELECT id, tier, '2024-01' AS period, coalesce(n, 0) AS operations, {_CAP.format(AS_OF)} AS operations_limit,
      coalesce(w, 0) AS writes, coalesce(r, 0) AS reads,
      CASE tier WHEN 'free' THEN 1 WHEN 'pro' THEN 10 WHEN 'business' THEN 50 ELSE 500 END AS namespaces_limit,
      CASE tier WHEN 'free' THEN 500 WHEN 'pro' THEN 50000 WHEN 'business' THEN 200000 ELSE 1000000 END AS storage_limit,
      CASE tier WHEN 'free' THEN 20 WHEN 'pro' THEN 100 WHEN 'business' THEN 1000 ELSE 5000 END AS rate_limit,
      coalesce(n, 0) < operations_limit AS allowed FROM users LEFT JOIN (SELECT user_id, count(*) AS n,
      CAST(coalesce(sum(quantity) FILTER (WHERE event_type IN ('write', 'encode')), 0) AS BIGINT) AS w,
      CAST(coalesce(sum(quantity) FILTER (WHERE event_type IN ('read', 'retrieve', 'knowledge')), 0) AS BIGINT) AS r
      FROM usage_events WHERE occurred_at >= TIMESTAMP '2024-01-01' AND occurred_at <= TIMESTAMP '{AS_OF}' GROUP BY 1) ON user_id = id"""),
)
def metering_quota_status(spark, sf):
    return mt.quota_status(ad.usage_events(spark, sf), ad.users(spark, sf), AS_OF)


_CAPS = {"hour": 1, "day": 3, "week": 12, "month": 40}


@query(
    "metering_window_usage",
    o.sql("usage_events", f"""SELECT *, CASE WHEN used_hour >= 1 THEN 'hour' WHEN used_day >= 3 THEN 'day' WHEN used_week >= 12 THEN 'week'
      WHEN used_month >= 40 THEN 'month' END AS breached, CASE WHEN used_hour >= 1 THEN 3600 WHEN used_day >= 3 THEN 86400
      WHEN used_week >= 12 THEN 604800 WHEN used_month >= 40 THEN 2592000 END AS retry_after FROM (SELECT billing_subject,
      {', '.join(f"count(*) FILTER (WHERE occurred_at >= date_trunc('{w}', TIMESTAMP '{AS_OF}')) AS used_{w}" for w in lx.WINDOW_SECONDS)}
      FROM usage_events WHERE occurred_at <= TIMESTAMP '{AS_OF}' GROUP BY 1)"""),
)
def metering_window_usage(spark, sf):
    return mt.window_usage(ad.usage_events(spark, sf), AS_OF, _CAPS)


def _calls(spark, sf):
    return ad.table(spark, sf, "events").select(
        F.col("event_type").alias("key"), F.col("event_id").alias("request_id"), "ts"
    )


@query("metering_rate_limit", """WITH RECURSIVE ca AS (SELECT event_type AS key, event_id AS request_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
w(key, request_id, i, held, allowed) AS (
  SELECT key, request_id, i, [t], true FROM ca WHERE i = 1
  UNION ALL SELECT ca.key, ca.request_id, ca.i, CASE WHEN len(list_filter(held, lambda x: x > t - 1200000000)) < 2
    THEN list_append(list_filter(held, lambda x: x > t - 1200000000), t) ELSE list_filter(held, lambda x: x > t - 1200000000) END,
    len(list_filter(held, lambda x: x > t - 1200000000)) < 2 FROM w JOIN ca ON ca.key = w.key AND ca.i = w.i + 1)
SELECT key, request_id, allowed FROM w""")
def metering_rate_limit(spark, sf):
    return mt.rate_limit(_calls(spark, sf), limit=2, seconds=1200).select("key", "request_id", "allowed")


@query(
    "metering_offered_load",
    """SELECT a.event_id AS request_id, count(*) AS offered FROM events a JOIN events b ON a.event_type = b.event_type
      AND epoch(date_trunc('second', b.ts)) BETWEEN epoch(date_trunc('second', a.ts)) - 599 AND epoch(date_trunc('second', a.ts)) GROUP BY 1""",
)
def metering_offered_load(spark, sf):
    return mt.offered_load(_calls(spark, sf), 600).select("request_id", "offered")


@query(
    "metering_usage_history",
    o.sql("usage_events", """SELECT billing_subject, period, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS operations,
      CAST(coalesce(sum(quantity) FILTER (WHERE event_type IN ('write', 'encode')), 0) AS BIGINT) AS writes,
      CAST(coalesce(sum(quantity) FILTER (WHERE event_type IN ('read', 'retrieve', 'knowledge')), 0) AS BIGINT) AS reads
      FROM (SELECT DISTINCT billing_subject FROM usage_events), (VALUES ('2023-09'), ('2023-10'), ('2023-11'), ('2023-12'), ('2024-01'), ('2024-02')) m(period)
      LEFT JOIN (SELECT billing_subject AS s, strftime(occurred_at, '%Y-%m') AS p, quantity, event_type FROM usage_events) ON s = billing_subject AND p = period
      GROUP BY 1, 2"""),
)
def metering_usage_history(spark, sf):
    return mt.usage_history(ad.usage_events(spark, sf), "2024-02-10 00:00:00", 6)


_OWED = """owed AS (SELECT user_id, CAST(sum(unit_cost_cents * quantity) AS BIGINT) AS cents FROM usage_events
  WHERE user_id IS NOT NULL AND unit_cost_cents > 0 AND occurred_at >= TIMESTAMP '2024-01-01' AND occurred_at < TIMESTAMP '2024-02-01'
  GROUP BY 1 HAVING sum(unit_cost_cents * quantity) > 0)"""


@query("metering_overage", o.sql("usage_events", "SELECT * FROM owed", _OWED))
def metering_overage(spark, sf):
    return mt.overage(ad.usage_events(spark, sf), "2024-01")


@query(
    "metering_invoice_decisions",
    o.sql("usage_events revenue_events", """SELECT user_id, cents, CASE WHEN user_id IN (SELECT user_id FROM revenue_events WHERE event_type = 'overage' AND period = '1998-03')
      THEN 'already_billed' WHEN cents < 250 THEN 'below_minimum' ELSE 'bill' END AS decision FROM owed""", _OWED),
)
def metering_invoice_decisions(spark, sf):
    billed = ad.revenue_events(spark, sf).where("event_type = 'overage' AND period = '1998-03'")
    return mt.invoice_decisions(mt.overage(ad.usage_events(spark, sf), "2024-01"), billed, minimum=250)


# Counters drop every 37th event and count two subjects the log does not know.
_COUNT = """counters AS (SELECT billing_subject, CAST(sum(quantity) AS BIGINT) AS counted FROM usage_events
  WHERE CAST(substr(idempotency_key, 2) AS BIGINT) % 37 <> 0 GROUP BY 1 UNION ALL
  SELECT 'owner:s' || s_suppkey, s_suppkey FROM supplier),
logged AS (SELECT billing_subject, CAST(sum(quantity) AS BIGINT) AS logged FROM usage_events
  WHERE occurred_at >= TIMESTAMP '2024-01-01' AND occurred_at < TIMESTAMP '2024-02-01' GROUP BY 1),
rec AS (SELECT billing_subject, '2024-01' AS period, coalesce(counted, 0) AS counted, coalesce(logged, 0) AS logged,
  abs(coalesce(counted, 0) - coalesce(logged, 0)) AS drift, round(drift / greatest(coalesce(counted, 0), coalesce(logged, 0), 1)::DOUBLE, 6) AS drift_pct
  FROM counters FULL JOIN logged USING (billing_subject)),
find AS (SELECT * FROM rec WHERE drift > 5 AND drift / greatest(counted, logged, 1)::DOUBLE > 0.001)"""


def _findings(spark, sf):
    e = ad.usage_events(spark, sf)
    counters = e.where(F.substring("idempotency_key", 2, 20).cast("bigint") % 37 != 0).groupBy("billing_subject").agg(
        F.sum("quantity").alias("counted")
    ).unionByName(
        ad.table(spark, sf, "supplier").select(
            F.concat(F.lit("owner:s"), F.col("s_suppkey").cast("string")).alias("billing_subject"),
            F.col("s_suppkey").alias("counted"),
        )
    )
    return mt.reconcile(counters, e, "2024-01")


@query("metering_reconcile", o.sql("usage_events", "SELECT * FROM find", _COUNT))
def metering_reconcile(spark, sf):
    return _findings(spark, sf)


@query(
    "metering_findings_to_dead_letter",
    o.sql("usage_events", """SELECT 'ReconciliationDrift' AS error_class, printf('period=%s subject=%s counter=%d log=%d drift=%d (%.3f%%)',
      period, billing_subject, counted, logged, drift, drift_pct * 100) AS error_message FROM find""", _COUNT),
)
def metering_findings_to_dead_letter(spark, sf):
    return mt.findings_to_dead_letter(_findings(spark, sf), AS_OF).select("error_class", "error_message")


def _letters(spark, sf):
    r = ad.requests(spark, sf).where("status_code >= 400")
    return r.select(
        F.col("ts").alias("failed_at"),
        F.concat(F.lit("Http"), F.col("status_code").cast("string")).alias("error_class"),
        F.concat(F.lit("request "), F.col("request_id").cast("string")).alias("error_message"),
        F.when(F.col("request_id") % 3 == 0, F.col("ts")).alias("notified_at"),
    )


_LET = """letters AS (SELECT ts AS failed_at, 'Http' || status_code AS error_class, 'request ' || request_id AS error_message,
  CASE WHEN request_id % 3 = 0 THEN ts END AS notified_at FROM requests WHERE status_code >= 400)"""


@query(
    "metering_dead_letter_digest",
    o.sql("requests", """SELECT error_class, count(*) AS n, array_to_string((list(error_message ORDER BY failed_at, error_message))[1:10], '|') AS messages,
      greatest(count(*) - 10, 0) AS overflow FROM (SELECT * FROM letters WHERE notified_at IS NULL ORDER BY failed_at, error_message LIMIT 50) GROUP BY 1""", _LET),
)
def metering_dead_letter_digest(spark, sf):
    return mt.dead_letter_digest(_letters(spark, sf)).withColumn("messages", F.array_join("messages", "|"))


@query(
    "metering_checks",
    o.sql("usage_events requests", f"""SELECT 'dead_letter.clean' AS "check", n = 0 AS ok, n AS count FROM (SELECT count(*) AS n FROM letters
      WHERE notified_at IS NULL AND failed_at < TIMESTAMP '{AS_OF}' - INTERVAL 3 MINUTE)
      UNION ALL SELECT 'dead_letter.recent', true, count(*) FROM letters WHERE failed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 3 MINUTE
      UNION ALL SELECT 'reconciler.drift', count(*) = 0, count(*) FROM find
      UNION ALL SELECT 'writer.roundtrip', count(*) = 1, count(*) FROM usage_events WHERE idempotency_key = 'e1'""", _LET, _COUNT),
)
def metering_checks(spark, sf):
    return mt.metering_checks(_letters(spark, sf), _findings(spark, sf), ad.usage_events(spark, sf), "e1", AS_OF)


_UC = "CASE event_type WHEN 'write' THEN 0.0001 WHEN 'encode' THEN 0.0001 WHEN 'read' THEN 0.00005 WHEN 'search' THEN 0.0001 WHEN 'delete' THEN 0.00001 ELSE 0 END::DOUBLE"


@query("metering_compute_cost", o.sql("usage_events", f"SELECT namespace, round(sum({_UC} * quantity), 6) AS cost FROM usage_events GROUP BY 1"))
def metering_compute_cost(spark, sf):
    return mt.compute_cost(ad.usage_events(spark, sf), ["namespace"])


@query(
    "metering_monthly_snapshot",
    o.sql("usage_events revenue_events", f"""SELECT user_id, period, CAST(sum(quantity) AS BIGINT) AS operations,
      {', '.join(f"CAST(coalesce(sum(quantity) FILTER (WHERE event_type = '{t}'), 0) AS BIGINT) AS {c}" for t, c in
                 [('write', 'writes'), ('encode', 'encodes'), ('read', 'reads'), ('search', 'searches'), ('delete', 'deletes')])},
      round(sum({_UC} * quantity), 6) AS cost, coalesce(max(rev), 0) AS revenue
      FROM (SELECT *, strftime(occurred_at, '%Y-%m') AS period FROM usage_events WHERE user_id IS NOT NULL)
      LEFT JOIN (SELECT user_id, '2024-' || right(period, 2) AS period, sum(amount_cents) / 100.0::DOUBLE AS rev FROM revenue_events GROUP BY 1, 2) USING (user_id, period) GROUP BY 1, 2"""),
)
def metering_monthly_snapshot(spark, sf):
    # Orders end in 2001; their months are read as months of 2024 so that revenue meets use.
    rev = ad.revenue_events(spark, sf).withColumn("period", F.concat(F.lit("2024-"), F.right("period", F.lit(2))))
    return mt.monthly_snapshot(ad.usage_events(spark, sf), rev)
