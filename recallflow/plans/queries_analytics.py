"""Queries over product, operations and access reports."""

from pyspark.sql import functions as F

from recallflow.functions import lexicon as lx
from recallflow.operators import analytics as an
from recallflow.plans import oracle as o
from recallflow.plans.queries_metering import _UC
from recallflow.plans.registry import query
from recallflow.sources import adapters as ad

NOW = "2024-01-25 12:00:00"
_WIN = f"created_at >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY AND created_at <= TIMESTAMP '{NOW}'"
U_NOW = "1997-01-01 00:00:00"
_UWIN = f"created_at >= TIMESTAMP '{U_NOW}' - INTERVAL 365 DAY AND created_at <= TIMESTAMP '{U_NOW}'"
_TRAFFIC = f"""SELECT count(DISTINCT session_id) FILTER (WHERE session_id <> '') AS unique_visitors,
  count(*) FILTER (WHERE event = 'pageview') AS total_pageviews, count(*) FILTER (WHERE event = 'click') AS total_clicks
  FROM web_events WHERE {_WIN}"""


@query("analytics_traffic", o.sql("web_events", _TRAFFIC))
def analytics_traffic(spark, sf):
    return an.traffic(ad.web_events(spark, sf), NOW, 14)


@query("analytics_top_pages", o.sql("web_events", f"""SELECT page, count(*) FILTER (WHERE event = 'click') AS clicks,
  count(*) FILTER (WHERE event = 'pageview') AS pageviews FROM web_events WHERE {_WIN} AND page <> '' GROUP BY 1
  ORDER BY clicks DESC, pageviews DESC, page LIMIT 25"""))
def analytics_top_pages(spark, sf):
    return an.top_pages(ad.web_events(spark, sf), NOW, 14)


@query("analytics_top_engagement", o.sql("web_events", f"""SELECT ref AS target, count(*) AS clicks FROM web_events
  WHERE {_WIN} AND event = 'click' AND ref <> '' GROUP BY 1 ORDER BY clicks DESC, target LIMIT 15"""))
def analytics_top_engagement(spark, sf):
    return an.top_engagement(ad.web_events(spark, sf), NOW, 14)


@query("analytics_funnel", o.sql("web_events users integrations api_credentials", f"""SELECT v AS visitors, s AS signups, a AS active_users,
  round(100.0::DOUBLE * s / v, 2) AS visitor_to_signup_pct, round(100.0::DOUBLE * a / s, 2) AS signup_to_active_pct,
  round(100.0::DOUBLE * a / v, 2) AS visitor_to_active_pct FROM (SELECT (SELECT unique_visitors FROM ({_TRAFFIC})) AS v,
  (SELECT count(*) FROM users WHERE {_UWIN}) AS s, (SELECT count(DISTINCT u.id) FROM users u JOIN integrations i ON i.owner_email = u.email
  JOIN api_credentials c ON c.integration_id = i.id WHERE u.{_UWIN.replace('AND created_at', 'AND u.created_at')} AND c.status = 'active') AS a)"""))
def analytics_funnel(spark, sf):
    # Web and user rows of the sample live in different years: users of the year before
    # U_NOW are moved onto the web clock.
    users = an._window(ad.users(spark, sf), U_NOW, 365).withColumn("created_at", F.lit(NOW).cast("timestamp"))
    return an.funnel(ad.web_events(spark, sf), users, ad.integrations(spark, sf), ad.api_credentials(spark, sf), NOW, 14)


@query("analytics_signups_daily", o.sql("users", f"SELECT CAST(created_at AS DATE) AS day, count(*) AS signups FROM users WHERE {_UWIN} GROUP BY 1"))
def analytics_signups_daily(spark, sf):
    return an.signups_daily(ad.users(spark, sf), U_NOW, 365)


@query("analytics_users_by_tier", o.sql("users", "SELECT tier, count(*) AS users FROM users GROUP BY 1"))
def analytics_users_by_tier(spark, sf):
    return an.users_by_tier(ad.users(spark, sf))


@query("analytics_user_page", o.sql("users", "SELECT id, email, tier FROM users ORDER BY created_at DESC, id LIMIT 100 OFFSET 50"))
def analytics_user_page(spark, sf):
    return an.user_page(ad.users(spark, sf), 100, 50).select("id", "email", "tier")


_PRICE = "CASE tier WHEN 'pro' THEN 9.0 WHEN 'business' THEN 29.0 WHEN 'enterprise' THEN 149.0 ELSE 0.0 END::DOUBLE"


@query("analytics_kpi_summary", o.sql("users usage_events", f"""SELECT users, paying_users, mrr, cost, mrr * 12 AS arr,
  round(100.0::DOUBLE * (mrr - cost) / mrr, 2) AS margin_pct FROM (SELECT count(*) AS users, count(*) FILTER (WHERE tier <> 'free') AS paying_users,
  sum({_PRICE}) AS mrr FROM users), (SELECT round(sum({_UC} * quantity), 6) AS cost FROM usage_events)"""))
def analytics_kpi_summary(spark, sf):
    return an.kpi_summary(ad.users(spark, sf), ad.usage_events(spark, sf))


@query("analytics_revenue_by_tier", o.sql("users", f"SELECT tier, count(*) AS users, sum({_PRICE}) AS revenue FROM users GROUP BY 1"))
def analytics_revenue_by_tier(spark, sf):
    return an.revenue_by_tier(ad.users(spark, sf))


@query("analytics_user_economics", o.sql("users usage_events", f"""SELECT id, tier, coalesce(ops, 0) AS operations, coalesce(cost, 0) AS cost, {_PRICE} AS revenue
  FROM users LEFT JOIN (SELECT user_id, CAST(sum(quantity) AS BIGINT) AS ops, round(sum({_UC} * quantity), 6) AS cost FROM usage_events WHERE user_id IS NOT NULL GROUP BY 1) ON user_id = id"""))
def analytics_user_economics(spark, sf):
    return an.user_economics(ad.users(spark, sf), ad.usage_events(spark, sf))


@query("analytics_tier_changes", o.sql("tier_history", """SELECT user_id, id, f AS from_tier, tier AS to_tier,
  CASE WHEN p(tier) > p(f) THEN 'upgrade' ELSE 'downgrade' END AS event_type, p(tier) AS monthly_revenue FROM (SELECT *, lag(tier) OVER (PARTITION BY user_id ORDER BY moment, id) AS f
  FROM tier_history) WHERE f <> tier""".replace("p(tier)", f"({_PRICE})").replace("p(f)", "(" + _PRICE.replace("tier", "f") + ")")))
def analytics_tier_changes(spark, sf):
    return an.tier_changes(ad.tier_history(spark, sf))


_EXP = """SELECT id FROM users WHERE subscription_expires_at < TIMESTAMP '1997-06-01' AND tier <> 'free' ORDER BY subscription_expires_at, id LIMIT 500"""


@query("analytics_expired_subscriptions", o.sql("users", _EXP))
def analytics_expired_subscriptions(spark, sf):
    return an.expired_subscriptions(ad.users(spark, sf), "1997-06-01").select("id")


@query("analytics_downgrade", o.sql("users", f"""SELECT id, CASE WHEN id IN ({_EXP}) THEN 'free' ELSE tier END AS tier,
  CASE WHEN id IN ({_EXP}) THEN 'expired' ELSE subscription_status END AS subscription_status FROM users"""))
def analytics_downgrade(spark, sf):
    u = ad.users(spark, sf)
    return an.downgrade(u, an.expired_subscriptions(u, "1997-06-01")).select("id", "tier", "subscription_status")


@query("analytics_key_counts", o.sql("api_credentials", """SELECT count(*) FILTER (WHERE status <> 'revoked') AS total,
  count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'active' AND last_used_at IS NOT NULL) AS consumed FROM api_credentials"""))
def analytics_key_counts(spark, sf):
    return an.key_counts(ad.api_credentials(spark, sf))


@query("analytics_consumption_by_user", o.sql("usage_events users", """SELECT user_id, CASE WHEN user_id IS NULL THEN '(unattributed)' ELSE email END AS email,
  coalesce(name, '') AS name, coalesce(tier, '') AS tier, operations, keys_used, strftime(last_active, '%Y-%m-%d %H:%M:%S') AS last_active FROM (SELECT user_id, CAST(sum(quantity) AS BIGINT) AS operations,
  count(DISTINCT api_key_id) AS keys_used, max(occurred_at) AS last_active FROM usage_events GROUP BY 1) LEFT JOIN users ON id = user_id
  ORDER BY operations DESC, user_id NULLS LAST LIMIT 50"""))
def analytics_consumption_by_user(spark, sf):
    c = an.consumption_by_user(ad.usage_events(spark, sf), ad.users(spark, sf), 50)
    return c.withColumn("last_active", F.date_format("last_active", "yyyy-MM-dd HH:mm:ss"))


@query("analytics_active_hours", o.sql("usage_events", """SELECT CAST(h AS INTEGER) AS hour, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS operations
  FROM range(24) r(h) LEFT JOIN usage_events ON hour(occurred_at) = h GROUP BY 1"""))
def analytics_active_hours(spark, sf):
    return an.active_hours(ad.usage_events(spark, sf))


F_NOW = "2024-02-20 00:00:00"
_FWIN = f"created_at >= TIMESTAMP '{F_NOW}' - INTERVAL 30 DAY AND created_at <= TIMESTAMP '{F_NOW}'"


@query("analytics_csat", o.sql("user_feedback", f"""SELECT count(*) AS responses, round(100.0::DOUBLE * count(*) FILTER (WHERE score >= 4) / count(*), 1) AS csat_percent,
  round(avg(score), 2) AS avg_score, count(*) FILTER (WHERE sentiment = 'down') AS thumbs_down FROM user_feedback WHERE {_FWIN}"""))
def analytics_csat(spark, sf):
    return an.csat(ad.user_feedback(spark, sf), F_NOW, 30)


@query("analytics_csat_trend", o.sql("user_feedback", f"""SELECT CAST(created_at AS DATE) AS day, count(*) AS responses,
  round(100.0::DOUBLE * count(*) FILTER (WHERE score >= 4) / count(*), 1) AS csat, round(avg(score), 2) AS avg_score FROM user_feedback WHERE {_FWIN} GROUP BY 1"""))
def analytics_csat_trend(spark, sf):
    return an.csat_trend(ad.user_feedback(spark, sf), F_NOW, 30)


@query("analytics_recent_comments", o.sql("user_feedback users", """SELECT f.id, score, comment, email FROM user_feedback f JOIN users u ON u.id = f.user_id
  WHERE comment IS NOT NULL ORDER BY f.created_at DESC, f.id LIMIT 30"""))
def analytics_recent_comments(spark, sf):
    return an.recent_comments(ad.user_feedback(spark, sf), ad.users(spark, sf)).select("id", "score", "comment", "email")


def _hits(src: str, keys: str, secs: int, name: str) -> str:
    """CTEs counting hits of a refreshing counter: gaps and islands."""
    return f"""{name}_g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY {keys} ORDER BY ts, request_id) IS NULL
  OR date_diff('microsecond', lag(ts) OVER (PARTITION BY {keys} ORDER BY ts, request_id), ts) >= {secs} * CAST(1000000 AS BIGINT) THEN 1 ELSE 0 END AS nw FROM {src}),
{name}_s AS (SELECT *, sum(nw) OVER (PARTITION BY {keys} ORDER BY ts, request_id) AS session FROM {name}_g),
{name} AS (SELECT *, row_number() OVER (PARTITION BY {keys}, session ORDER BY ts, request_id) AS hits FROM {name}_s)"""


_BAD = """bad AS (SELECT user_id, route, ts, request_id, CASE WHEN status_code IN (402, 429) THEN 'quota_block' WHEN status_code >= 500 THEN 'error_5xx'
  ELSE 'error_4xx' END AS signal FROM requests WHERE status_code >= 400)"""
_SIG = "sig AS (SELECT user_id, ts, request_id, signal FROM bad UNION ALL SELECT user_id, ts, request_id, 'rage_retry' FROM rr WHERE hits >= 3)"


@query("analytics_pulse_signals", o.sql("requests", "SELECT user_id, request_id, signal FROM sig", _BAD, _hits("bad", "user_id, route", 60, "rr"), _SIG))
def analytics_pulse_signals(spark, sf):
    return an.pulse_signals(ad.requests(spark, sf)).select("user_id", "request_id", "signal")


@query("analytics_pulse_score", o.sql("requests", f"""SELECT user_id, score, CASE WHEN score >= 60 THEN 'frustrated' WHEN score >= 25 THEN 'neutral' ELSE 'happy' END AS band,
  top_signal FROM (SELECT user_id, least(100, CAST(sum(points) AS BIGINT)) AS score, arg_max(signal, points) AS top_signal FROM (SELECT user_id, signal, count(*) * (CASE signal WHEN 'error_5xx' THEN 22
  WHEN 'rage_retry' THEN 20 WHEN 'quota_block' THEN 14 ELSE 9 END) AS points, max(ts) AS last FROM ps GROUP BY user_id, signal, session)
  WHERE date_diff('microsecond', last, TIMESTAMP '{NOW}') < 900000000 GROUP BY 1)""", _BAD, _hits("bad", "user_id, route", 60, "rr"), _SIG,
  f"past AS (SELECT * FROM sig WHERE ts <= TIMESTAMP '{NOW}')", _hits("past", "user_id, signal", 900, "ps")))
def analytics_pulse_score(spark, sf):
    p = an.pulse_score(an.pulse_signals(ad.requests(spark, sf)), NOW)
    return p.select("user_id", "score", "band", F.col("reasons")[0]["signal"].alias("top_signal"))


_RULES = {"auth_fail": (2, 86400), "burst": (4, 36000), "path_scan": (3, 86400), "malformed": (2, 86400)}
_SEEN = """seen AS (SELECT * FROM requests WHERE NOT starts_with(ip, '10.') AND NOT starts_with(path, '/health'))"""
_ABUSE = """ab AS (SELECT request_id, ts, 'auth_fail' AS signal, 'ip:' || ip AS identity FROM seen WHERE status_code IN (401, 403)
  UNION ALL SELECT request_id, ts, 'burst', CASE WHEN api_key IS NULL THEN 'ip:' || ip ELSE 'key:' || left(sha256(api_key), 16) END FROM seen
  UNION ALL SELECT request_id, ts, 'path_scan', 'ip:' || ip FROM seen WHERE contains(path, '/wp-admin')
  UNION ALL SELECT request_id, ts, 'malformed', 'ip:' || ip FROM seen WHERE status_code IN (400, 422))"""


@query("analytics_abuse_blocks", o.sql("requests",
  "SELECT identity, signal, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS blocked_at FROM ("
  + " UNION ALL ".join(f"SELECT identity, signal, ts FROM h_{n} WHERE hits >= {t}" for n, (t, _) in _RULES.items())
  + ") GROUP BY 1, 2", _SEEN, _ABUSE,
  *[f"ab_{n} AS (SELECT * FROM ab WHERE signal = '{n}'), " + _hits(f"ab_{n}", "identity", s, f"h_{n}") for n, (_, s) in _RULES.items()]))
def analytics_abuse_blocks(spark, sf):
    b = an.abuse_blocks(ad.requests(spark, sf), _RULES)
    return b.select("identity", "signal", F.date_format("blocked_at", "yyyy-MM-dd HH:mm:ss").alias("blocked_at"))


_REC = f"rec AS (SELECT * FROM requests WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 2880 MINUTE AND ts <= TIMESTAMP '{NOW}')"
_HEALTH = """SELECT count(*) AS total_requests, round(count(*) / 2880.0::DOUBLE, 2) AS requests_per_minute,
  round(100.0::DOUBLE * count(*) FILTER (WHERE status_code >= 400 AND status_code < 600) / count(*), 2) AS error_rate,
  round(100.0::DOUBLE * count(*) FILTER (WHERE status_code >= 400 AND status_code < 500) / count(*), 2) AS error_rate_4xx,
  round(100.0::DOUBLE * count(*) FILTER (WHERE status_code >= 500 AND status_code < 600) / count(*), 2) AS error_rate_5xx,
  count(*) FILTER (WHERE status_code = 402) AS quota_402, count(*) FILTER (WHERE status_code = 429) AS rate_limit_429,
  count(*) FILTER (WHERE status_code = 403) AS blocked_403, round(quantile_cont(latency_ms, 0.5), 2) AS p50,
  round(quantile_cont(latency_ms, 0.95), 2) AS p95, round(quantile_cont(latency_ms, 0.99), 2) AS p99 FROM rec"""


@query("analytics_ops_health", o.sql("requests", _HEALTH, _REC))
def analytics_ops_health(spark, sf):
    return an.ops_health(ad.requests(spark, sf), NOW, 2880)


@query("analytics_top_errors", o.sql("requests", "SELECT status_code, count(*) AS n FROM rec WHERE status_code >= 400 GROUP BY 1 ORDER BY n DESC, status_code LIMIT 8", _REC))
def analytics_top_errors(spark, sf):
    return an.top_errors(ad.requests(spark, sf), NOW, 2880)


@query("analytics_slowest_routes", o.sql("requests", """SELECT route, count(*) AS requests, round(sum(floor(latency_ms * 100)) / 100 / count(*), 2) AS avg_latency_ms
  FROM rec GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 10""", _REC))
def analytics_slowest_routes(spark, sf):
    return an.slowest_routes(ad.requests(spark, sf), NOW, 2880)


@query("analytics_rollout_verdict", o.sql("requests", f"""SELECT total_requests, error_rate_5xx, p95, CASE WHEN total_requests >= 50 AND error_rate_5xx > 2.0
  THEN printf('5xx error rate %.2f%% > 2.0%%', error_rate_5xx) ELSE '' END AS breaches, CASE WHEN total_requests >= 50 AND error_rate_5xx > 2.0 THEN 'red' ELSE 'green' END AS status FROM ({_HEALTH})""", _REC))
def analytics_rollout_verdict(spark, sf):
    return an.rollout_verdict(an.ops_health(ad.requests(spark, sf), NOW, 2880))


_DAILY = f"""daily AS (SELECT namespace, d AS day, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS operations, round(coalesce(sum({_UC} * quantity), 0), 6) AS cost
  FROM (SELECT DISTINCT namespace FROM usage_events) n, (SELECT CAST(unnest(generate_series(DATE '2023-12-27', DATE '2024-01-25', INTERVAL 1 DAY)) AS DATE) AS d)
  LEFT JOIN (SELECT namespace AS ns, CAST(occurred_at AS DATE) AS od, event_type, quantity FROM usage_events) ON ns = namespace AND od = d GROUP BY 1, 2)"""
_FIT = """fit AS (SELECT namespace, count(g) AS samples, arg_max(operations, day) FILTER (WHERE operations > 0)::DOUBLE AS start_volume, avg(g) AS mu,
  greatest(least(stddev_samp(g), 1.5), 0.02) AS sigma, sum(cost) / sum(operations) AS unit_cost FROM
  (SELECT *, CASE WHEN operations > 0 AND lag(operations) OVER w > 0 THEN ln(operations / lag(operations) OVER w::DOUBLE) END AS g FROM daily WINDOW w AS (PARTITION BY namespace ORDER BY day)) GROUP BY 1)"""


@query("analytics_daily_cost", o.sql("usage_events", "SELECT * FROM daily", _DAILY))
def analytics_daily_cost(spark, sf):
    return an.daily_cost(ad.usage_events(spark, sf), ["namespace"], NOW, 30)


@query("analytics_growth_fit", o.sql("usage_events", """SELECT namespace, start_volume, round(mu, 6) AS mu, round(sigma, 6) AS sigma, samples < 4 AS sparse,
  round(unit_cost, 9) AS unit_cost FROM fit""", _DAILY, _FIT))
def analytics_growth_fit(spark, sf):
    f = an.growth_fit(an.daily_cost(ad.usage_events(spark, sf), ["namespace"], NOW, 30), ["namespace"])
    return f.select("namespace", "start_volume", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"), "sparse", F.round("unit_cost", 9).alias("unit_cost"))


@query("analytics_cost_bands", o.sql("usage_events", """SELECT namespace, CAST(t AS INTEGER) AS day_ahead, round(start_volume * unit_cost * exp(t * mu + t * sigma * sigma / 2), 6) AS mean_usd,
  round(start_volume * unit_cost * exp(t * mu - 1.2815515655446004 * sigma * sqrt(t)), 6) AS p10_usd,
  round(start_volume * unit_cost * exp(t * mu + 1.2815515655446004 * sigma * sqrt(t)), 6) AS p90_usd FROM fit, range(1, 8) r(t)""", _DAILY, _FIT))
def analytics_cost_bands(spark, sf):
    fit = an.growth_fit(an.daily_cost(ad.usage_events(spark, sf), ["namespace"], NOW, 30), ["namespace"])
    b = an.cost_bands(fit, ["namespace"])
    return b.select("namespace", "day_ahead", *[F.round(c, 6).alias(c) for c in ("mean_usd", "p10_usd", "p90_usd")])


@query("analytics_active_now", o.sql("", f"SELECT count(DISTINCT user_id) AS active_now FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 5400 SECOND AND ts <= TIMESTAMP '{NOW}'"))
def analytics_active_now(spark, sf):
    return an.active_now(ad.table(spark, sf, "events"), "user_id", "ts", NOW, 5400)


@query("analytics_dau", "SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS dau FROM events GROUP BY 1")
def analytics_dau(spark, sf):
    return an.dau(ad.table(spark, sf, "events"), "user_id", "ts")


@query("analytics_extension_report", o.sql("ext_telemetry", f"""SELECT (SELECT CAST(sum(n) AS BIGINT) FROM i) AS installs_this_month, (SELECT coalesce(CAST(sum(n) AS BIGINT), 0) FROM i WHERE d = DATE '2024-01-25') AS installs_today,
  count(DISTINCT uid) FILTER (WHERE CAST(moment AS DATE) = DATE '2024-01-25') AS dau,
  count(DISTINCT uid) FILTER (WHERE strftime(moment, '%Y-%W') = strftime(DATE '2024-01-25', '%Y-%W')) AS wau,
  count(DISTINCT uid) AS mau FROM e""", f"e AS (SELECT * FROM ext_telemetry WHERE moment <= TIMESTAMP '{NOW}' AND strftime(moment, '%Y-%m') = '2024-01')",
  "i AS (SELECT CAST(moment AS DATE) AS d, count(DISTINCT uid) AS n FROM e WHERE event = 'install' GROUP BY 1)"))
def analytics_extension_report(spark, sf):
    return an.extension_report(ad.ext_telemetry(spark, sf), NOW)


@query("analytics_extension_sites", o.sql("ext_telemetry", """SELECT site, count(*) FILTER (WHERE event = 'context_injected') AS site_usage,
  count(*) FILTER (WHERE event = 'message_captured') AS messages_captured FROM ext_telemetry GROUP BY 1"""))
def analytics_extension_sites(spark, sf):
    return an.extension_sites(ad.ext_telemetry(spark, sf), "2024-01")


@query("analytics_extension_toggles", o.sql("ext_telemetry", "SELECT toggle, count(*) AS n FROM ext_telemetry WHERE event = 'feature_toggle' GROUP BY 1"))
def analytics_extension_toggles(spark, sf):
    return an.extension_toggles(ad.ext_telemetry(spark, sf))


@query("analytics_aggregate_metrics", o.sql("usage_events", "SELECT event_type AS metric, CAST(sum(quantity) AS BIGINT) AS total FROM usage_events GROUP BY 1"))
def analytics_aggregate_metrics(spark, sf):
    return an.aggregate_metrics(ad.usage_events(spark, sf), "2024-01")


_POS = "pos AS (SELECT *, row_number() OVER (ORDER BY created_at, id) AS position FROM waitlist WHERE status IN ('waiting', 'invited'))"


@query("analytics_waitlist_positions", o.sql("waitlist", "SELECT id, position FROM pos", _POS))
def analytics_waitlist_positions(spark, sf):
    return an.waitlist_positions(ad.waitlist(spark, sf)).select("id", "position")


@query("analytics_position_drops", o.sql("waitlist", "SELECT id, position, last_notified_position FROM pos WHERE last_notified_position - position >= 10", _POS))
def analytics_position_drops(spark, sf):
    return an.position_drops(ad.waitlist(spark, sf)).select("id", "position", "last_notified_position")


@query("analytics_waitlist_promote", o.sql("waitlist", f"""SELECT id, CASE WHEN id IN (SELECT id FROM w2 WHERE st = 'waiting' ORDER BY created_at, id LIMIT 20) THEN 'invited' ELSE st END AS status FROM w2""",
  f"w2 AS (SELECT *, CASE WHEN status = 'invited' AND invite_expires_at < TIMESTAMP '2024-01-10' THEN 'waiting' ELSE status END AS st FROM waitlist)"))
def analytics_waitlist_promote(spark, sf):
    fresh = an.reset_stale_invites(ad.waitlist(spark, sf), "2024-01-10")
    return an.waitlist_promote(fresh, 20, 3, "2024-01-10").select("id", "status")


@query("analytics_waitlist_stats", o.sql("waitlist api_credentials integrations", """SELECT (SELECT count(*) FROM waitlist WHERE status IN ('waiting', 'invited')) AS waiting_count,
  (SELECT count(DISTINCT owner_email) FROM integrations i JOIN api_credentials c ON c.integration_id = i.id WHERE c.status = 'active') AS active_now, 50 AS queue_limit,
  (SELECT count(*) FROM waitlist WHERE status IN ('waiting', 'invited')) >= 50 AS queue_full"""))
def analytics_waitlist_stats(spark, sf):
    return an.waitlist_stats(ad.waitlist(spark, sf), ad.api_credentials(spark, sf), ad.integrations(spark, sf))


@query("access_effective_scopes", o.sql("user_roles user_groups group_roles role_scopes user_permissions", """SELECT user_id, scope FROM held h
  WHERE NOT EXISTS (SELECT 1 FROM user_permissions p WHERE p.user_id = h.user_id AND p.scope = h.scope AND NOT granted)
  UNION SELECT user_id, scope FROM user_permissions WHERE granted""", """held AS (SELECT DISTINCT user_id, scope FROM (SELECT user_id, role_id FROM user_roles
  UNION ALL SELECT user_id, role_id FROM user_groups JOIN group_roles USING (group_id)) JOIN role_scopes USING (role_id))"""))
def access_effective_scopes(spark, sf):
    return an.effective_scopes(ad.user_roles(spark, sf), ad.user_groups(spark, sf), ad.group_roles(spark, sf), ad.roles(spark, sf), ad.user_permissions(spark, sf))


@query("access_group_sizes", "SELECT n_nationkey AS group_id, n_name AS name, count(c_custkey) AS members FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def access_group_sizes(spark, sf):
    return an.group_sizes(ad.groups(spark, sf), ad.user_groups(spark, sf))


@query("access_integration_counts", o.sql("integrations api_credentials subscriptions", """SELECT i.id AS integration_id, i.namespace,
  (SELECT count(*) FROM api_credentials c WHERE c.integration_id = i.id AND c.status = 'active') AS active_keys,
  (SELECT count(*) FROM subscriptions s WHERE s.integration_id = i.id AND s.status = 'active') AS active_webhooks FROM integrations i WHERE i.status <> 'deleted'"""))
def access_integration_counts(spark, sf):
    return an.integration_counts(ad.integrations(spark, sf), ad.api_credentials(spark, sf), ad.webhook_subscriptions(spark, sf))


@query("access_match_webhooks", o.sql("usage_events subscriptions integrations", """SELECT idempotency_key, s.id AS subscription_id FROM usage_events e JOIN subscriptions s
  ON (s.namespace_filter IS NULL OR s.namespace_filter = e.namespace) AND (list_contains(s.events, '*') OR list_contains(s.events, e.event_type))
  JOIN integrations i ON i.id = s.integration_id WHERE s.status = 'active' AND i.status = 'active'"""))
def access_match_webhooks(spark, sf):
    return an.match_webhooks(ad.usage_events(spark, sf), ad.webhook_subscriptions(spark, sf), ad.integrations(spark, sf))


@query("access_webhook_failures", o.sql("deliveries subscriptions", """SELECT id AS subscription_id, coalesce(n, 0) AS failure_count, CASE WHEN coalesce(n, 0) >= 3 THEN 'disabled' ELSE status END AS status
  FROM subscriptions LEFT JOIN (SELECT subscription_id, count(*) AS n FROM (SELECT *, count(*) FILTER (WHERE status = 'delivered') OVER
  (PARTITION BY subscription_id ORDER BY created_at DESC, order_id DESC, line DESC ROWS UNBOUNDED PRECEDING) AS later FROM deliveries) WHERE later = 0 GROUP BY 1) ON subscription_id = id"""))
def access_webhook_failures(spark, sf):
    return an.webhook_failure_state(ad.webhook_deliveries(spark, sf), ad.webhook_subscriptions(spark, sf))


@query("analytics_storage_report", o.sql("memories", """SELECT CASE WHEN confidence < 0.6 THEN 'L0' WHEN confidence < 0.9 THEN 'L1' ELSE 'L2' END AS store_level, count(*) AS items,
  count(DISTINCT namespace) AS namespaces FROM memories GROUP BY 1"""))
def analytics_storage_report(spark, sf):
    level = F.when(F.col("confidence") < 0.6, "L0").when(F.col("confidence") < 0.9, "L1").otherwise("L2")
    return an.storage_report(ad.memories(spark, sf).withColumn("store_level", level))


@query("analytics_region_split", """SELECT c_custkey AS id, CASE WHEN n_regionkey = 0 OR n_regionkey IS NULL THEN 'allowed' ELSE 'queued' END AS admission
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def analytics_region_split(spark, sf):
    n = ad.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("string").alias("country"))
    c = ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey").join(n, "c_nationkey", "left")
    return an.region_split(c, "0").select("id", "admission")
