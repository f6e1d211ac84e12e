"""DuckDB text of the canonical tables and of tokenisation, for result checks."""

from __future__ import annotations

from recallflow.functions import lexicon as lx

SPACE = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}]"
)
_PUNCT = "".join("\\" + c if c in r"\[]^-&~|" else c for c in lx.PUNCTUATION).replace("'", "''")
EDGE = f"^[{_PUNCT}]+|[{_PUNCT}]+$"


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def cases(mapping: dict, key: str, default: str = "NULL") -> str:
    body = " ".join(f"WHEN {key} = '{k}' THEN {v!r}" for k, v in mapping.items())
    return f"CASE {body} ELSE {default} END"


def words(text: str) -> str:
    """List of cleaned lower-case words of a text expression."""
    return (
        f"list_filter(list_transform(regexp_split_to_array(lower({text}), '{SPACE}+'), "
        f"lambda w: regexp_replace(w, '{EDGE}', '', 'g')), lambda w: w <> '')"
    )


def content(text: str) -> str:
    return f"list_filter({words(text)}, lambda w: length(w) > 1 AND w NOT IN ({quoted(lx.STOP_WORDS)}))"


_SYN = ", ".join(f"('{k}', '{v}')" for k, vs in lx.SYNONYMS.items() for v in vs)


def normalized(w: str) -> str:
    p = (
        f"(CASE WHEN {w} LIKE '%''s' AND length({w}) > 3 THEN left({w}, length({w}) - 2) "
        f"WHEN {w} LIKE '%''' AND length({w}) > 3 THEN left({w}, length({w}) - 1) ELSE {w} END)"
    )
    return (
        f"(CASE WHEN {p} LIKE '%ing' AND length({p}) >= 7 THEN left({p}, length({p}) - 3) "
        f"WHEN {p} LIKE '%s' AND {p} NOT LIKE '%ss' AND length({p}) > 3 "
        f"THEN left({p}, length({p}) - 1) ELSE {p} END)"
    )


def tokens(name: str, source: str, keys: str, text: str = "text") -> str:
    """CTEs ending in ``name(keys, token)``: the distinct index tokens per row."""
    return f"""
{name}_w AS (SELECT {keys}, unnest({words(text)}) AS w FROM {source}),
{name}_d AS (SELECT DISTINCT {keys}, w FROM {name}_w
  WHERE length(w) > 1 AND w NOT IN ({quoted(lx.STOP_WORDS)})),
{name}_syn(k, v) AS (VALUES {_SYN}),
{name} AS (
  SELECT {keys}, w AS token FROM {name}_d
  UNION SELECT {keys}, {normalized('w')} FROM {name}_d WHERE length({normalized('w')}) > 1
  UNION SELECT {keys}, v FROM {name}_d JOIN {name}_syn ON w = k)"""


def ordered_tokens(name: str, source: str, keys: str, text: str = "text") -> str:
    """CTEs ending in ``name(keys, token, r)``: index tokens with their rank, longest first."""
    return f"""
{name}_w AS (SELECT {keys}, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM
  (SELECT {keys}, {words(text)} AS ws FROM {source})),
{name}_d AS (SELECT * FROM {name}_w WHERE length(w) > 1 AND w NOT IN ({quoted(lx.STOP_WORDS)})),
{name}_syn(k, v, j) AS (VALUES {", ".join(f"('{k}', '{v}', {j + 2})" for k, vs in lx.SYNONYMS.items() for j, v in enumerate(vs))}),
{name}_a AS (
  SELECT {keys}, w AS token, i, 0 AS j FROM {name}_d
  UNION ALL SELECT {keys}, {normalized('w')}, i, 1 FROM {name}_d WHERE length({normalized('w')}) > 1
  UNION ALL SELECT {keys}, v, i, j FROM {name}_d JOIN {name}_syn ON w = k),
{name}_f AS (SELECT {keys}, token, min(i * 100 + j) AS p FROM {name}_a GROUP BY {keys}, token),
{name} AS (SELECT {keys}, token, row_number() OVER (PARTITION BY {keys}
  ORDER BY length(token) DESC, p) AS r FROM {name}_f)"""


def facts(name: str, source: str, keys: str, text: str = "text") -> str:
    """CTEs ending in ``name(keys, subject, relation, value)``."""
    verb = "(w LIKE '%ing' OR w LIKE '%ed' OR w LIKE '%ly')"
    return f"""
{name}_c AS (SELECT {keys}, {text} AS raw_text, {content(text)} AS ws FROM {source}),
{name}_k AS (SELECT *, len(ws) AS n, coalesce(list_position(list_transform(ws, lambda w: NOT {verb}), true), 0) AS p
  FROM {name}_c),
{name}_t AS (SELECT *, list_concat(ws[k + 1:], ws[1:k]) AS tw FROM (
  SELECT *, greatest(CASE WHEN p > 0 THEN p - 1 ELSE n - 1 END, 0) AS k FROM {name}_k)),
{name} AS (SELECT {keys}, coalesce(tw[1], '') AS subject, coalesce(tw[2], '') AS relation,
  CASE WHEN n = 2 THEN tw[2] ELSE coalesce(array_to_string(tw[3:], ' '), '') END AS value,
  {override('raw_text')} AS override
  FROM {name}_t)"""


def override(text: str) -> str:
    return (
        f"(list_has_any({words(text)}, [{quoted(lx.OVERRIDE_WORDS)}]) OR "
        + " OR ".join(f"contains(lower({text}), '{p}')" for p in lx.OVERRIDE_PHRASES)
        + ")"
    )


_K = r"""CAST(regexp_extract(props, '"k": (\d+)', 1) AS BIGINT)"""
_T0 = "TIMESTAMP '2024-01-01'"

CTES = {
    "memories": f"""SELECT 'm' || doc_id AS mem_id, lang AS namespace, doc_id AS seq, text, source,
  {_T0} + to_minutes(doc_id) AS ts,
  CASE WHEN doc_id % 5 <> 0 THEN {_T0} + to_days(CAST(doc_id % 90 AS INTEGER)) END AS event_at,
  0.5::DOUBLE + (doc_id % 50)::DOUBLE / 100 AS confidence, (doc_id % 10)::DOUBLE / 10 AS salience,
  doc_id % 7 AS usage_count, (doc_id % 5)::DOUBLE / 5 AS authority,
  (doc_id % 4)::DOUBLE / 4 AS conflict_score, (doc_id % 3)::DOUBLE / 2 AS surprise, 1 AS version,
  doc_id % 11 = 0 AS superseded FROM documents""",
    "prompt_log": f"""SELECT 'u' || conv_id % 10 AS user_id, 'u' || conv_id % 10 AS namespace,
  's' || conv_id AS session_id, turn AS sequence_num, role, text AS content,
  (['chatgpt', 'claude', 'gemini', 'copilot'])[conv_id % 4 + 1] AS llm_provider, '' AS llm_model,
  {_T0} + to_seconds((conv_id % 97) * 420 + turn * 60) AS created_at FROM conversations""",
    "usage_raw": f"""SELECT 'e' || event_id AS idempotency_key,
  CASE WHEN event_id % 97 = 0 THEN 'robot' WHEN event_id % 2 = 0 THEN 'api_key' ELSE 'user' END AS actor_kind,
  'a' || user_id AS actor_id, CASE WHEN event_id % 20 <> 0 THEN user_id END AS user_id,
  'k' || (user_id * 2 + event_id % 2) AS api_key_id, 'u' || user_id % 10 AS namespace,
  'owner:' || user_id AS billing_subject,
  CASE event_type WHEN 'signup' THEN 'encode' WHEN 'view' THEN 'read' WHEN 'click' THEN 'search'
    WHEN 'purchase' THEN 'write' ELSE 'delete' END AS event_type,
  {_K} % 6 AS quantity, CASE WHEN event_id % 89 = 0 THEN -1 ELSE {_K} % 4 END AS unit_cost_cents,
  ts AS occurred_at, props AS raw FROM events""",
    "usage_events": """SELECT * FROM usage_raw
  WHERE actor_kind <> 'robot' AND quantity > 0 AND unit_cost_cents >= 0""",
    "web_events": f"""SELECT CASE event_type WHEN 'view' THEN 'pageview' ELSE event_type END AS event,
  CASE WHEN {_K} % 13 = 0 THEN '' ELSE '/p' || {_K} END AS page,
  CASE WHEN event_type = 'click' AND {_K} % 5 <> 0 THEN 'btn' || {_K} % 7 ELSE '' END AS ref,
  CASE WHEN {_K} % 17 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS session_id,
  ts AS created_at FROM events""",
    "requests": f"""SELECT event_id AS request_id, ts, event_type AS route,
  CASE WHEN event_type = 'error' THEN ([500, 503, 429, 402, 404, 401, 403, 422])[{_K} % 8 + 1] ELSE 200 END AS status_code,
  value AS latency_ms,
  CASE WHEN user_id % 29 = 0 THEN '10.0.0.' || user_id % 200
    ELSE '203.0.' || user_id % 3 || '.' || user_id % 200 END AS ip,
  CASE WHEN user_id % 3 <> 0 THEN 'k' || user_id END AS api_key, user_id,
  CASE WHEN {_K} % 10 = 0 THEN '/wp-admin/x' WHEN {_K} % 25 = 1 THEN '/health' ELSE '/p' || {_K} END AS path
  FROM events""",
    "users": """SELECT c_custkey AS id, 'user' || c_custkey || '@example.com' AS email, c_name AS name,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'pro' WHEN 'AUTOMOBILE' THEN 'business'
    WHEN 'BUILDING' THEN 'enterprise' ELSE 'free' END AS tier,
  coalesce(first_order, TIMESTAMP '1998-01-01') AS created_at,
  CASE WHEN c_custkey % 4 <> 0 THEN coalesce(first_order, TIMESTAMP '1998-01-01')
    + to_days(CAST(c_custkey % 400 AS INTEGER)) END AS subscription_expires_at,
  'active' AS subscription_status
  FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order FROM orders GROUP BY 1)
  ON o_custkey = c_custkey""",
    "revenue_events": """SELECT o_orderkey AS id, o_custkey AS user_id,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'overage' ELSE 'upgrade' END AS event_type,
  strftime(o_orderdate, '%Y-%m') AS period, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_cents,
  o_orderdate AS created_at FROM orders""",
    "tier_history": """SELECT o_custkey AS user_id, o_orderkey AS id,
  CASE o_orderstatus WHEN 'F' THEN 'pro' WHEN 'O' THEN 'business' ELSE 'free' END AS tier,
  o_orderdate AS moment FROM orders""",
    "integrations": """SELECT 'i' || c_custkey AS id, 'u' || c_custkey % 10 AS namespace,
  CASE WHEN c_custkey % 8 = 0 THEN 'deleted' ELSE 'active' END AS status,
  'user' || c_custkey || '@example.com' AS owner_email FROM customer""",
    "api_credentials": """SELECT 'c' || o_orderkey AS id, 'i' || o_custkey AS integration_id,
  'k' || o_orderkey AS key_hash,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'rotated' ELSE 'revoked' END AS status,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS last_used_at,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + to_days(1000) END AS expires_at,
  o_orderdate + to_days(1500) AS grace_until FROM orders""",
    "user_feedback": f"""SELECT doc_id AS id, doc_id AS user_id, 1 + 4 * quality AS score,
  CASE WHEN toxic = 1 THEN 'down' ELSE 'up' END AS sentiment,
  CASE WHEN doc_id % 5 = 0 THEN 'note ' || doc_id END AS comment,
  {_T0} + to_seconds((doc_id % 60) * 86400 + doc_id) AS created_at FROM labels""",
    "waitlist": f"""SELECT c_custkey AS id, 'user' || c_custkey || '@example.com' AS email,
  (['waiting', 'invited', 'activated'])[c_custkey % 3 + 1] AS status,
  {_T0} + to_seconds(c_custkey * 1800) AS created_at,
  CASE WHEN c_custkey % 3 = 1 THEN {_T0} + to_seconds(c_custkey * 1800 + 172800) END AS invite_expires_at,
  CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 300 END AS last_notified_position FROM customer""",
    "user_roles": """SELECT c_custkey AS user_id, c_nationkey % 5 AS role_id FROM customer""",
    "role_scopes": "SELECT n_regionkey AS role_id, n_name AS scope FROM nation",
    "user_groups": "SELECT c_custkey AS user_id, c_nationkey AS group_id FROM customer",
    "group_roles": "SELECT n_nationkey AS group_id, (n_regionkey + 1) % 5 AS role_id FROM nation",
    "user_permissions": """SELECT s_suppkey AS user_id, 'NATION_' || s_nationkey AS scope,
  s_acctbal > 5000 AS granted FROM supplier""",
    "subscriptions": """SELECT s_suppkey AS id, 'i' || s_suppkey AS integration_id,
  CASE s_suppkey % 3 WHEN 0 THEN ['*'] WHEN 1 THEN ['write'] ELSE ['read', 'search'] END AS events,
  CASE WHEN s_suppkey % 7 = 0 THEN 'paused' ELSE 'active' END AS status,
  CASE WHEN s_suppkey % 2 = 0 THEN 'u' || s_suppkey % 10 END AS namespace_filter,
  3 AS max_failures FROM supplier""",
    "deliveries": """SELECT l_suppkey AS subscription_id, l_shipdate AS created_at, l_orderkey AS order_id,
  l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'delivered' END AS status FROM lineitem""",
    "ext_telemetry": f"""SELECT 'x' || user_id AS uid, CASE event_type WHEN 'signup' THEN 'install'
  WHEN 'view' THEN 'context_injected' WHEN 'click' THEN 'message_captured'
  WHEN 'purchase' THEN 'feature_toggle' ELSE 'ping' END AS event, 'site' || {_K} % 4 AS site,
  'f' || {_K} % 3 || CASE WHEN {_K} % 2 = 0 THEN '_on' ELSE '_off' END AS toggle, ts AS moment FROM events""",
    "queries": "SELECT item_id AS query_id, 'en' AS namespace, text FROM benchmark",
    "vectors": """SELECT vec_id, 'n' || label % 4 AS namespace, label,
  CAST(embedding AS DOUBLE[]) AS vec, 0.5::DOUBLE + (vec_id % 50)::DOUBLE / 100 AS confidence FROM embeddings""",
    "user_vectors": """SELECT 'u' || label AS user_id, 't' || vec_id % 50 AS token,
  CAST(vec_id AS DOUBLE) AS epoch, CAST(embedding AS DOUBLE[]) AS vec, vec_id AS doc_count FROM embeddings""",
}
_NEEDS = {"usage_events": ["usage_raw"]}


def sql(tables: str, body: str, *extra: str) -> str:
    """``WITH`` the named canonical tables and extra CTE blocks, then ``body``."""
    names: list[str] = []
    for t in tables.split():
        for n in [*_NEEDS.get(t, []), t]:
            if n not in names:
                names.append(n)
    parts = [f"{n} AS ({CTES[n]})" for n in names] + [e.strip() for e in extra]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
