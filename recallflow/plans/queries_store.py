"""Queries over sources and sinks."""

import uuid

from pyspark.sql import functions as F

from recallflow.plans import oracle as o
from recallflow.plans.registry import query
from recallflow.session import shared_folder
from recallflow.sources import adapters as ad
from recallflow.sources import store as so


@query("store_validate_valid", o.sql("usage_events", "SELECT idempotency_key, quantity FROM usage_events"))
def store_validate_valid(spark, sf):
    return so.validate_usage_events(ad.usage_raw(spark, sf))[0].select("idempotency_key", "quantity")


@query("store_validate_dead_letters", o.sql("usage_raw", """SELECT 'ValueError' AS error_class, CASE WHEN actor_kind = 'robot' THEN 'actor_kind must be one of the known kinds, got robot'
  WHEN quantity <= 0 THEN 'quantity must be > 0, got ' || quantity ELSE 'unit_cost_cents must be >= 0, got ' || unit_cost_cents END AS error_message, count(*) AS n
  FROM usage_raw WHERE actor_kind = 'robot' OR quantity <= 0 OR unit_cost_cents < 0 GROUP BY 1, 2"""))
def store_validate_dead_letters(spark, sf):
    dead = so.validate_usage_events(ad.usage_raw(spark, sf))[1]
    return dead.groupBy("error_class", "error_message").agg(F.count(F.lit(1)).alias("n"))


_DELTA = """delta AS (SELECT 'm' || (doc_id * 2) AS mem_id, 'new ' || text AS text, 0.9 + (doc_id % 7)::DOUBLE / 100 AS confidence, 0.25::DOUBLE AS salience,
  CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2025-01-01' END AS event_at, lang AS namespace, doc_id AS seq, 0 AS usage_count FROM documents)"""


def _base(spark, sf):
    return ad.memories(spark, sf).select(
        "mem_id", "namespace", "seq", "text", "confidence", "salience", "event_at", "version", "usage_count"
    )


def _delta(spark, sf):
    d = F.col("doc_id")
    return ad.table(spark, sf, "documents").select(
        F.concat(F.lit("m"), (d * 2).cast("string")).alias("mem_id"), F.concat(F.lit("new "), "text").alias("text"),
        (0.9 + (d % 7) / 100).alias("confidence"), F.lit(0.25).alias("salience"),
        F.when(d % 2 == 0, F.lit("2025-01-01").cast("timestamp")).alias("event_at"), F.col("lang").alias("namespace"),
        d.alias("seq"), F.lit(1).alias("version"), F.lit(0).alias("usage_count"),
    )


@query("store_upsert_memories", o.sql("memories", """SELECT coalesce(b.mem_id, d.mem_id) AS mem_id, CASE WHEN d.mem_id IS NOT NULL THEN md5(d.text) ELSE md5(b.text) END AS text_md5,
  round(coalesce(d.confidence, b.confidence), 6) AS confidence, coalesce(d.salience, b.salience) AS salience, strftime(coalesce(d.event_at, b.event_at), '%Y-%m-%d') AS event_at,
  CASE WHEN b.mem_id IS NULL THEN 1 WHEN d.mem_id IS NULL THEN 1 ELSE 2 END AS version, CASE WHEN b.mem_id IS NULL THEN 0 WHEN d.mem_id IS NULL THEN b.usage_count ELSE b.usage_count + 1 END AS usage_count
  FROM memories b FULL JOIN delta d ON b.mem_id = d.mem_id""", _DELTA))
def store_upsert_memories(spark, sf):
    u = so.upsert_memories(_base(spark, sf), _delta(spark, sf))
    return u.select("mem_id", F.md5("text").alias("text_md5"), F.round("confidence", 6).alias("confidence"), "salience",
                    F.date_format("event_at", "yyyy-MM-dd").alias("event_at"), "version", "usage_count")


@query("store_upsert_schema_nodes", o.sql("memories", """SELECT coalesce(b.mem_id, d.mem_id) AS mem_id, round(CASE WHEN b.mem_id IS NULL THEN 1.0 WHEN d.mem_id IS NULL THEN b.confidence
  ELSE b.confidence * 0.99 + 0.01 END::DOUBLE, 6) AS edge_weight FROM memories b FULL JOIN delta d ON b.mem_id = d.mem_id""", _DELTA))
def store_upsert_schema_nodes(spark, sf):
    base = _base(spark, sf).withColumn("edge_weight", F.col("confidence"))
    return so.upsert_schema_nodes(base, _delta(spark, sf)).select("mem_id", F.round("edge_weight", 6).alias("edge_weight"))


@query("store_append_engrams", o.sql("memories", "SELECT mem_id, seq FROM delta WHERE mem_id NOT IN (SELECT mem_id FROM memories)", _DELTA))
def store_append_engrams(spark, sf):
    return so.append_engrams(_base(spark, sf), _delta(spark, sf)).select("mem_id", "seq")


@query("store_append_usage", o.sql("usage_events", """SELECT idempotency_key, min(occurred_at)::VARCHAR[:19] AS at FROM (SELECT 'e' || CAST(substr(idempotency_key, 2) AS BIGINT) // 3 AS idempotency_key, occurred_at FROM usage_events)
  WHERE idempotency_key NOT IN (SELECT idempotency_key FROM usage_events WHERE occurred_at < TIMESTAMP '2024-01-05') GROUP BY 1""".replace("min(occurred_at)::VARCHAR[:19]", "strftime(min(occurred_at), '%Y-%m-%d %H:%M:%S')")))
def store_append_usage(spark, sf):
    e = ad.usage_events(spark, sf)
    key = F.concat(F.lit("e"), F.floor(F.substring("idempotency_key", 2, 20).cast("bigint") / 3).cast("string"))
    batch = e.withColumn("idempotency_key", key)
    out = so.append_usage_events(e.where("occurred_at < '2024-01-05'"), batch)
    return out.select("idempotency_key", F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("store_append_prompts", o.sql("prompt_log", """SELECT session_id, sha256(content) AS content_hash, min(sequence_num) AS sequence_num FROM prompt_log WHERE content <> ''
  AND (session_id, content) NOT IN (SELECT (session_id, content) FROM prompt_log WHERE sequence_num = 0) GROUP BY 1, 2"""))
def store_append_prompts(spark, sf):
    log = ad.prompt_log(spark, sf)
    stored = log.where("sequence_num = 0").withColumn("content_hash", F.sha2("content", 256))
    return so.append_prompts(stored, log).select("session_id", "content_hash", "sequence_num")


def _messages(spark, sf):
    return ad.prompt_log(spark, sf).select(
        "session_id", "role", "content", F.col("llm_provider").alias("llm"), F.col("created_at").alias("at"), "sequence_num"
    )


@query("store_append_messages", o.sql("prompt_log", """SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY role <> 'user', created_at, sequence_num) - 1 AS pos, md5(content) AS content_md5 FROM prompt_log"""))
def store_append_messages(spark, sf):
    m = _messages(spark, sf)
    none = m.where("role = 'none'").withColumn("pos", F.lit(0).cast("bigint"))
    first = so.append_chat_messages(none, m.where("role = 'user'"))
    return so.append_chat_messages(first, m.where("role <> 'user'")).select("session_id", "pos", F.md5("content").alias("content_md5"))


@query("store_message_pages", o.sql("prompt_log", """SELECT session_id, (sequence_num // 4) AS page, count(*) AS n, md5(string_agg(content, '|' ORDER BY sequence_num)) AS content_md5,
  strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS updated_at FROM prompt_log GROUP BY 1, 2"""))
def store_message_pages(spark, sf):
    m = _messages(spark, sf).withColumn("pos", F.col("sequence_num"))
    p = so.message_pages(m, 4)
    return p.select("session_id", "page", F.size("messages").cast("bigint").alias("n"),
                    F.md5(F.array_join(F.transform("messages", lambda x: x["content"]), "|")).alias("content_md5"),
                    F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query("store_explode_messages", o.sql("prompt_log", "SELECT session_id, sequence_num AS pos, role, md5(content) AS content_md5 FROM prompt_log"))
def store_explode_messages(spark, sf):
    m = _messages(spark, sf).withColumn("pos", F.col("sequence_num"))
    return so.explode_messages(so.message_pages(m)).select("session_id", "pos", "role", F.md5("content").alias("content_md5"))


@query("store_working_buffer", o.sql("memories", """SELECT namespace, seq FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY ts DESC, seq DESC) AS r FROM memories
  WHERE ts > TIMESTAMP '2024-01-01 10:00:00' - INTERVAL 21600 SECOND AND ts <= TIMESTAMP '2024-01-01 10:00:00') WHERE r <= 10 AND confidence >= 0.6"""))
def store_working_buffer(spark, sf):
    b = so.working_buffer(ad.memories(spark, sf), "2024-01-01 10:00:00", 1000, 21600)
    return so.read_buffer(b, 10, 0.6).select("namespace", "seq")


@query("store_forget", o.sql("memories", """SELECT 'items' AS part, count(*) AS n FROM memories WHERE seq % 7 <> 0 UNION ALL
  SELECT 'edges', count(*) FROM memories WHERE seq % 7 <> 0 AND (seq + 1) % 7 <> 0"""))
def store_forget(spark, sf):
    m = ad.memories(spark, sf)
    edges = m.select(F.col("mem_id").alias("src"), F.concat(F.lit("m"), (F.col("seq") + 1).cast("string")).alias("dst"))
    gone = m.where("seq % 7 = 0").select("mem_id").unionByName(
        m.where("(seq + 1) % 7 = 0").select(F.concat(F.lit("m"), (F.col("seq") + 1).cast("string")).alias("mem_id"))
    )
    left = so.forget({"items": m, "edges": edges}, gone, {"items": ["mem_id"], "edges": ["src", "dst"]})
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("part"), "n") for k, df in left.items()]
    return parts[0].unionByName(parts[1])


@query("store_wipe", o.sql("memories", "SELECT namespace, count(*) AS n FROM memories WHERE namespace NOT IN (SELECT lang FROM documents WHERE source = (SELECT min(source) FROM documents WHERE lang = 'fr') AND lang = 'fr') GROUP BY 1"))
def store_wipe(spark, sf):
    m = ad.memories(spark, sf)
    left = so.wipe({"items": m}, m.where("namespace = 'fr'").select("namespace"))["items"]
    return left.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


@query("store_erase_user", o.sql("revenue_events users user_feedback", """SELECT 'revenue' AS part, count(*) AS n FROM revenue_events WHERE user_id % 9 <> 0 UNION ALL
  SELECT 'feedback', count(*) FROM user_feedback WHERE user_id % 9 <> 0 OR user_id NOT IN (SELECT id FROM users) UNION ALL SELECT 'users', count(*) FROM users WHERE id % 9 <> 0"""))
def store_erase_user(spark, sf):
    u = ad.users(spark, sf)
    tables = {"revenue": ad.revenue_events(spark, sf), "feedback": ad.user_feedback(spark, sf), "users": u}
    left = so.erase_user(tables, u.where("id % 9 = 0").select(F.col("id").alias("user_id")))
    out = None
    for k, df in left.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("store_preload_top", o.sql("memories", """SELECT namespace, seq, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY confidence DESC, ts DESC) AS r
  FROM memories WHERE NOT superseded) WHERE r <= 40"""))
def store_preload_top(spark, sf):
    return so.preload_top(ad.memories(spark, sf), 40).select("namespace", "seq", "rank")


_DAILY = """SELECT strftime(occurred_at, '%Y-%m') AS period, namespace AS tenant, CAST(occurred_at AS DATE) AS day, event_type, CAST(sum(quantity) AS BIGINT) AS quantity,
  CAST(sum(unit_cost_cents * quantity) AS BIGINT) AS cents, count(*) AS events FROM usage_events GROUP BY 1, 2, 3, 4"""


@query("store_rollup_daily", o.sql("usage_events", _DAILY))
def store_rollup_daily(spark, sf):
    return so.rollup_usage(ad.usage_events(spark, sf), "2024-02-01")[0]


@query("store_rollup_monthly", o.sql("usage_events", f"""SELECT period, tenant, event_type, CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(cents) AS BIGINT) AS cents,
  CAST(sum(events) AS BIGINT) AS events FROM ({_DAILY}) GROUP BY 1, 2, 3"""))
def store_rollup_monthly(spark, sf):
    return so.rollup_usage(ad.usage_events(spark, sf), "2024-02-01")[1]


_SHIPPED = "ship AS (SELECT 'u' || l_suppkey % 10 AS tenant, 'op' || l_linenumber % 3 AS event_type, l_shipdate AS moment, CAST(l_quantity AS BIGINT) AS q, l_orderkey % 50 AS cents, strftime(l_shipdate, '%Y-%m') AS period FROM lineitem)"


@query("store_rollup_reissue", o.sql("", """SELECT period, tenant, event_type, CAST(sum(q + late) AS BIGINT) AS quantity, CAST(sum(cents * (q + late)) AS BIGINT) AS cents, count(*) AS events
  FROM (SELECT *, CASE WHEN period < '1998-06' THEN 1 ELSE 0 END AS late FROM ship WHERE period >= '1996-10' AND moment <= TIMESTAMP '1998-09-05') GROUP BY 1, 2, 3""", _SHIPPED))
def store_rollup_reissue(spark, sf):
    """Roll-ups written twice: the second run corrects the months since the first, keeps the
    earlier ones as they were issued, and deletes those out of retention."""
    ship = ad.table(spark, sf, "lineitem").select(
        F.concat(F.lit("u"), (F.col("l_suppkey") % 10).cast("string")).alias("namespace"), F.concat(F.lit("op"), (F.col("l_linenumber") % 3).cast("string")).alias("event_type"),
        F.col("l_shipdate").cast("timestamp").alias("occurred_at"), F.col("l_quantity").cast("bigint").alias("quantity"), (F.col("l_orderkey") % 50).alias("unit_cost_cents"),
    )
    path = f"{shared_folder(spark)}/rollups-{uuid.uuid4().hex}"
    so.write_rollups(ship.withColumn("quantity", F.col("quantity") + 1), path, "1998-06-15")
    so.write_rollups(ship, path, "1998-09-05")
    return spark.read.parquet(f"{path}/monthly").select(F.col("period").cast("string").alias("period"), "tenant", "event_type", "quantity", "cents", "events")


@query("store_schema_version", o.sql("memories", "SELECT mem_id, NULL AS event_at, false AS superseded FROM memories"))
def store_schema_version(spark, sf):
    old = ad.memories(spark, sf).select("mem_id", "text")
    v = so.apply_schema_version(old).select("mem_id", "event_at", "superseded")
    return v.withColumn("event_at", F.date_format("event_at", "yyyy"))


@query("store_seed_namespaces", o.sql("prompt_log usage_events", """SELECT namespace, count(*) AS facts FROM (SELECT DISTINCT namespace FROM (SELECT namespace FROM usage_events UNION ALL SELECT 'user-' || c_custkey FROM customer)
  WHERE namespace NOT IN (SELECT namespace FROM prompt_log)), range(6) GROUP BY 1"""))
def store_seed_namespaces(spark, sf):
    c = ad.table(spark, sf, "customer").select(so.canonical_namespace(F.col("c_custkey")).alias("namespace"))
    who = ad.usage_events(spark, sf).select("namespace").unionByName(c)
    return so.seed_namespaces(who, ad.prompt_log(spark, sf)).groupBy("namespace").agg(F.count(F.lit(1)).alias("facts"))


@query("store_resolve_namespace", """SELECT CASE WHEN user_id < 25 THEN 'NATION_' || user_id ELSE 'u' || user_id END AS namespace, count(*) AS n FROM events GROUP BY 1""")
def store_resolve_namespace(spark, sf):
    n = F.col("n_nationkey").cast("string")
    aliases = ad.table(spark, sf, "nation").select(F.concat(F.lit("u"), n).alias("alias"), F.col("n_name").alias("canonical"))
    again = aliases.withColumn("canonical", F.lit("late"))
    all_aliases = aliases.unionByName(so.add_aliases(aliases, again))
    e = ad.table(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("namespace"))
    return so.resolve_namespace(e, all_aliases).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


@query("store_decay_edges", o.sql("memories", "SELECT mem_id, namespace, round(CASE WHEN namespace = 'en' THEN confidence * 0.9 ELSE confidence END, 6) AS edge_weight FROM memories"))
def store_decay_edges(spark, sf):
    edges = ad.memories(spark, sf).select("mem_id", "namespace", F.col("confidence").cast("double").alias("edge_weight"))
    return so.decay_edges(edges, 0.9, "en").withColumn("edge_weight", F.round("edge_weight", 6))


@query("store_engrams_round_trip", o.sql("vectors", """SELECT 'v' || vec_id AS id, 'L3' AS store_level, namespace, len(vec) AS dims, round(vec[1], 6) AS first, 1 AS parents FROM vectors"""))
def store_engrams_round_trip(spark, sf):
    """Encode, write to the shared checkpoint folder, and read back."""
    v = ad.vectors(spark, sf)
    items = v.select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), "namespace", F.lit("").alias("text"),
        F.lit("L3").alias("store_level"), F.lit("user").alias("source"), F.lit("2024-01-01").cast("timestamp").alias("timestamp"),
        "confidence", F.lit(1).cast("bigint").alias("version"), F.lit("").alias("checksum"), F.array(F.lit("p")).alias("lineage"),
        F.lit(0.5).alias("salience"), F.lit(0).cast("bigint").alias("usage_count"), F.lit(0.5).alias("authority"),
        F.create_map(F.lit("k"), F.lit("1")).alias("metadata"), F.col("vec").alias("embedding"),
    )
    path = f"{shared_folder(spark)}/engrams-{uuid.uuid4().hex}"
    so.write_snapshot(so.encode_engrams(items), path)
    return so.read_engrams(spark, path).select(
        "id", "store_level", "namespace", F.size("embedding").alias("dims"),
        F.round(F.col("embedding")[0], 6).alias("first"), F.size("lineage").alias("parents"),
    )
