"""Canonical tables over the star-schema Parquet files.

Each function reads only the columns it needs; the rest is arithmetic on keys, so the
adapters are narrow scans without a shuffle (``users`` has one, for first order dates).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallflow.session import spread

EPOCH_2024 = 1704067200
TEXT_TABLES = {"documents": "doc_id", "conversations": "conv_id", "benchmark": "item_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return spread(df, TEXT_TABLES[name]) if name in TEXT_TABLES else df


def _s(prefix: str, col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.concat(F.lit(prefix), c.cast("string"))


def _at(seconds: Column) -> Column:
    return F.timestamp_seconds(F.lit(EPOCH_2024) + seconds)


def memories(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        _s("m", d).alias("mem_id"),
        F.col("lang").alias("namespace"),
        d.alias("seq"),
        "text",
        "source",
        _at(d * 60).alias("ts"),
        F.when(d % 5 != 0, _at((d % 90) * 86400)).alias("event_at"),
        (0.5 + (d % 50) / 100).alias("confidence"),
        ((d % 10) / 10).alias("salience"),
        (d % 7).cast("int").alias("usage_count"),
        ((d % 5) / 5).alias("authority"),
        ((d % 4) / 4).alias("conflict_score"),
        ((d % 3) / 2).alias("surprise"),
        F.lit(1).alias("version"),
        (d % 11 == 0).alias("superseded"),
    )


def prompt_log(spark: SparkSession, sf: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    providers = F.array(*[F.lit(p) for p in ("chatgpt", "claude", "gemini", "copilot")])
    return table(spark, sf, "conversations").select(
        _s("u", c % 10).alias("user_id"),
        _s("u", c % 10).alias("namespace"),
        _s("s", c).alias("session_id"),
        t.alias("sequence_num"),
        "role",
        F.col("text").alias("content"),
        F.get(providers, (c % 4).cast("int")).alias("llm_provider"),
        F.lit("").alias("llm_model"),
        _at((c % 97) * 420 + t * 60).alias("created_at"),
    )


def _k() -> Column:
    return F.regexp_extract("props", r'"k": (\d+)', 1).cast("bigint")


def usage_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Metered actions as they arrive, malformed ones included."""
    e, u, k = F.col("event_id"), F.col("user_id"), F.col("k")
    kind = (
        F.when(F.col("event_type") == "signup", "encode")
        .when(F.col("event_type") == "view", "read")
        .when(F.col("event_type") == "click", "search")
        .when(F.col("event_type") == "purchase", "write")
        .otherwise("delete")
    )
    base = table(spark, sf, "events").withColumn("k", _k())
    return base.select(
        _s("e", e).alias("idempotency_key"),
        F.when(e % 97 == 0, "robot").when(e % 2 == 0, "api_key").otherwise("user").alias("actor_kind"),
        _s("a", u).alias("actor_id"),
        F.when(e % 20 != 0, u).alias("user_id"),
        _s("k", u * 2 + e % 2).alias("api_key_id"),
        _s("u", u % 10).alias("namespace"),
        _s("owner:", u).alias("billing_subject"),
        kind.alias("event_type"),
        (k % 6).cast("int").alias("quantity"),
        F.when(e % 89 == 0, -1).otherwise(k % 4).cast("int").alias("unit_cost_cents"),
        F.col("ts").alias("occurred_at"),
        F.col("props").alias("raw"),
    )


def usage_events(spark: SparkSession, sf: str) -> DataFrame:
    return usage_raw(spark, sf).where(
        (F.col("actor_kind") != "robot") & (F.col("quantity") > 0) & (F.col("unit_cost_cents") >= 0)
    )


def web_events(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    event = F.when(F.col("event_type") == "view", "pageview").otherwise(F.col("event_type"))
    return table(spark, sf, "events").withColumn("k", _k()).select(
        event.alias("event"),
        F.when(k % 13 == 0, "").otherwise(_s("/p", k)).alias("page"),
        F.when((F.col("event_type") == "click") & (k % 5 != 0), _s("btn", k % 7))
        .otherwise("").alias("ref"),
        F.when(k % 17 == 0, "").otherwise(F.col("user_id").cast("string")).alias("session_id"),
        F.col("ts").alias("created_at"),
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    k, u = F.col("k"), F.col("user_id")
    codes = F.array(*[F.lit(c) for c in (500, 503, 429, 402, 404, 401, 403, 422)])
    return table(spark, sf, "events").withColumn("k", _k()).select(
        F.col("event_id").alias("request_id"),
        "ts",
        F.col("event_type").alias("route"),
        F.when(F.col("event_type") == "error", F.get(codes, (k % 8).cast("int")))
        .otherwise(200).alias("status_code"),
        F.col("value").alias("latency_ms"),
        F.when(u % 29 == 0, _s("10.0.0.", u % 200)).otherwise(
            F.concat(_s("203.0.", u % 3), _s(".", u % 200))
        ).alias("ip"),
        F.when(u % 3 != 0, _s("k", u)).alias("api_key"),
        u.alias("user_id"),
        F.when(k % 10 == 0, "/wp-admin/x").when(k % 25 == 1, "/health")
        .otherwise(_s("/p", k)).alias("path"),
    )


def users(spark: SparkSession, sf: str) -> DataFrame:
    first = (
        table(spark, sf, "orders").groupBy("o_custkey")
        .agg(F.min("o_orderdate").alias("first_order"))
    )
    c = F.col("c_custkey")
    tier = (
        F.when(F.col("c_mktsegment") == "MACHINERY", "pro")
        .when(F.col("c_mktsegment") == "AUTOMOBILE", "business")
        .when(F.col("c_mktsegment") == "BUILDING", "enterprise")
        .otherwise("free")
    )
    created = F.coalesce("first_order", F.lit("1998-01-01").cast("timestamp"))
    return (
        table(spark, sf, "customer").join(first, c == F.col("o_custkey"), "left").select(
            c.alias("id"),
            F.concat(_s("user", c), F.lit("@example.com")).alias("email"),
            F.col("c_name").alias("name"),
            tier.alias("tier"),
            created.alias("created_at"),
            F.when(
                c % 4 != 0, F.timestamp_seconds(F.unix_timestamp(created) + (c % 400) * 86400)
            ).alias("subscription_expires_at"),
            F.lit("active").alias("subscription_status"),
        )
    )


def revenue_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "overage").otherwise("upgrade").alias("event_type"),
        F.date_format("o_orderdate", "yyyy-MM").alias("period"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("amount_cents"),
        F.col("o_orderdate").alias("created_at"),
    )


def tier_history(spark: SparkSession, sf: str) -> DataFrame:
    """Tier chosen at each order; the order status stands for the plan."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "pro").when(F.col("o_orderstatus") == "O", "business")
        .otherwise("free").alias("tier"),
        F.col("o_orderdate").alias("at"),
    )


def integrations(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        _s("i", c).alias("id"),
        _s("u", c % 10).alias("namespace"),
        F.when(c % 8 == 0, "deleted").otherwise("active").alias("status"),
        F.concat(_s("user", c), F.lit("@example.com")).alias("owner_email"),
    )


def api_credentials(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("o_orderkey")
    day = F.unix_timestamp("o_orderdate")
    return table(spark, sf, "orders").select(
        _s("c", o).alias("id"),
        _s("i", "o_custkey").alias("integration_id"),
        _s("k", o).alias("key_hash"),
        F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "rotated")
        .otherwise("revoked").alias("status"),
        F.when(o % 2 == 0, F.col("o_orderdate")).alias("last_used_at"),
        F.when(o % 3 == 0, F.timestamp_seconds(day + 1000 * 86400)).alias("expires_at"),
        F.timestamp_seconds(day + 1500 * 86400).alias("grace_until"),
    )


def user_feedback(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf, "labels").select(
        d.alias("id"),
        d.alias("user_id"),
        (1 + 4 * F.col("quality")).alias("score"),
        F.when(F.col("toxic") == 1, "down").otherwise("up").alias("sentiment"),
        F.when(d % 5 == 0, _s("note ", d)).alias("comment"),
        _at((d % 60) * 86400 + d).alias("created_at"),
    )


def waitlist(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    status = F.get(F.array(F.lit("waiting"), F.lit("invited"), F.lit("activated")), (c % 3).cast("int"))
    return table(spark, sf, "customer").select(
        c.alias("id"),
        F.concat(_s("user", c), F.lit("@example.com")).alias("email"),
        status.alias("status"),
        _at(c * 1800).alias("created_at"),
        F.when(c % 3 == 1, _at(c * 1800 + 172800)).alias("invite_expires_at"),
        F.when(c % 4 != 0, c % 300).alias("last_notified_position"),
    )


def roles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("role_id")).agg(
        F.sort_array(F.collect_set("n_name")).alias("scopes")
    )


def user_roles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") % 5).alias("role_id")
    )


def user_groups(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("group_id")
    )


def groups(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("group_id"), F.col("n_name").alias("name")
    )


def group_roles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("group_id"), ((F.col("n_regionkey") + 1) % 5).alias("role_id")
    )


def user_permissions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("user_id"),
        _s("NATION_", "s_nationkey").alias("scope"),
        (F.col("s_acctbal") > 5000).alias("granted"),
    )


def webhook_subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    lists = F.when(s % 3 == 0, F.array(F.lit("*"))).when(s % 3 == 1, F.array(F.lit("write"))).otherwise(
        F.array(F.lit("read"), F.lit("search"))
    )
    return table(spark, sf, "supplier").select(
        s.alias("id"),
        _s("i", s).alias("integration_id"),
        lists.alias("events"),
        F.when(s % 7 == 0, "paused").otherwise("active").alias("status"),
        F.when(s % 2 == 0, _s("u", s % 10)).alias("namespace_filter"),
        F.lit(3).alias("max_failures"),
    )


def webhook_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("subscription_id"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        F.when(F.col("l_returnflag") == "R", "failed").otherwise("delivered").alias("status"),
    )


def ext_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Browser-side events: who did what on which site."""
    k = F.col("k")
    event = (
        F.when(F.col("event_type") == "signup", "install")
        .when(F.col("event_type") == "view", "context_injected")
        .when(F.col("event_type") == "click", "message_captured")
        .when(F.col("event_type") == "purchase", "feature_toggle")
        .otherwise("ping")
    )
    return table(spark, sf, "events").withColumn("k", _k()).select(
        _s("x", "user_id").alias("uid"),
        event.alias("event"),
        _s("site", k % 4).alias("site"),
        F.concat(_s("f", k % 3), F.when(k % 2 == 0, "_on").otherwise("_off")).alias("toggle"),
        F.col("ts").alias("at"),
    )


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval queries: every benchmark passage asked in the English namespace."""
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.lit("en").alias("namespace"), "text"
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        v,
        _s("n", F.col("label") % 4).alias("namespace"),
        F.col("label"),
        F.col("embedding").cast("array<double>").alias("vec"),
        (0.5 + (v % 50) / 100).alias("confidence"),
    )


def user_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Per-user token vectors with snapshots: user = label, token = vec_id mod 50."""
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        _s("u", "label").alias("user_id"),
        _s("t", v % 50).alias("token"),
        v.cast("double").alias("epoch"),
        F.col("embedding").cast("array<double>").alias("vec"),
        v.alias("doc_count"),
    )
