"""Reading, appending, upserting and forgetting memory and usage tables.

Tables are immutable snapshots: every operator takes DataFrames and returns the rows of
the next snapshot; :func:`write_snapshot` stores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallflow.functions import lexicon as lx
from recallflow.operators.scans import running_sum, top_k

ENGRAM_SCHEMA = T.StructType(
    [
        T.StructField(n, t)
        for n, t in [
            ("id", T.StringType()), ("namespace", T.StringType()), ("text", T.StringType()),
            ("store_level", T.StringType()), ("source", T.StringType()), ("timestamp", T.StringType()),
            ("confidence", T.DoubleType()), ("version", T.LongType()), ("checksum", T.StringType()),
            ("lineage", T.StringType()), ("salience", T.DoubleType()), ("usage_count", T.LongType()),
            ("authority", T.DoubleType()), ("metadata", T.StringType()), ("embedding", T.StringType()),
        ]
    ]
)


def read_engrams(spark: SparkSession, path: str) -> DataFrame:
    """Archived items; JSON-encoded list and object columns are decoded."""
    df = spark.read.schema(ENGRAM_SCHEMA).parquet(path)
    return df.withColumns(
        {
            "timestamp": F.to_timestamp("timestamp"),
            "lineage": F.from_json("lineage", "array<string>"),
            "metadata": F.from_json("metadata", "map<string,string>"),
            "embedding": F.from_json("embedding", "array<double>"),
        }
    )


def encode_engrams(items: DataFrame) -> DataFrame:
    """Inverse of :func:`read_engrams`."""
    return items.withColumns(
        {
            "timestamp": F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
            "lineage": F.to_json("lineage"),
            "metadata": F.to_json("metadata"),
            "embedding": F.to_json("embedding"),
        }
    )


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a table, or only the partitions present in ``df`` when partitioned."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def _latest(delta: DataFrame, key: str, order: str) -> DataFrame:
    """Last row per key of a delta, plus how many rows it stands for."""
    cols = [c for c in delta.columns if c != key]
    return delta.groupBy(key).agg(
        F.max_by(F.struct(*cols), order).alias("_r"), F.count(F.lit(1)).alias("_writes")
    ).select(key, "_r.*", "_writes")


def upsert_memories(base: DataFrame, delta: DataFrame, order: str = "seq", graph: bool = False) -> DataFrame:
    """Insert or replace by ``mem_id``.

    A hit takes text, confidence, salience (and embedding) from the delta, counts a
    version and a use per write and keeps the old event date where the new one is null.
    With ``graph`` the edge weight moves towards one by 1 % per write. ``base`` must
    hold one row per id; several delta rows of an id collapse before the join.
    """
    new = _latest(delta, "mem_id", order)
    n = new.select("mem_id", *[F.col(c).alias(f"_n_{c}") for c in new.columns if c != "mem_id"])
    joined = base.join(n, "mem_id", "full_outer")
    old = F.col("namespace").isNotNull()
    hit = F.col("_n__writes").isNotNull()
    replaced = {"text", "confidence", "salience", "embedding", "promotion_score", "superseded"}
    out: list[Column] = [F.col("mem_id")]
    for c in base.columns:
        if c == "mem_id":
            continue
        if c in ("version", "usage_count"):
            start = F.when(old, F.col(c) + F.coalesce("_n__writes", F.lit(0))).otherwise(
                (F.col(f"_n_{c}") if f"_n_{c}" in joined.columns else F.lit(0)) + F.col("_n__writes") - 1
            )
            out.append(start.alias(c))
        elif c == "edge_weight" and graph:
            decay = F.pow(F.lit(0.99), F.coalesce("_n__writes", F.lit(0)))
            fresh = F.pow(F.lit(0.99), F.col("_n__writes") - 1)
            out.append(
                F.when(old, F.col(c) * decay + 1 - decay).otherwise(fresh + 1 - fresh).alias(c)
            )
        elif f"_n_{c}" not in joined.columns:
            out.append(F.col(c))
        elif c == "event_at":
            out.append(F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c))
        elif c in replaced:
            out.append(F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(old, F.col(c)).otherwise(F.col(f"_n_{c}")).alias(c))
    return joined.select(*out)


def upsert_schema_nodes(base: DataFrame, delta: DataFrame, order: str = "seq") -> DataFrame:
    return upsert_memories(base, delta, order, graph=True)


def decay_edges(edges: DataFrame, factor: float = 0.95, namespace: str | None = None) -> DataFrame:
    """Edge weights times ``factor``, of one namespace or of all."""
    mine = F.lit(True) if namespace is None else F.col("namespace") == namespace
    return edges.withColumn("edge_weight", F.when(mine, F.col("edge_weight") * factor).otherwise(F.col("edge_weight")))


def append_new(base: DataFrame, delta: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of ``delta`` to append: first per key, keys of ``base`` left out.

    The per-key choice is a group limit, so replays of a hot key collapse in the map
    tasks before anything is shuffled.
    """
    first = top_k(delta, keys, order, 1, "_rn").drop("_rn")
    return first.join(base.select(*keys), keys, "left_anti")


def append_engrams(base: DataFrame, delta: DataFrame) -> DataFrame:
    return append_new(base, delta, ["mem_id"], [F.asc("seq")])


def append_usage_events(log: DataFrame, batch: DataFrame) -> DataFrame:
    return append_new(log, batch, ["idempotency_key"], [F.asc("occurred_at")])


def append_prompts(log: DataFrame, batch: DataFrame) -> DataFrame:
    """Non-empty prompts not yet stored for their session, keyed by content digest."""
    b = batch.where(F.coalesce("content", F.lit("")) != "").withColumn("content_hash", F.sha2("content", 256))
    return append_new(log, b, ["content_hash", "session_id"], [F.asc("sequence_num"), F.asc("created_at")])


def validate_usage_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, dead letters). Both are plain filters over one scan."""
    kind = F.coalesce(F.col("actor_kind").isin(*lx.ACTOR_KINDS), F.lit(False))
    reason = (
        F.when(~kind, F.concat(F.lit("actor_kind must be one of the known kinds, got "), F.coalesce("actor_kind", F.lit("null"))))
        .when(~F.coalesce(F.col("quantity") > 0, F.lit(False)), F.concat(F.lit("quantity must be > 0, got "), F.coalesce(F.col("quantity").cast("string"), F.lit("null"))))
        .when(~F.coalesce(F.col("unit_cost_cents") >= 0, F.lit(False)), F.concat(F.lit("unit_cost_cents must be >= 0, got "), F.coalesce(F.col("unit_cost_cents").cast("string"), F.lit("null"))))
    )
    marked = events.withColumn("_reason", reason)
    dead = marked.where("_reason IS NOT NULL").select(
        F.col("occurred_at").alias("failed_at"),
        F.lit("ValueError").alias("error_class"),
        F.substring("_reason", 1, 500).alias("error_message"),
        F.to_json(F.struct(*events.columns)).alias("payload"),
        F.lit(0).alias("retry_count"),
        F.lit(None).cast("timestamp").alias("notified_at"),
    )
    return marked.where("_reason IS NULL").drop("_reason"), dead


PAGE = 1000


def append_chat_messages(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Number new messages after the ones a session already has.

    Messages stay one row each: (session_id, pos, role, content, llm, at). Positions come
    from a two-level running count, so one endless session does not land in one task.
    """
    have = stored.groupBy("session_id").agg(F.count(F.lit(1)).alias("_have"))
    numbered = running_sum(
        batch, ["session_id"], ["at", "sequence_num"], F.to_date("at"), {"_p": F.lit(1)}
    )
    new = numbered.join(have, "session_id", "left").withColumn(
        "pos", F.col("_p") + F.coalesce("_have", F.lit(0)) - 1
    )
    cols = ["session_id", "pos", "role", "content", "llm", "at"]
    return stored.select(*cols).unionByName(new.select(*cols))


def message_pages(messages: DataFrame, page: int = PAGE) -> DataFrame:
    """Ordered message arrays, ``page`` messages per row, with the time of last change."""
    m = F.struct("pos", "role", "content", "llm")
    return messages.groupBy("session_id", F.floor(F.col("pos") / page).alias("page")).agg(
        F.sort_array(F.collect_list(m)).alias("messages"), F.max("at").alias("updated_at")
    )


def explode_messages(pages: DataFrame) -> DataFrame:
    """One row per message with its position."""
    return pages.select("session_id", F.explode("messages").alias("m")).select("session_id", "m.*")


def explode_json_messages(sessions: DataFrame, col: str = "messages") -> DataFrame:
    """One row per message of a JSON-encoded message list."""
    parsed = F.from_json(col, "array<struct<role:string,content:string,llm:string>>")
    return sessions.select("session_id", F.posexplode(parsed).alias("pos", "m")).select("session_id", "pos", "m.*")


def working_buffer(items: DataFrame, as_of: str, n: int = 1000, ttl: int = 300) -> DataFrame:
    """Newest ``n`` items per namespace that are younger than ``ttl`` seconds."""
    now = F.lit(as_of).cast("timestamp")
    old = F.timestamp_seconds(F.unix_seconds(now) - ttl)
    fresh = items.where((F.col("ts") > old) & (F.col("ts") <= now))
    return top_k(fresh, ["namespace"], [F.desc("ts"), F.desc("seq")], n)


def read_buffer(buffer: DataFrame, limit: int = 10, min_confidence: float = 0.0) -> DataFrame:
    return buffer.where((F.col("rank") <= limit) & (F.col("confidence") >= min_confidence))


def forget(tables: dict[str, DataFrame], ids: DataFrame, columns: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Remove ``ids`` (mem_id) from every table; ``columns`` lists the id columns of each
    (edges have two)."""
    out = {}
    for name, df in tables.items():
        for col in columns[name]:
            df = df.join(ids.select(F.col("mem_id").alias(col)).distinct(), col, "left_anti")
        out[name] = df
    return out


def wipe(tables: dict[str, DataFrame], namespaces: DataFrame) -> dict[str, DataFrame]:
    """Remove whole namespaces from every table."""
    ns = namespaces.select("namespace").distinct()
    return {name: df.join(ns, "namespace", "left_anti") for name, df in tables.items()}


def erase_user(tables: dict[str, DataFrame], user_ids: DataFrame, users: str = "users") -> dict[str, DataFrame]:
    """Remove users from all user-keyed tables, then from the user table itself."""
    gone = user_ids.select("user_id").distinct()
    return {
        name: df.join(
            gone.withColumnRenamed("user_id", "id") if name == users else gone,
            "id" if name == users else "user_id",
            "left_anti",
        )
        for name, df in tables.items()
    }


def preload_top(items: DataFrame, n: int = 50000) -> DataFrame:
    """Best current items per namespace by confidence, then recency."""
    live = items.where(~F.coalesce(F.col("superseded"), F.lit(False)))
    return top_k(live, ["namespace"], [F.desc("confidence"), F.desc("ts")], n)


def rollup_usage(events: DataFrame, as_of: str, months: int = 24) -> tuple[DataFrame, DataFrame]:
    """(daily, monthly) aggregates per tenant within the retention window."""
    start = F.add_months(F.date_trunc("month", F.lit(as_of).cast("timestamp")).cast("date"), -(months - 1))
    kept = events.where(F.col("occurred_at") >= start.cast("timestamp"))
    daily = kept.groupBy(
        F.date_format("occurred_at", "yyyy-MM").alias("period"), F.col("namespace").alias("tenant"),
        F.to_date("occurred_at").alias("day"), "event_type",
    ).agg(
        F.sum("quantity").alias("quantity"),
        F.sum(F.col("unit_cost_cents").cast("bigint") * F.col("quantity")).alias("cents"),
        F.count(F.lit(1)).alias("events"),
    )
    sums = [F.sum(c).alias(c) for c in ("quantity", "cents", "events")]
    return daily, daily.groupBy("period", "tenant", "event_type").agg(*sums)


def _folders(spark: SparkSession, path: str) -> dict[str, object]:
    """Period folders of a roll-up (two years and a few) by their period, on any file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return {}
    found = {s.getPath().getName(): s.getPath() for s in fs.listStatus(place) if s.isDirectory()}
    return {name.removeprefix("period="): at for name, at in found.items() if name.startswith("period=")}


def write_rollups(events: DataFrame, path: str, as_of: str, reissue_days: int = 7, months: int = 24) -> None:
    """Bring the daily and monthly roll-ups under ``path`` up to ``as_of``.

    Files lie by period and tenant. A run issues again the months of the last
    ``reissue_days`` days, for corrections, and those since the last month written, which
    may have been partial; only the partitions it computes are replaced, so it can be
    repeated. Months out of the retention of ``months`` are deleted.
    """
    spark = events.sparkSession
    now = F.lit(as_of).cast("timestamp")
    first, since, limit = spark.range(1).select(
        F.date_format(F.add_months(F.date_trunc("month", now).cast("date"), 1 - months), "yyyy-MM"),
        F.date_format(F.date_sub(now.cast("date"), reissue_days), "yyyy-MM"), F.date_format(now, "yyyy-MM-dd HH:mm:ss"),
    ).first()
    written = [p for p in _folders(spark, f"{path}/monthly") if p >= first]
    begin = max(first, min([since, max(written)])) if written else first
    held = events.where((F.col("occurred_at") >= F.lit(f"{begin}-01").cast("timestamp")) & (F.col("occurred_at") <= F.lit(limit).cast("timestamp")))
    for name, rows in zip(("daily", "monthly"), rollup_usage(held, as_of, months), strict=True):
        (
            rows.repartition("period", "tenant").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("period", "tenant").parquet(f"{path}/{name}")
        )
        for period, place in _folders(spark, f"{path}/{name}").items():
            if period < first:
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def apply_schema_version(items: DataFrame) -> DataFrame:
    """Old rows lack ``event_at`` and ``superseded``: fill them with null and false."""
    empty = items.sparkSession.createDataFrame([], "event_at timestamp, superseded boolean")
    return items.unionByName(empty, allowMissingColumns=True).withColumn(
        "superseded", F.coalesce("superseded", F.lit(False))
    )


def seed_namespaces(users: DataFrame, items: DataFrame, facts: list[str] | None = None) -> DataFrame:
    """Starter facts for namespaces that hold no item yet."""
    texts = F.array(*[F.lit(t) for t in facts or lx.STARTER_FACTS])
    have = items.select("namespace").distinct()
    return users.select("namespace").distinct().join(have, "namespace", "left_anti").select(
        "namespace", F.posexplode(texts).alias("seq", "text")
    )


def resolve_namespace(df: DataFrame, aliases: DataFrame, col: str = "namespace") -> DataFrame:
    """Replace aliases by their canonical namespace; unknown names stay."""
    a = aliases.select(F.col("alias").alias(col), "canonical")
    return df.join(a, col, "left").withColumn(col, F.coalesce("canonical", F.col(col))).drop("canonical")


def add_aliases(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """First definition of an alias wins."""
    return append_new(aliases, new, ["alias"], [F.asc("canonical")])


def canonical_namespace(user_id: Column) -> Column:
    """The whole id: users that share a beginning never share a namespace."""
    return F.concat(F.lit("user-"), user_id.cast("string"))
