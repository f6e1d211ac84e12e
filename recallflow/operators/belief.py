"""Conflict, merge and supersession decisions between an old and a new memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallflow.functions import lexicon as lx
from recallflow.functions import text as tx
from recallflow.functions import vectors as vx


def similarity(a: Column, b: Column) -> Column:
    """Damped cosine; 0 when either embedding is missing."""
    missing = a.isNull() | b.isNull() | (F.size(a) <= 0) | (F.size(b) <= 0)
    return F.when(missing, 0.0).otherwise(vx.cosine_damped(a, b))


def conflict_score(new_text: Column, old_text: Column, sim: Column) -> Column:
    a = F.array_distinct(tx.split_words(F.lower(new_text)))
    b = F.array_distinct(tx.split_words(F.lower(old_text)))
    shared = F.size(F.array_intersect(a, b))
    overlap = shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1))
    return F.when(sim < lx.SIMILARITY_THRESHOLD, 0.0).when((overlap < 0.3) & (sim > 0.7), 0.5).otherwise(0.0)


def should_merge(sim: Column, conflict: Column) -> Column:
    return (sim >= lx.SIMILARITY_THRESHOLD) & (conflict < lx.CONFLICT_THRESHOLD)


def should_overwrite(conflict: Column, n_evidence: Column) -> Column:
    quorum = F.least(F.lit(1.0), F.round(n_evidence * 0.2, 9))
    return (conflict < lx.CONFLICT_THRESHOLD) | ((n_evidence > 0) & (quorum >= lx.QUORUM_THRESHOLD))


def judge(pairs: DataFrame) -> DataFrame:
    """Add similarity, conflict and both decisions to (new_*, old_*, n_evidence) rows."""
    out = pairs.withColumn("similarity", similarity(F.col("new_embedding"), F.col("old_embedding")))
    out = out.withColumn("conflict", conflict_score(F.col("new_text"), F.col("old_text"), F.col("similarity")))
    return out.withColumns(
        {
            "merge": should_merge(F.col("similarity"), F.col("conflict")),
            "overwrite": should_overwrite(F.col("conflict"), F.col("n_evidence")),
        }
    )


def revise(new: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current rows, archived rows) after belief revision.

    ``new`` has (old_id, mem_id, text, embedding, n_evidence); ``old`` has (mem_id, text,
    embedding, lineage, version). Accepted revisions carry the old lineage on with
    authority 1.0; refused ones leave the old row current. A row without an old embedding
    is accepted.
    """
    o = old.select(
        F.col("mem_id").alias("old_id"), F.col("text").alias("old_text"), F.col("embedding").alias("old_embedding"),
        F.col("lineage").alias("_lineage"), F.col("version").alias("_version"),
    )
    pairs = new.withColumnsRenamed({"text": "new_text", "embedding": "new_embedding"}).join(o, "old_id", "left")
    j = judge(pairs)
    bare = F.col("old_embedding").isNull() | (F.size("old_embedding") <= 0)
    ok = F.coalesce(bare | F.col("overwrite"), F.lit(True))
    none = F.array().cast("array<string>")
    # A missing old embedding skips the gate, and then no lineage is taken over.
    current = j.select(
        F.when(ok, F.col("mem_id")).otherwise(F.col("old_id")).alias("mem_id"),
        F.when(ok, F.col("new_text")).otherwise(F.col("old_text")).alias("text"),
        F.when(ok & ~bare, F.concat(F.coalesce("_lineage", none), F.array("old_id"))).when(ok, none).otherwise(F.coalesce("_lineage", none)).alias("lineage"),
        F.when(ok & ~bare, F.col("_version") + 1).when(ok, 1).otherwise(F.col("_version")).alias("version"),
        F.when(ok, 1.0).alias("authority"),
        ok.alias("accepted"),
    )
    archived = old.join(j.where(ok & ~bare).select(F.col("old_id").alias("mem_id")), "mem_id", "left_semi")
    return current, archived


def mark_superseded(items: DataFrame) -> DataFrame:
    """Facts with a newer event date on the same subject and relation.

    Only the newest date of a group decides, so this is one aggregation joined back: no
    pairs, and a hot group collapses map-side. Unknown dates count as older.
    """
    key = ["namespace", "subject", "relation"]
    dated = items.where((F.col("subject") != "") & (F.col("relation") != ""))
    newest = dated.groupBy(*key).agg(F.max("event_at").alias("_newest"))
    out = items.join(newest, key, "left")
    older = F.col("_newest").isNotNull() & (F.col("event_at").isNull() | (F.col("event_at") < F.col("_newest")))
    return out.withColumn("superseded", F.coalesce(older, F.lit(False))).drop("_newest")


def mark_superseded_gated(items: DataFrame) -> DataFrame:
    """As :func:`mark_superseded`, but a newer fact in conflict with an old one (same
    topic, other words) does not supersede it. Needs ``embedding``.

    Any newer fact without a conflict supersedes, so each row is compared with the facts
    of its own group that are newer, up to the first such one; pairs are never rows. Only
    rows in conflict with all newer facts of their group are compared with all of them.
    """
    key = ["namespace", "subject", "relation"]
    cols = [*key, "seq", "event_at", "text", "embedding"]
    base = items.where((F.col("subject") != "") & (F.col("relation") != ""))
    # Rows already at the newest date of their group cannot be superseded.
    flagged = mark_superseded(base)
    old = flagged.where("superseded").select(*cols)
    new = base.where(F.col("event_at").isNotNull()).select(
        *key, F.col("event_at").alias("_n_at"), F.col("text").alias("_n_text"), F.col("embedding").alias("_n_emb")
    )
    # A semi join leaves a row at the first newer fact that is free of conflict.
    later = F.col("event_at").isNull() | (F.col("event_at") < F.col("_n_at"))
    sim = similarity(F.col("_n_emb"), F.col("embedding"))
    same = [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(key)]
    new = new.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], "_n_at", "_n_text", "_n_emb")
    free = old.join(new, [*same, later, conflict_score(F.col("_n_text"), F.col("text"), sim) == 0], "left_semi")
    hit = free.select("namespace", "seq").distinct().withColumn("_hit", F.lit(True))
    return items.drop("superseded").join(hit, ["namespace", "seq"], "left").withColumn(
        "superseded", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")
