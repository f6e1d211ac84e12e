"""Fact de-duplication, surprise, damage and memory state as set operations.

All operators follow the batch contract: while a corpus loads every earlier distinct
fact counts as alive, so surprise and damage are joins and windows over ``seq`` instead
of a replay of single writes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallflow.functions import lexicon as lx
from recallflow.functions import text as tx
from recallflow.operators.scans import numbered, running_sum, top_k
from recallflow.session import stored

SEQ_BUCKET = 65536
WITNESSES = 64
BLOCK = 256
DAMAGE_MOST = 2.0


def _seq_bucket() -> Column:
    return F.floor(F.col("seq") / SEQ_BUCKET)


def derive_facts(memories: DataFrame) -> DataFrame:
    """Add subject, relation, value, override and the index tokens of the text."""
    words = memories.withColumn("_w", tx.clean_words(F.lower("text")))
    return words.withColumn("_f", tx.auto_fact(F.col("text"), F.col("_w"))).select(
        "*",
        "_f.subject",
        "_f.relation",
        "_f.value",
        "_f.override",
        tx.by_length(tx.token_set_of(F.col("_w"))).alias("tokens"),
    ).drop("_f", "_w")


def dedup_facts(facts: DataFrame) -> DataFrame:
    """Keep the first of equal (namespace, S, R, V); later copies become retrievals.

    Only digests and sequence numbers are grouped (a hot group of copies collapses
    map-side); texts are fetched by an equi-join afterwards. Rows without any fact field
    never merge.
    """
    empty = (F.col("subject") == "") & (F.col("relation") == "") & (F.col("value") == "")
    digest = F.md5(F.concat_ws("\u0001", "subject", "relation", "value"))
    keyed = facts.select(
        "namespace", "seq", digest.alias("_d"), F.when(empty, F.col("seq")).alias("_own")
    )
    first = keyed.groupBy("namespace", "_d", "_own").agg(
        F.min("seq").alias("seq"), (F.count(F.lit(1)) - 1).alias("retrieval_count")
    )
    return facts.join(first.select("namespace", "seq", "retrieval_count"), ["namespace", "seq"])


def _block_surprise(pdf: pd.DataFrame) -> pd.DataFrame:
    """Largest divergence of each target row from earlier rows of one block pair.

    A pair holds at most 2 x BLOCK rows; Jaccard comes from one 0/1 matrix product.
    """
    targets = pdf[pdf["is_target"]]
    earlier = pdf[~pdf["is_target"]]
    if targets.empty or earlier.empty:
        return pd.DataFrame({"namespace": [], "seq": [], "divergence": []})
    vocab: dict[str, int] = {}
    for grams in pdf["grams"]:
        for g in grams:
            vocab.setdefault(g, len(vocab))

    def incidence(rows: pd.DataFrame) -> np.ndarray:
        m = np.zeros((len(rows), len(vocab)), dtype=np.float32)
        for i, grams in enumerate(rows["grams"]):
            m[i, [vocab[g] for g in grams]] = 1.0
        return m

    t, e = incidence(targets), incidence(earlier)
    shared = (t @ e.T).astype(np.float64)
    union = t.sum(1)[:, None] + e.sum(1)[None, :] - shared
    div = 1.0 - shared / union
    div[earlier["seq"].to_numpy()[None, :] >= targets["seq"].to_numpy()[:, None]] = -1.0
    best = div.max(axis=1)
    hit = best >= 0
    return pd.DataFrame(
        {
            "namespace": targets["namespace"].to_numpy()[hit],
            "seq": targets["seq"].to_numpy()[hit],
            "divergence": best[hit],
        }
    )


def surprise_structured(facts: DataFrame) -> DataFrame:
    """Surprise of every de-duplicated fact with a subject and a relation.

    Returns (namespace, seq, contradicted, surprise). The facts contradicted by a row are
    all earlier rows of its (namespace, subject, relation) group, so they are given by
    their number and never materialised as pairs.

    The largest divergence is found in two exact steps. Each row is compared with the
    first WITNESSES rows of its group, carried as one bounded array. A row is finished
    when all its predecessors were witnesses or when it reached the maximum of 1. Rows
    still open (long, similar values in a large group) are compared block against block.
    """
    keys = ["namespace", "subject", "relation"]
    base = facts.where((F.col("subject") != "") & (F.col("relation") != "")).select(
        "namespace", "subject", "relation", "seq", "override", "value"
    )
    # Groups of one row have nothing to contradict: settle them before any bigram work.
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    shared = base.join(sizes, keys).drop("_n")
    ranked = stored(
        numbered(shared, keys, ["seq"], _seq_bucket()).withColumn("grams", tx.bigrams(F.col("value"))).drop("value")
    )
    first = (
        ranked.where(F.col("rank") <= WITNESSES)
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("seq", "grams")).alias("wit"))
    )
    best = F.aggregate(
        "wit",
        F.lit(0.0),
        lambda acc, w: F.when(
            w["seq"] < F.col("seq"),
            F.greatest(acc, tx.set_divergence(F.col("grams"), w["grams"])),
        ).otherwise(acc),
    )
    step1 = stored(ranked.join(first, keys).withColumn("divergence", best).drop("wit"))
    unsettled = (
        (F.col("rank") > WITNESSES + 1) & (F.col("divergence") < 1.0) & ~F.col("override")
    )
    if step1.where(unsettled).isEmpty():
        return _settled(base, step1.withColumn("exact", F.lit(0.0)))
    block = F.floor((F.col("rank") - 1) / BLOCK)
    held = step1.withColumn("block", block)
    open_rows = held.where(unsettled)
    open_blocks = open_rows.select(*keys, F.col("block").alias("t_block")).distinct()
    earlier = (
        held.join(open_blocks, keys)
        .where(F.col("block") <= F.col("t_block"))
        .select(*keys, "t_block", F.col("block").alias("e_block"), "seq", "grams", F.lit(False).alias("is_target"))
    )
    targets = open_rows.select(
        *keys,
        F.col("block").alias("t_block"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("block"))).alias("e_block"),
        "seq",
        "grams",
        F.lit(True).alias("is_target"),
    )
    step2 = (
        targets.unionByName(earlier)
        .groupBy(*keys, "t_block", "e_block")
        .applyInPandas(_block_surprise, "namespace string, seq bigint, divergence double")
        .groupBy("namespace", "seq")
        .agg(F.max("divergence").alias("exact"))
    )
    return _settled(base, step1.join(step2, ["namespace", "seq"], "left"))


def _settled(base: DataFrame, rows: DataFrame) -> DataFrame:
    sigma = F.when(F.col("override"), lx.SIGMA_MAX).otherwise(
        F.greatest("divergence", F.coalesce("exact", F.lit(0.0))) * lx.SIGMA_MAX
    )
    found = rows.select(
        "namespace",
        "seq",
        (F.col("rank") - 1).alias("contradicted"),
        F.when(F.col("rank") > 1, sigma).otherwise(0.0).alias("surprise"),
    )
    return base.select("namespace", "seq").join(found, ["namespace", "seq"], "left").select(
        "namespace",
        "seq",
        F.coalesce("contradicted", F.lit(0)).alias("contradicted"),
        F.coalesce("surprise", F.lit(0.0)).alias("surprise"),
    )


def tau_of(override: Column) -> Column:
    return F.when(override, lx.TAU_OVERRIDE).otherwise(lx.TAU_DEFAULT)


def _impact(surprise: Column, override: Column) -> Column:
    level = F.least(surprise / lx.SIGMA_MAX, F.lit(1.0))
    return F.when(override, 1.5).otherwise(1.0) / (1 + F.exp(-10 * (level - 0.5)))


def _tau_factor(tau_new: float, tau_old: Column) -> Column:
    return F.least(F.lit(tau_new) / F.greatest(tau_old, F.lit(1e-6)), F.lit(4.0)) / 4 + 0.5


def _enough() -> int:
    """Contradictions that do ``DAMAGE_MOST`` together, however slight each of them is: token
    sets that contradict share 0.8 at most, so the surprise is over 0.19 of the largest."""
    least = 1 / (1 + math.exp(-10 * (0.19 - 0.5))) * (min(lx.TAU_DEFAULT / lx.TAU_OVERRIDE, 4.0) / 4 + 0.5)
    return math.ceil(DAMAGE_MOST / least) + 1


def _suffix_damage(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Damage every ``is_old`` row takes from later ``is_new`` rows with the same keys.

    An impact depends on the newer row alone, apart from a factor of the two time scales,
    so two running sums from the end replace the pairs.
    """
    hit = F.when(F.col("is_new"), _impact(F.col("surprise"), F.col("override"))).otherwise(0.0)
    sums = {
        "_plain": F.when(F.col("override"), 0.0).otherwise(hit),
        "_over": F.when(F.col("override"), hit).otherwise(0.0),
    }
    run = running_sum(
        rows, keys, ["seq"], _seq_bucket(), sums, inclusive=False, descending=True
    ).where("is_old")
    tau = tau_of(F.col("override"))
    total = F.col("_plain") * _tau_factor(lx.TAU_DEFAULT, tau) + F.col("_over") * _tau_factor(
        lx.TAU_OVERRIDE, tau
    )
    return run.select("namespace", "seq", total.alias("damage"))


def schema_resistance(delta_f: Column, glass: Column) -> Column:
    """Factor by which a schema weakens damage; 1 for other items."""
    base = 1 / (1 + F.abs(delta_f))
    return F.when(delta_f.isNull(), 1.0).otherwise(F.when(glass, base * 0.1).otherwise(base))


def surprise_damage(facts: DataFrame, surprise: DataFrame) -> DataFrame:
    """Total damage per structured fact, at most 2.0."""
    rows = (
        facts.where((F.col("subject") != "") & (F.col("relation") != ""))
        .select("namespace", "subject", "relation", "seq", "override")
        .join(surprise.select("namespace", "seq", "surprise"), ["namespace", "seq"])
        .withColumns({"is_new": F.lit(True), "is_old": F.lit(True)})
    )
    out = _suffix_damage(rows, ["namespace", "subject", "relation"])
    return out.withColumn("damage", F.least(F.lit(2.0), "damage"))


# --- token path: facts without subject or relation -------------------------


def token_classes(items: DataFrame) -> DataFrame:
    """One row per distinct token set: copies of a text collapse before any comparison."""
    rows = items.where(F.size("tokens") > 0).withColumn("tokens", F.array_sort("tokens"))
    # The tokens are a key, not a minimum: least arrays would have every row sorted.
    rows = rows.withColumn("cls", F.md5(F.array_join("tokens", "\u0001")))
    return rows.groupBy("namespace", "cls", "tokens").agg(
        F.min("seq").alias("first_seq"),
        F.count(F.lit(1)).alias("members"),
        F.max("is_probe").alias("has_probe"),
    ).select("namespace", "cls", "first_seq", "members", "tokens", "has_probe")


def similar_classes(classes: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Pairs (cls, other) of distinct token sets with Jaccard above ``threshold``.

    Prefix filter: with tokens in rarest-first order two sets above the threshold must
    share one of their first ``n - ceil(threshold * n) + 1`` tokens, so frequent tokens
    are seldom joined on. ``cls`` ranges over classes that hold a probe.
    """
    sized = classes.withColumn("n", F.size("tokens"))
    # A set more than 1/threshold times larger than every probe cannot be similar to one.
    reach = sized.where("has_probe").groupBy("namespace").agg(F.max("n").alias("_widest"))
    fitting = sized.join(reach, "namespace").where(F.col("n") * threshold <= F.col("_widest"))
    tok = fitting.select("namespace", "cls", "has_probe", "n", F.explode("tokens").alias("token"))
    freq = tok.groupBy("namespace", "token").agg(F.count(F.lit(1)).alias("f"))
    ranked = (
        tok.join(freq, ["namespace", "token"])
        .groupBy("namespace", "cls", "has_probe", "n")
        .agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("o"))
    )
    cutoff = (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int")
    prefix = ranked.select(
        "namespace", "cls", "has_probe", "n",
        F.explode(F.transform(F.slice("o", F.lit(1), cutoff), lambda s: s["token"])).alias("token"),
    )
    left = prefix.where("has_probe").select("namespace", "cls", "n", "token")
    right = prefix.select(
        "namespace", F.col("cls").alias("other"), F.col("n").alias("m"), "token"
    )
    near = (
        left.join(right, ["namespace", "token"])
        .where((F.col("cls") != F.col("other")) & (F.least("n", "m") > threshold * F.greatest("n", "m")))
        .select("namespace", "cls", "other").distinct()
    )
    a = classes.select("namespace", "cls", F.col("tokens").alias("ta"))
    b = classes.select("namespace", F.col("cls").alias("other"), F.col("tokens").alias("tb"), F.col("first_seq").alias("other_first"))
    j = F.lit(1.0) - tx.set_divergence(F.col("ta"), F.col("tb"))
    return (
        near.join(a, ["namespace", "cls"]).join(b, ["namespace", "other"])
        .select("namespace", "cls", "other", "other_first", j.alias("jaccard"))
        .where(F.col("jaccard") > threshold)
    )


def surprise_tokens(items: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Token-overlap surprise for probe rows (facts without subject or relation).

    ``items`` has (namespace, seq, tokens, override, is_probe). Returns per probe whether
    it is dropped (confirmed, nothing contradicted), its surprise, and the number of
    distinct earlier token sets it confirms and contradicts. Everything is decided per
    class of equal token sets, so a hot group of copies costs one comparison; a row then
    reads its own value from a short step table of its class.
    """
    items = items.withColumn("cls", F.md5(F.array_join(F.array_sort("tokens"), "\u0001")))
    classes = stored(token_classes(items))
    edges = stored(similar_classes(classes)) if edges is None else edges
    contra = edges.where(F.col("jaccard") <= 0.8).select(
        "namespace", "cls", "other_first", (1 - F.col("jaccard")).alias("gap")
    )
    steps = (
        contra.groupBy("namespace", "cls", "gap").agg(F.min("other_first").alias("since"))
        .groupBy("namespace", "cls")
        .agg(F.collect_list(F.struct("since", "gap")).alias("steps"))
    )
    confirm = edges.where(F.col("jaccard") > 0.8).groupBy("namespace", "cls").agg(
        F.min("other_first").alias("confirm_since")
    )
    own = classes.select("namespace", "cls", "first_seq")
    probes = items.where("is_probe").join(own, ["namespace", "cls"], "left").join(
        steps, ["namespace", "cls"], "left"
    ).join(confirm, ["namespace", "cls"], "left")
    gap = F.aggregate(
        F.coalesce("steps", F.array().cast("array<struct<since:bigint,gap:double>>")),
        F.lit(0.0),
        lambda acc, s: F.when(s["since"] < F.col("seq"), F.greatest(acc, s["gap"])).otherwise(acc),
    )
    confirmed = (F.col("first_seq") < F.col("seq")) | (
        F.coalesce(F.col("confirm_since") < F.col("seq"), F.lit(False))
    )
    out = probes.withColumn("gap", gap).withColumn(
        "confirmed", F.coalesce(confirmed, F.lit(False))
    )
    contradicted = F.col("gap") > 0
    sigma = F.when(contradicted & F.col("override"), lx.SIGMA_MAX).otherwise(
        F.col("gap") * lx.SIGMA_MAX
    )
    return out.select(
        "namespace",
        "seq",
        "cls",
        "override",
        "confirmed",
        contradicted.alias("contradicts"),
        (F.col("confirmed") & ~contradicted).alias("dropped"),
        sigma.alias("surprise"),
    )


def token_damage(items: DataFrame, surprise: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Damage on every item from later probes that contradict its token set.

    Damage ends at ``DAMAGE_MOST``. The latest :func:`_enough` probes of a class, and then of
    all classes that contradict a token set, decide every sum that stays below; what is
    older than the last of them has the most there is, without a sum.
    """
    items = items.withColumn("cls", F.md5(F.array_join(F.array_sort("tokens"), "\u0001")))
    edges = stored(similar_classes(stored(token_classes(items)))) if edges is None else edges
    contra = edges.where(F.col("jaccard") <= 0.8).select("namespace", "cls", "other")
    latest = surprise.where("contradicts").select("namespace", "cls", "seq", "surprise", "override")
    latest = top_k(latest, ["namespace", "cls"], [F.desc("seq")], _enough()).drop("rank")
    found = latest.join(contra, ["namespace", "cls"]).select("namespace", F.col("other").alias("target"), "seq", "surprise", "override")
    news = stored(top_k(found, ["namespace", "target"], [F.desc("seq")], _enough()))
    full = news.where(F.col("rank") == _enough()).select("namespace", "target", F.col("seq").alias("_full"))
    olds = items.select("namespace", F.col("cls").alias("target"), "seq", "override").join(full, ["namespace", "target"], "left")
    most = F.coalesce(F.col("seq") < F.col("_full"), F.lit(False))
    open_ = olds.where(~most).select(
        "namespace", "target", "seq", F.lit(0.0).alias("surprise"), "override",
        F.lit(False).alias("is_new"), F.lit(True).alias("is_old"),
    )
    news = news.drop("rank").withColumns({"is_new": F.lit(True), "is_old": F.lit(False)})
    out = _suffix_damage(news.unionByName(open_), ["namespace", "target"])
    out = out.withColumn("damage", F.least(F.lit(DAMAGE_MOST), "damage"))
    return out.unionByName(olds.where(most).select("namespace", "seq", F.lit(DAMAGE_MOST).alias("damage")))


# --- state equations -------------------------------------------------------


def strength_expr(delta: Column, tau: Column, retrievals: Column, damage: Column) -> Column:
    s = F.exp(-delta / F.greatest(tau, F.lit(1e-6))) * (1 + lx.BETA * F.log1p(retrievals)) - damage
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def upkeep_expr(info_bits: Column, tau: Column) -> Column:
    return lx.KT * lx.LN2 * info_bits / F.greatest(tau, F.lit(1e-6))


def free_energy_expr(s: Column, surprise: Column, bits: Column, rho: Column, upkeep: Column) -> Column:
    return (1 - s) - surprise * bits * F.greatest(rho, F.lit(1e-9)) + lx.LAMBDA * upkeep


def safe_energy(fe: Column) -> Column:
    """Free energy used for ranking: 0 for null, NaN and infinities."""
    bad = fe.isNull() | F.isnan(fe) | (F.abs(fe) == float("inf"))
    return F.when(bad, 0.0).otherwise(fe)


def phase_expr(s: Column, is_schema: Column, glass: Column) -> Column:
    return (
        F.when(is_schema & glass, "glass")
        .when(is_schema, "solid")
        .when(s >= lx.STRENGTH_FLOOR, "liquid")
        .otherwise("gas")
    )


def is_glass(history: Column) -> Column:
    """Entropy history converged: four values or more, last three within 1 %."""
    last = F.slice(history, F.greatest(F.size(history) - 2, F.lit(1)), F.lit(3))
    mean = F.aggregate(last, F.lit(0.0), lambda a, v: a + v) / 3
    var = F.aggregate(last, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / 3
    return F.coalesce(
        (F.size(history) >= 4) & ((mean < 1e-9) | (F.sqrt(var) / mean < 0.01)), F.lit(False)
    )


def is_glass_view(history: Column) -> Column:
    """Looser definition of the browsing view: three values within 1 % of their mean."""
    last = F.slice(history, F.greatest(F.size(history) - 2, F.lit(1)), F.lit(3))
    mean = F.aggregate(last, F.lit(0.0), lambda a, v: a + v) / 3
    off = F.array_max(F.transform(last, lambda v: F.abs(v - mean)))
    return F.coalesce((F.size(history) >= 3) & (mean > 0) & (off / mean < 0.01), F.lit(False))


def susceptibility(phase: Column, delta_f: Column) -> Column:
    room = F.greatest(F.abs(F.coalesce(delta_f, F.lit(0.0))), F.lit(0.1))
    return (
        F.when(phase == "glass", F.least(F.lit(1.3), 1 + 0.2 / room))
        .when(phase == "solid", F.least(F.lit(1.2), 1 + 0.1 / room))
        .when(phase == "gas", 0.7)
        .otherwise(1.0)
    )


def field_radius(tokens: Column, s: Column) -> Column:
    """Leading tokens that stay indexed at strength ``s``; one for faded items."""
    n = F.size(tokens)
    reach = F.when(s < lx.STRENGTH_FLOOR, 1).otherwise(
        F.greatest(F.lit(1), F.floor(n * F.pow(s, F.lit(1.0 / 3.0))))
    )
    return F.slice(tokens, F.lit(1), reach.cast("int"))


def memory_state(facts: DataFrame, now_seq: int | None = None) -> DataFrame:
    """De-duplicate, score contradictions and derive the state of every memory.

    ``facts`` comes from :func:`derive_facts`. The clock is the largest ``seq`` of the
    namespace unless ``now_seq`` is given.
    """
    facts = stored(facts)
    kept = stored(dedup_facts(facts))
    structured = stored(surprise_structured(kept))
    probe = (F.col("subject") == "") | (F.col("relation") == "")
    pool = kept.select("namespace", "seq", "tokens", "override", probe.alias("is_probe"))
    edges = stored(similar_classes(token_classes(pool)))
    loose = stored(surprise_tokens(pool, edges))
    sigma = F.col("surprise").alias("_sigma")
    found = structured.select("namespace", "seq", sigma).unionByName(
        loose.select("namespace", "seq", sigma)
    )
    hits = (
        surprise_damage(kept, structured)
        .unionByName(token_damage(pool, loose, edges))
        .groupBy("namespace", "seq")
        .agg(F.least(F.lit(2.0), F.sum("damage")).alias("damage"))
    )
    dropped = loose.where("dropped").select("namespace", "seq")
    live = (
        kept.join(dropped, ["namespace", "seq"], "left_anti")
        .join(found, ["namespace", "seq"], "left")
        .join(hits, ["namespace", "seq"], "left")
    )
    live = live.drop("surprise") if "surprise" in live.columns else live
    clock = facts.groupBy("namespace").agg(F.max("seq").alias("_last"))
    counts = live.groupBy("namespace").agg((F.count(F.lit(1)) / lx.CAPACITY).alias("rho"))
    now = F.lit(now_seq) if now_seq is not None else F.col("_last")
    bits = tx.char_entropy(tx.fact_text(F.col("subject"), F.col("relation"), F.col("value")))
    out = (
        live.join(clock.join(counts, "namespace"), "namespace")
        .withColumn("tau", tau_of(F.col("override")))
        .withColumn("surprise_at_birth", F.coalesce("_sigma", F.lit(0.0)))
        .withColumn("damage", F.coalesce("damage", F.lit(0.0)))
        .withColumn("info_bits", bits)
        .withColumn("upkeep", upkeep_expr(F.col("info_bits"), F.col("tau")))
        .withColumn(
            "strength",
            strength_expr(now - F.col("seq"), F.col("tau"), F.col("retrieval_count"), F.col("damage")),
        )
        .withColumn(
            "free_energy",
            free_energy_expr(
                F.col("strength"), F.col("surprise_at_birth"), F.col("info_bits"), F.col("rho"), F.col("upkeep")
            ),
        )
        .withColumn("phase", phase_expr(F.col("strength"), F.lit(False), F.lit(False)))
    )
    return out.select(
        "mem_id", "namespace", "seq", "text", "subject", "relation", "value", "override", "tokens",
        "tau", "retrieval_count", "surprise_at_birth", "damage", "info_bits", "upkeep", "rho",
        "strength", "free_energy", "phase",
    )


def birth_density(items: DataFrame) -> DataFrame:
    """Items alive before each item, over capacity."""
    run = running_sum(
        items, ["namespace"], ["seq"], _seq_bucket(), {"_before": F.lit(1)}, inclusive=False
    )
    return run.withColumn("rho_at_birth", F.col("_before") / lx.CAPACITY).drop("_before")


def drop_dead(state: DataFrame) -> DataFrame:
    return state.where(F.col("strength") >= lx.STRENGTH_FLOOR)


def rehearse(state: DataFrame, n: int = 50) -> DataFrame:
    """One more retrieval for the ``n`` least recalled, oldest items per namespace."""
    picked = top_k(
        state.select("namespace", "seq", "retrieval_count"),
        ["namespace"], [F.asc("retrieval_count"), F.asc("seq")], n,
    ).select("namespace", "seq", F.lit(1).alias("_r"))
    return reinforce(state, picked, "_r")


def reinforce(state: DataFrame, hits: DataFrame, by: str = "hits") -> DataFrame:
    """Add retrievals counted in ``hits`` (namespace, seq, count column)."""
    out = state.join(hits.select("namespace", "seq", F.col(by).alias("_h")), ["namespace", "seq"], "left")
    return out.withColumn("retrieval_count", F.col("retrieval_count") + F.coalesce("_h", F.lit(0))).drop("_h")


def phase_stats(state: DataFrame) -> DataFrame:
    """Counts per phase and averages per namespace."""

    def n(p: str) -> Column:
        return F.sum((F.col("phase") == p).cast("bigint"))

    return state.groupBy("namespace").agg(
        F.count(F.lit(1)).alias("items"),
        n("gas").alias("gas"),
        n("liquid").alias("liquid"),
        n("solid").alias("solid"),
        n("glass").alias("glass"),
        (F.sum((F.col("strength") >= lx.STRENGTH_FLOOR).cast("bigint")) / lx.CAPACITY).alias("rho"),
        F.sum("free_energy").alias("total_free_energy"),
        F.avg("strength").alias("avg_strength"),
        F.avg("tau").alias("avg_tau"),
    )


def namespace_overview(state: DataFrame) -> DataFrame:
    return state.groupBy("namespace").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum((F.col("phase") == "liquid").cast("bigint")).alias("liquid"),
        F.sum((F.col("phase") == "gas").cast("bigint")).alias("gas"),
        F.max_by("text", "seq").alias("latest_text"),
    )


def phase_samples(state: DataFrame, n: int = 30) -> DataFrame:
    return top_k(state, ["namespace", "phase"], [F.desc("seq")], n)


def strongest(state: DataFrame, n: int = 20) -> DataFrame:
    """Chat view: strongest items per namespace."""
    return top_k(state, ["namespace"], [F.desc("strength"), F.asc("seq")], n)


def to_level(state: DataFrame) -> DataFrame:
    """Storage record of a memory: level by phase, clipped confidence and object."""
    level = (
        F.when(F.col("strength") < lx.STRENGTH_FLOOR, "L0")
        .when(F.col("phase").isin("solid", "glass"), "L2")
        .otherwise("L1")
    )
    return state.select(
        "mem_id", "namespace", "seq", "text",
        level.alias("store_level"),
        F.least(F.lit(1.0), "strength").alias("confidence"),
        F.col("surprise_at_birth").alias("salience"),
        F.col("retrieval_count").alias("usage_count"),
        F.col("surprise_at_birth").alias("surprise"),
        F.nullif("subject", F.lit("")).alias("subject"),
        F.nullif("relation", F.lit("")).alias("predicate"),
        F.nullif(F.substring("value", 1, 256), F.lit("")).alias("object"),
    )


# --- promotion and decay ---------------------------------------------------


def promotion_score() -> Column:
    w = lx.PLASTICITY
    raw = (
        w["salience"] * F.col("salience")
        + w["usage"] * F.log1p("usage_count")
        + w["authority"] * F.col("authority")
        - w["conflict"] * F.col("conflict_score")
        + w["surprise"] * F.col("surprise")
    )
    return F.greatest(F.lit(0.0), raw)


def promote(memories: DataFrame, as_of: str) -> DataFrame:
    """Score and the levels an item qualifies for at ``as_of``."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("ts")) / 86400e6
    score = promotion_score()
    l2 = (
        (score >= lx.L2_THRESHOLD)
        & (F.col("confidence") >= lx.L2_MIN_CONFIDENCE)
        & F.col("ts").isNotNull()
        & (age >= lx.L2_MIN_DAYS)
    )
    return memories.withColumns(
        {
            "promotion_score": score,
            "to_l1": score >= lx.L1_THRESHOLD,
            "to_l2": F.coalesce(l2, F.lit(False)),
            "to_l3": F.coalesce(l2, F.lit(False)),
        }
    )


def decay(memories: DataFrame, k: float = lx.DECAY_K) -> DataFrame:
    return memories.withColumns(
        {
            "salience": F.greatest(F.lit(0.0), F.col("salience") * (1 - k)),
            "confidence": F.greatest(F.lit(0.0), F.col("confidence") * (1 - 0.5 * k)),
        }
    )


def prune(memories: DataFrame) -> DataFrame:
    return memories.where(F.col("salience") >= lx.PRUNE_SALIENCE)
