"""Queries over de-duplication, surprise, damage, state and promotion."""

from pyspark.sql import functions as F

from recallflow.functions import lexicon as lx
from recallflow.operators import strength as st
from recallflow.plans import oracle as o
from recallflow.plans.registry import query
from recallflow.session import stored
from recallflow.sources import adapters as ad

_F = o.facts("f", "memories", "namespace, seq")
_DEDUP = """first AS (SELECT namespace, min(seq) AS seq, count(*) - 1 AS retrieval_count FROM f
  GROUP BY namespace, subject, relation, value,
  CASE WHEN subject = '' AND relation = '' AND value = '' THEN seq END),
kept AS (SELECT f.*, retrieval_count FROM f JOIN first USING (namespace, seq))"""


def _facts(spark, sf):
    return st.derive_facts(ad.memories(spark, sf))


@query("strength_dedup", o.sql("memories", "SELECT namespace, seq, retrieval_count FROM kept", _F, _DEDUP))
def strength_dedup(spark, sf):
    return st.dedup_facts(_facts(spark, sf)).select("namespace", "seq", "retrieval_count")


# Part names give crowded fact groups: namespace = brand, "adjective noun" names repeat.
_PF = f"""pm AS (SELECT p_brand AS namespace, p_partkey AS seq, p_type || ' size ' || p_name || ' ' || p_size AS text FROM part)"""
_PFACTS = o.facts("f", "pm", "namespace, seq")


def _gram(s):
    return (
        f"CASE WHEN length({s}) < 2 THEN [{s}] ELSE list_distinct(list_transform(range(1, length({s})), "
        f"lambda i: {s}[i:i+1])) END"
    )


_SURPRISE = f"""g AS (SELECT *, {_gram('value')} AS gr FROM kept WHERE subject <> '' AND relation <> ''),
pr AS (SELECT i.namespace, i.seq, j.seq AS old, i.override, len(i.gr) + len(j.gr) AS n_both, len(list_intersect(i.gr, j.gr))::DOUBLE AS x
  FROM g i LEFT JOIN g j ON i.namespace = j.namespace AND i.subject = j.subject AND i.relation = j.relation AND j.seq < i.seq),
sp AS (SELECT namespace, seq, count(old) AS contradicted, coalesce(max(CASE WHEN override THEN {lx.SIGMA_MAX}
  ELSE (1 - x / (n_both - x)) * {lx.SIGMA_MAX} END) FILTER (WHERE old IS NOT NULL), 0) AS surprise FROM pr GROUP BY 1, 2)"""
_DAMAGE = f"""dm AS (SELECT j.namespace, j.seq, least(2.0, coalesce(sum(CASE WHEN i.seq IS NULL THEN 0 ELSE
  (CASE WHEN i.override THEN 1.5 ELSE 1.0 END) / (1 + exp(-10 * (least(s.surprise / {lx.SIGMA_MAX}, 1.0) - 0.5)))
  * (least((CASE WHEN i.override THEN 200 ELSE 50 END)::DOUBLE / (CASE WHEN j.override THEN 200 ELSE 50 END), 4.0) / 4 + 0.5) END), 0)) AS damage
  FROM g j LEFT JOIN g i ON i.namespace = j.namespace AND i.subject = j.subject AND i.relation = j.relation AND i.seq > j.seq
  LEFT JOIN sp s ON s.namespace = i.namespace AND s.seq = i.seq GROUP BY 1, 2)"""


def _part_facts(spark, sf):
    p = ad.table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("mem_id"),
        F.col("p_brand").alias("namespace"),
        F.col("p_partkey").alias("seq"),
        F.concat_ws(" ", "p_type", F.lit("size"), "p_name", F.col("p_size").cast("string")).alias("text"),
    )
    return st.derive_facts(p)


@query(
    "strength_surprise_parts",
    o.sql("", "SELECT namespace, seq, contradicted, round(surprise, 6) AS surprise FROM sp", _PF, _PFACTS, _DEDUP, _SURPRISE),
)
def strength_surprise_parts(spark, sf):
    s = st.surprise_structured(st.dedup_facts(_part_facts(spark, sf)))
    return s.withColumn("surprise", F.round("surprise", 6))


@query(
    "strength_surprise_documents",
    o.sql("memories", "SELECT namespace, seq, contradicted, round(surprise, 6) AS surprise FROM sp", _F, _DEDUP, _SURPRISE),
)
def strength_surprise_documents(spark, sf):
    s = st.surprise_structured(st.dedup_facts(_facts(spark, sf)))
    return s.withColumn("surprise", F.round("surprise", 6))


@query(
    "strength_damage_parts",
    o.sql("", "SELECT namespace, seq, round(damage, 6) AS damage FROM dm", _PF, _PFACTS, _DEDUP, _SURPRISE, _DAMAGE),
)
def strength_damage_parts(spark, sf):
    kept = st.dedup_facts(_part_facts(spark, sf))
    d = st.surprise_damage(kept, st.surprise_structured(kept))
    return d.withColumn("damage", F.round("damage", 6))


# Token path: part names as loose two-word texts, every row a probe.
_LOOSE = """lm AS (SELECT p_brand AS namespace, p_partkey AS seq, p_name AS text FROM part)"""
_LTOK = o.tokens("lt", "lm", "namespace, seq")
_LSET = f"""ls AS (SELECT namespace, seq, list(token ORDER BY token) AS t FROM lt GROUP BY 1, 2),
lp AS (SELECT i.namespace, i.seq, j.seq AS old, len(list_intersect(i.t, j.t))::DOUBLE
  / (len(i.t) + len(j.t) - len(list_intersect(i.t, j.t))) AS jac FROM ls i JOIN ls j
  ON i.namespace = j.namespace AND j.seq < i.seq),
lr AS (SELECT i.namespace, i.seq, count(*) FILTER (WHERE jac > 0.8) > 0 AS confirmed,
  count(*) FILTER (WHERE jac > 0.25 AND jac <= 0.8) > 0 AS contradicts,
  coalesce(max(1 - jac) FILTER (WHERE jac > 0.25 AND jac <= 0.8), 0) * {lx.SIGMA_MAX} AS surprise
  FROM ls i LEFT JOIN lp p USING (namespace, seq) GROUP BY 1, 2)"""


def _loose(spark, sf):
    from recallflow.functions import text as tx

    parts = ad.table(spark, sf, "part").select("p_brand", "p_partkey", "p_name")
    # Names repeat: each one is tokenised once, the rows are read three times.
    names = stored(parts.select(F.col("p_name").alias("text")).distinct().withColumn("tokens", tx.tokenize(F.col("text"))))
    return stored(parts.join(names, F.col("p_name").eqNullSafe(F.col("text"))).select(
        F.col("p_brand").alias("namespace"),
        F.col("p_partkey").alias("seq"),
        "tokens",
        F.lit(False).alias("override"),
        F.lit(True).alias("is_probe"),
    ))


@query(
    "strength_surprise_tokens",
    o.sql("", """SELECT namespace, seq, confirmed, contradicts, confirmed AND NOT contradicts AS dropped,
      round(surprise, 6) AS surprise FROM lr""", _LOOSE, _LTOK, _LSET),
)
def strength_surprise_tokens(spark, sf):
    s = st.surprise_tokens(_loose(spark, sf))
    return s.drop("cls", "override").withColumn("surprise", F.round("surprise", 6))


@query(
    "strength_damage_tokens",
    o.sql("", f"""SELECT s.namespace, s.seq, round(least(2.0, coalesce(sum(CASE WHEN r.seq IS NULL THEN 0 ELSE 0.75 / (1 + exp(-10 * (least(r.surprise / {lx.SIGMA_MAX}, 1.0) - 0.5))) END), 0)), 6) AS damage
      FROM ls s LEFT JOIN lp p ON p.namespace = s.namespace AND p.old = s.seq AND p.jac > 0.25 AND p.jac <= 0.8
      LEFT JOIN lr r ON r.namespace = p.namespace AND r.seq = p.seq GROUP BY 1, 2""", _LOOSE, _LTOK, _LSET),
)
def strength_damage_tokens(spark, sf):
    items = _loose(spark, sf)
    edges = stored(st.similar_classes(stored(st.token_classes(items))))
    d = st.token_damage(items, st.surprise_tokens(items, edges), edges)
    return d.withColumn("damage", F.round("damage", 6))


_STATE = f"""now AS (SELECT namespace, max(seq) AS last FROM f GROUP BY 1),
rho AS (SELECT namespace, count(*) / 1000.0::DOUBLE AS rho FROM kept GROUP BY 1),
ms AS (SELECT k.namespace, k.seq, k.subject, k.override, retrieval_count, value,
  CASE WHEN k.override THEN 200.0 ELSE 50.0 END AS tau, coalesce(sp.surprise, 0) AS surprise,
  coalesce(dm.damage, 0) AS damage, rho, last - k.seq AS delta,
  (SELECT coalesce(-sum(n / t * log2(n / t)), 0) FROM (SELECT count(*)::DOUBLE AS n, length(s)::DOUBLE AS t FROM
    (SELECT lower(concat_ws(' ', k.subject, k.relation, k.value)) AS s, unnest(string_split(s, '')) AS c) GROUP BY c, t)) AS bits
  FROM kept k JOIN now USING (namespace) JOIN rho USING (namespace)
  LEFT JOIN sp USING (namespace, seq) LEFT JOIN dm USING (namespace, seq)),
st AS (SELECT *, greatest(0, least(1, exp(-delta / tau) * (1 + 0.15 * ln(1 + retrieval_count)) - damage)) AS strength,
  ln(2) * bits / tau AS upkeep FROM ms),
fe AS (SELECT *, (1 - strength) - surprise * bits * greatest(rho, 1e-9) + 0.5 * upkeep AS free_energy,
  CASE WHEN strength >= 0.05 THEN 'liquid' ELSE 'gas' END AS phase FROM st)"""


def _part_state(spark, sf):
    return st.memory_state(_part_facts(spark, sf))


@query(
    "strength_memory_state",
    o.sql("", """SELECT namespace, seq, subject, retrieval_count, tau, round(surprise, 5) AS surprise_at_birth,
      round(damage, 5) AS damage, round(bits, 5) AS info_bits, round(upkeep, 5) AS upkeep, round(strength, 5) AS strength,
      round(free_energy, 5) AS free_energy, phase FROM fe""", _PF, _PFACTS, _DEDUP, _SURPRISE, _DAMAGE, _STATE),
)
def strength_memory_state(spark, sf):
    s = _part_state(spark, sf)
    num = ["surprise_at_birth", "damage", "info_bits", "upkeep", "strength", "free_energy"]
    return s.select(
        "namespace", "seq", "subject", "retrieval_count", "tau", *[F.round(c, 5).alias(c) for c in num], "phase"
    )


@query(
    "strength_phase_stats",
    o.sql("", """SELECT namespace, count(*) AS items, count(*) FILTER (WHERE phase = 'gas') AS gas,
      count(*) FILTER (WHERE phase = 'liquid') AS liquid, 0 AS solid, 0 AS glass,
      round(count(*) FILTER (WHERE strength >= 0.05) / 1000.0::DOUBLE, 5) AS rho, round(sum(free_energy), 3) AS total_free_energy,
      round(avg(strength), 5) AS avg_strength, round(avg(tau), 5) AS avg_tau FROM fe GROUP BY 1""",
          _PF, _PFACTS, _DEDUP, _SURPRISE, _DAMAGE, _STATE),
)
def strength_phase_stats(spark, sf):
    s = st.phase_stats(_part_state(spark, sf))
    return s.withColumns(
        {
            "rho": F.round("rho", 5), "total_free_energy": F.round("total_free_energy", 3),
            "avg_strength": F.round("avg_strength", 5), "avg_tau": F.round("avg_tau", 5),
        }
    )


@query(
    "strength_to_level",
    o.sql("", """SELECT namespace, seq, CASE WHEN strength < 0.05 THEN 'L0' ELSE 'L1' END AS store_level,
      round(least(1, strength), 5) AS confidence, round(surprise, 5) AS salience, nullif(left(value, 256), '') AS object FROM fe""",
          _PF, _PFACTS, _DEDUP, _SURPRISE, _DAMAGE, _STATE),
)
def strength_to_level(spark, sf):
    return st.to_level(_part_state(spark, sf)).select(
        "namespace", "seq", "store_level", F.round("confidence", 5).alias("confidence"),
        F.round("salience", 5).alias("salience"), "object",
    )


@query(
    "strength_rehearse",
    o.sql("memories", """SELECT namespace, seq, retrieval_count + CASE WHEN r <= 50 THEN 1 ELSE 0 END AS retrieval_count FROM
      (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY retrieval_count, seq) AS r FROM kept)""", _F, _DEDUP),
)
def strength_rehearse(spark, sf):
    kept = st.dedup_facts(_facts(spark, sf))
    return st.rehearse(kept).select("namespace", "seq", "retrieval_count")


@query(
    "strength_birth_density",
    o.sql("memories", """SELECT namespace, seq, (row_number() OVER (PARTITION BY namespace ORDER BY seq) - 1) / 1000.0::DOUBLE
      AS rho_at_birth FROM memories"""),
)
def strength_birth_density(spark, sf):
    m = ad.memories(spark, sf).select("namespace", "seq")
    return st.birth_density(m)


@query(
    "strength_phase_samples",
    o.sql("memories", """SELECT namespace, phase, seq FROM (SELECT *, row_number() OVER (PARTITION BY namespace, phase ORDER BY seq DESC) AS r
      FROM (SELECT namespace, seq, CASE WHEN confidence >= 0.6 THEN 'liquid' ELSE 'gas' END AS phase FROM memories)) WHERE r <= 30"""),
)
def strength_phase_samples(spark, sf):
    m = ad.memories(spark, sf).withColumn("phase", F.when(F.col("confidence") >= 0.6, "liquid").otherwise("gas"))
    return st.phase_samples(m).select("namespace", "phase", "seq")


@query(
    "strength_namespace_overview",
    o.sql("memories", """SELECT namespace, count(*) AS items, count(*) FILTER (WHERE confidence >= 0.6) AS liquid,
      count(*) FILTER (WHERE confidence < 0.6) AS gas, md5(arg_max(text, seq)) AS latest_md5 FROM memories GROUP BY 1"""),
)
def strength_namespace_overview(spark, sf):
    m = ad.memories(spark, sf).withColumn("phase", F.when(F.col("confidence") >= 0.6, "liquid").otherwise("gas"))
    o_ = st.namespace_overview(m)
    return o_.select("namespace", "items", "liquid", "gas", F.md5("latest_text").alias("latest_md5"))


@query(
    "strength_field_radius",
    o.sql("memories", """SELECT namespace, seq, CASE WHEN s < 0.05 THEN least(1, n) ELSE least(n, greatest(1, CAST(floor(n * pow(s, 1.0 / 3)) AS BIGINT))) END AS reach FROM
      (SELECT namespace, seq, salience AS s, count(*) AS n FROM tok JOIN memories USING (namespace, seq) GROUP BY 1, 2, 3)""",
          o.tokens("tok", "memories", "namespace, seq")),
)
def strength_field_radius(spark, sf):
    from recallflow.functions import text as tx

    m = ad.memories(spark, sf).select("namespace", "seq", "salience", tx.tokenize(F.col("text")).alias("t"))
    return m.where(F.size("t") > 0).select(
        "namespace", "seq", F.size(st.field_radius(F.col("t"), F.col("salience"))).cast("bigint").alias("reach")
    )


_SCORE = """greatest(0, salience + 0.3 * ln(1 + usage_count) + 0.5 * authority - 0.7 * conflict_score + 0.4 * surprise)"""


@query(
    "strength_promotion",
    o.sql("memories", f"""SELECT mem_id, round(score, 6) AS promotion_score, score >= 1.5 AS to_l1, q AS to_l2, q AS to_l3 FROM
      (SELECT *, score >= 2.2 AND confidence >= 0.85 AND date_diff('microsecond', ts, TIMESTAMP '2024-01-06 06:00:00') / 86400e6 >= 5 AS q FROM
      (SELECT *, {_SCORE} AS score FROM memories))"""),
)
def strength_promotion(spark, sf):
    p = st.promote(ad.memories(spark, sf), "2024-01-06 06:00:00")
    return p.select("mem_id", F.round("promotion_score", 6).alias("promotion_score"), "to_l1", "to_l2", "to_l3")


@query(
    "strength_decay_prune",
    o.sql("memories", """SELECT mem_id, round(salience * 0.9, 6) AS salience, round(confidence * 0.95, 6) AS confidence
      FROM memories WHERE salience * 0.9::DOUBLE >= 0.2"""),
)
def strength_decay_prune(spark, sf):
    d = st.prune(st.decay(ad.memories(spark, sf)))
    return d.select("mem_id", F.round("salience", 6).alias("salience"), F.round("confidence", 6).alias("confidence"))


@query("strength_document_state")
def strength_document_state(spark, sf):
    s = st.memory_state(_facts(spark, sf))
    return s.select("namespace", "seq", "retrieval_count", "surprise_at_birth", "damage", "strength", "free_energy", "phase")
