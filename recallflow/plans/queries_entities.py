"""Queries over entities, schemas and belief revision."""

from pyspark.sql import functions as F

from recallflow.functions import lexicon as lx
from recallflow.functions import text as tx
from recallflow.functions import vectors as vx
from recallflow.operators import belief as bl
from recallflow.operators import corpus as cp
from recallflow.operators import entities as en
from recallflow.operators import schemas as sc
from recallflow.operators import strength as st
from recallflow.plans import oracle as o
from recallflow.plans.queries_text import _STRIPPED
from recallflow.plans.registry import query
from recallflow.session import stored
from recallflow.sources import adapters as ad


def prompt_items(spark, sf):
    """Every conversation turn as a memory at full strength."""
    c, t = F.col("conv_id"), F.col("turn")
    m = ad.table(spark, sf, "conversations").select(
        F.concat_ws("/", c.cast("string"), t.cast("string")).alias("mem_id"),
        F.concat(F.lit("u"), (c % 10).cast("string")).alias("namespace"),
        (c * 1000 + t).alias("seq"), "text",
    )
    f = st.derive_facts(m)
    bits = tx.char_entropy(tx.fact_text(F.col("subject"), F.col("relation"), F.col("value")))
    f = f.withColumns(
        {
            "strength": F.lit(1.0), "tau": st.tau_of(F.col("override")), "retrieval_count": F.lit(0),
            "surprise_at_birth": F.lit(0.0), "info_bits": bits, "phase": F.lit("liquid"),
        }
    ).withColumn("upkeep", st.upkeep_expr(F.col("info_bits"), F.col("tau")))
    return stored(f)


def prompt_idf(items):
    t = items.select("namespace", "mem_id", F.explode("tokens").alias("token"))
    return cp.token_weights(cp.token_df(t), cp.namespace_size(items))


_PI = """pi AS (SELECT conv_id || '/' || turn AS mem_id, 'u' || conv_id % 10 AS namespace, conv_id * 1000 + turn AS seq, text FROM conversations)"""
_F = o.facts("f", "pi", "namespace, mem_id, seq")
_MENTIONS = f"""ew AS (SELECT namespace, mem_id, seq, regexp_split_to_array(regexp_replace(text, '^{o.SPACE}+', ''), '{o.SPACE}+') AS ws FROM pi),
ep AS (SELECT namespace, mem_id, seq, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM ew),
ec AS (SELECT namespace, mem_id, seq, i, {_STRIPPED} AS c FROM ep),
ee AS (SELECT namespace, mem_id, seq, i, lower(c) AS c FROM ec WHERE i > 1 AND length(c) > 1
  AND regexp_matches(c, '^\\p{{Lu}}') AND lower(c) NOT IN ({o.quoted(lx.STOP_WORDS)})),
eg AS (SELECT *, i - row_number() OVER (PARTITION BY mem_id ORDER BY i) AS run FROM ee),
en AS (SELECT DISTINCT namespace, mem_id, seq, string_agg(c, ' ' ORDER BY i) AS entity FROM eg GROUP BY namespace, mem_id, seq, run),
men AS (SELECT * FROM en UNION SELECT namespace, mem_id, seq, subject FROM f WHERE length(subject) > 1)"""
_TOK = o.tokens("tok", "pi", "namespace, mem_id")
_IDF = """idf AS (SELECT namespace, token, ln(1 + n / (1.0::DOUBLE + df)) AS idf FROM (SELECT namespace, token, count(*) AS df FROM tok GROUP BY 1, 2)
  JOIN (SELECT namespace, count(*) AS n FROM pi GROUP BY 1) USING (namespace))"""
_SPEC = """parts AS (SELECT DISTINCT mem_id, unnest(list_append(string_split(entity, ' '), entity)) AS token FROM men),
free AS (SELECT t.namespace, t.mem_id, t.token, idf FROM tok t JOIN idf USING (namespace, token) WHERE NOT EXISTS
  (SELECT 1 FROM parts p WHERE p.mem_id = t.mem_id AND p.token = t.token)),
spec AS (SELECT m.namespace, entity, token, sum(idf) AS weight FROM men m JOIN free USING (namespace, mem_id) GROUP BY 1, 2, 3)"""
_EDGE = f"""names AS (SELECT DISTINCT namespace, entity AS token FROM spec),
sf AS (SELECT s.*, idf FROM spec s JOIN idf USING (namespace, token) ANTI JOIN names USING (namespace, token)),
sz AS (SELECT namespace, entity, count(*) AS n FROM sf GROUP BY 1, 2),
pr AS (SELECT a.namespace, a.entity AS entity_a, b.entity AS entity_b, count(*) AS shared_items FROM men a JOIN men b
  ON a.namespace = b.namespace AND a.mem_id = b.mem_id AND a.entity < b.entity GROUP BY 1, 2, 3),
ed AS (SELECT p.namespace, entity_a, entity_b, shared_items, count(y.token) AS shared_tokens,
  coalesce(sum(CASE WHEN y.token IS NOT NULL THEN x.idf * x.idf END), 0) / sqrt(coalesce(max(za.n), 1) * coalesce(max(zb.n), 1)) AS coupling
  FROM pr p LEFT JOIN sf x ON x.namespace = p.namespace AND x.entity = entity_a LEFT JOIN sf y ON y.namespace = p.namespace AND y.entity = entity_b AND y.token = x.token
  LEFT JOIN sz za ON za.namespace = p.namespace AND za.entity = entity_a LEFT JOIN sz zb ON zb.namespace = p.namespace AND zb.entity = entity_b GROUP BY 1, 2, 3, 4)"""


@query("entities_mentions", o.sql("", "SELECT namespace, mem_id, entity FROM men", _PI, _F, _MENTIONS))
def entities_mentions(spark, sf):
    return en.entity_mentions(prompt_items(spark, sf)).select("namespace", "mem_id", "entity")


def _graph(spark, sf):
    items = prompt_items(spark, sf)
    idf = stored(prompt_idf(items))
    mentions = stored(en.entity_mentions(items))
    return items, idf, mentions, en.entity_spectrum(items, mentions, idf)


@query("entities_spectrum", o.sql("", "SELECT namespace, entity, count(*) AS tokens, round(sum(weight), 4) AS weight FROM spec GROUP BY 1, 2", _PI, _F, _MENTIONS, _TOK, _IDF, _SPEC))
def entities_spectrum(spark, sf):
    s = _graph(spark, sf)[3]
    return s.groupBy("namespace", "entity").agg(F.count(F.lit(1)).alias("tokens"), F.round(F.sum("weight"), 4).alias("weight"))


@query("entities_nodes", o.sql("", """SELECT namespace, entity, total_mentions, birth_seq, round(coalesce(omega, 0), 4) AS omega FROM
  (SELECT namespace, entity, count(*) AS total_mentions, min(seq) AS birth_seq FROM men GROUP BY 1, 2) LEFT JOIN
  (SELECT namespace, entity, -sum(weight / t * log2(weight / t)) AS omega FROM spec JOIN (SELECT namespace, entity, sum(weight) AS t FROM spec GROUP BY 1, 2) USING (namespace, entity) GROUP BY 1, 2) USING (namespace, entity)""",
  _PI, _F, _MENTIONS, _TOK, _IDF, _SPEC))
def entities_nodes(spark, sf):
    _, _, mentions, spectrum = _graph(spark, sf)
    return en.entity_nodes(mentions, spectrum).withColumn("omega", F.round("omega", 4))


@query("entities_coupling", o.sql("", "SELECT namespace, entity_a, entity_b, shared_items, shared_tokens, round(coupling, 5) AS coupling, coupling > 0.15 AS synchronized FROM ed",
  _PI, _F, _MENTIONS, _TOK, _IDF, _SPEC, _EDGE))
def entities_coupling(spark, sf):
    _, idf, mentions, spectrum = _graph(spark, sf)
    e = en.coupling(en.candidate_edges(mentions), stored(spectrum), idf, mentions)
    return e.drop("last_seq").withColumn("coupling", F.round("coupling", 5))


@query("entities_related", o.sql("", """SELECT namespace, mem_id, entity, round(si, 5) AS shared_information, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY namespace, mem_id ORDER BY round(si, 6) DESC, entity) AS r FROM
  (SELECT t.namespace, t.mem_id, ix.entity, sum(idf) AS si FROM bare t JOIN idf USING (namespace, token) JOIN (SELECT DISTINCT m.namespace, token, entity FROM men m JOIN bare USING (namespace, mem_id)) ix USING (namespace, token)
   WHERE NOT EXISTS (SELECT 1 FROM men x WHERE x.namespace = t.namespace AND x.mem_id = t.mem_id AND x.entity = ix.entity) GROUP BY 1, 2, 3)) WHERE r <= 5""",
  _PI, _F, _MENTIONS, _TOK, _IDF, "bare AS (SELECT * FROM tok WHERE NOT EXISTS (SELECT 1 FROM men WHERE men.namespace = tok.namespace AND men.entity = tok.token))"))
def entities_related(spark, sf):
    items, idf, mentions, _ = _graph(spark, sf)
    return en.related_entities(items, mentions, idf).withColumn("shared_information", F.round("shared_information", 5))


def _edges(spark, sf):
    _, idf, mentions, spectrum = _graph(spark, sf)
    spectrum = stored(spectrum)
    return stored(en.coupling(en.candidate_edges(mentions), spectrum, idf, mentions)), spectrum, mentions


@query("entities_clusters")
def entities_clusters(spark, sf):
    edges, spectrum, _ = _edges(spark, sf)
    _, coherence, _ = en.clusters(edges, spectrum)
    return coherence


@query("entities_components", """WITH RECURSIVE e AS (SELECT DISTINCT 'n' || c_nationkey % 5 AS ns, 'c' || c_custkey AS x, 'c' || (c_custkey + 40) AS y FROM customer),
  b AS (SELECT ns, x, y FROM e UNION SELECT ns, y, x FROM e), r(ns, node, low) AS (SELECT ns, x, x FROM b UNION SELECT b.ns, b.y, r.low FROM r JOIN b ON b.ns = r.ns AND b.x = r.node)
  SELECT ns AS namespace, node, min(low) AS component FROM r GROUP BY 1, 2""")
def entities_components(spark, sf):
    c = ad.table(spark, sf, "customer")
    e = c.select(
        F.concat(F.lit("n"), (F.col("c_nationkey") % 5).cast("string")).alias("namespace"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("x"),
        F.concat(F.lit("c"), (F.col("c_custkey") + 40).cast("string")).alias("y"),
    )
    return en.components(e, "x", "y")


@query("entities_decayed_edges", o.sql("", """SELECT namespace, entity_a, entity_b, round(k, 5) AS coupling FROM (SELECT *, CASE WHEN age > 100 THEN coupling * pow(0.99::DOUBLE, age / 100.0::DOUBLE) ELSE coupling END AS k FROM
  (SELECT *, 100000 - (SELECT max(seq) FROM men a JOIN men b USING (namespace, mem_id, seq) WHERE a.namespace = ed.namespace AND a.entity = entity_a AND b.entity = entity_b) AS age FROM ed)) WHERE k >= 0.01""",
  _PI, _F, _MENTIONS, _TOK, _IDF, _SPEC, _EDGE))
def entities_decayed_edges(spark, sf):
    edges, _, _ = _edges(spark, sf)
    e = en.decay_prune_edges(edges, 100000)
    return e.select("namespace", "entity_a", "entity_b", F.round("coupling", 5).alias("coupling"))


@query("entities_forget", o.sql("", "SELECT namespace, entity, count(*) AS left_items FROM men WHERE seq % 3 <> 0 GROUP BY 1, 2", _PI, _F, _MENTIONS))
def entities_forget(spark, sf):
    edges, _, mentions = _edges(spark, sf)
    left, _ = en.forget_entities(mentions, edges, mentions.where("seq % 3 = 0"))
    return left.groupBy("namespace", "entity").agg(F.count(F.lit(1)).alias("left_items"))


# --- schemas ---------------------------------------------------------------

_CAND = """al AS (SELECT namespace, mem_id, seq, 'e:' || entity AS group_id FROM men UNION ALL
  SELECT namespace, mem_id, seq, 't:' || token FROM tok JOIN idf USING (namespace, token) JOIN pi USING (namespace, mem_id) WHERE idf >= 1),
gs AS (SELECT namespace, group_id, count(*) AS n, list(mem_id ORDER BY mem_id) AS ids FROM al GROUP BY 1, 2 HAVING count(*) >= 3),
un AS (SELECT namespace, min(group_id) AS group_id FROM gs GROUP BY namespace, ids),
mem AS (SELECT * FROM (SELECT al.*, row_number() OVER (PARTITION BY namespace, group_id ORDER BY seq) AS r FROM al JOIN un USING (namespace, group_id)) WHERE r <= 10)"""
# Groups with all their members, for the queries that merge whole groups.
_WHOLE = _CAND[:_CAND.index("mem AS (")] + "mem AS (SELECT al.* FROM al JOIN un USING (namespace, group_id))"
_FIX = """fx AS (SELECT namespace, group_id, token, k / size::DOUBLE AS coverage, idf * idf * k / size AS weight FROM (SELECT m.namespace, group_id, token, count(*) AS k
  FROM mem m JOIN tok USING (namespace, mem_id) GROUP BY 1, 2, 3) JOIN (SELECT namespace, group_id, count(*) AS size FROM mem GROUP BY 1, 2) USING (namespace, group_id)
  JOIN idf USING (namespace, token) WHERE k >= 0.8 * size)"""


def _groups(spark, sf, max_group=lx.MAX_GROUP):
    items = prompt_items(spark, sf)
    idf = stored(prompt_idf(items))
    mentions = stored(en.entity_mentions(items))
    return items, idf, mentions, stored(sc.schema_candidates(items, mentions, idf, max_group))


@query("schemas_candidates", o.sql("", "SELECT namespace, group_id, count(*) AS members, min(seq) AS first_seq, max(seq) AS last_seq FROM mem GROUP BY 1, 2", _PI, _F, _MENTIONS, _TOK, _IDF, _CAND))
def schemas_candidates(spark, sf):
    m = _groups(spark, sf)[3]
    return m.groupBy("namespace", "group_id").agg(F.count(F.lit(1)).alias("members"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("schemas_fixed_point", o.sql("", "SELECT namespace, group_id, count(*) AS tokens, round(sum(weight), 4) AS weight FROM fx GROUP BY 1, 2", _PI, _F, _MENTIONS, _TOK, _IDF, _CAND, _FIX))
def schemas_fixed_point(spark, sf):
    items, idf, _, members = _groups(spark, sf)
    f = sc.fixed_point(members, items, idf)
    return f.groupBy("namespace", "group_id").agg(F.count(F.lit(1)).alias("tokens"), F.round(F.sum("weight"), 4).alias("weight"))


def _deltas(spark, sf):
    items, idf, mentions, members = _groups(spark, sf)
    fixed = sc.fixed_point(members, items, idf)
    return items, idf, mentions, stored(sc.schema_delta(members, items, fixed, mentions))


def whole_schemas(spark, sf):
    """Items and the schemas of whole groups. A group of any size is no list of its members,
    and only groups with enough fixed tokens to be accepted are weighed."""
    items, idf, mentions, members = _groups(spark, sf, None)
    fixed = stored(sc.fixed_point(members, items, idf))
    g = ["namespace", "group_id"]
    enough = fixed.groupBy(*g).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= lx.MIN_FIXED_TOKENS).select(*g)
    some = stored(members.join(stored(enough), g, "left_semi"))
    return items, stored(sc.build_schemas(stored(sc.schema_delta(some, items, fixed, mentions).drop("member_ids"))))


def _bits(s):
    """Shannon bits of a string, of its lower-case characters."""
    return (
        f"coalesce((SELECT -sum(n / t * log2(n / t)) FROM (SELECT count(*)::DOUBLE AS n, length({s})::DOUBLE AS t "
        f"FROM (SELECT unnest(string_split({s}, '')) AS c) GROUP BY c)), 0)"
    )


_UNIT = f"({lx.KT} * {lx.LN2} / {lx.TAU_SCHEMA}::DOUBLE)"
_ITEM = f"""it0 AS (SELECT *, lower(concat_ws(' ', subject, relation, value)) AS srv FROM f),
it AS (SELECT *, bits * {lx.KT * lx.LN2} / (CASE WHEN override THEN {lx.TAU_OVERRIDE} ELSE {lx.TAU_DEFAULT} END)::DOUBLE AS upkeep FROM (SELECT *, {_bits('srv')} AS bits FROM it0))"""


def _delta_sql(name, members, fixed, tokens):
    """CTE ``name``: subject, tokens, entropies and free-energy change of member groups."""
    return f"""{name}_s AS (SELECT m.namespace, group_id, sum(upkeep) AS up, sum(bits) AS h_sum, count(*) AS size, arg_min(subject, it.seq) AS first, max(it.seq) AS formed
  FROM {members} m JOIN it USING (namespace, mem_id) GROUP BY 1, 2),
{name}_d AS (SELECT namespace, group_id, entity FROM (SELECT *, row_number() OVER (PARTITION BY namespace, group_id ORDER BY n DESC, entity) AS r FROM
  (SELECT m.namespace, group_id, entity, count(*) AS n FROM {members} m JOIN men USING (namespace, mem_id) GROUP BY 1, 2, 3)) WHERE r = 1),
{name}_c AS (SELECT namespace, group_id, sum(weight) AS shared, count(*) AS n_fixed, list(token ORDER BY -weight, token) AS own FROM {fixed} GROUP BY 1, 2),
{name}_t AS (SELECT c.namespace, group_id, shared, n_fixed, {tokens} AS tokens, up, h_sum, size, formed, coalesce(entity, first) AS subject
  FROM {name}_c c JOIN {name}_s s USING (namespace, group_id) LEFT JOIN {name}_d d USING (namespace, group_id)),
{name}_v AS (SELECT *, array_to_string(tokens[1:20], ' ') AS value, lower(concat_ws(' ', subject, 'schema', array_to_string(tokens[1:20], ' '))) AS srv FROM {name}_t),
{name}_h AS (SELECT *, {_bits('srv')} AS h_schema FROM {name}_v),
{name} AS (SELECT *, {_UNIT} * h_schema - up + {_UNIT} * greatest(0, h_sum - h_schema - shared) + greatest(0, size / {lx.CAPACITY}.0 - 0.5) * {lx.KT * lx.LN2} AS delta_f FROM {name}_h)"""


_WHOLE_DELTAS = (_PI, _F, _MENTIONS, _TOK, _IDF, _WHOLE, _FIX, _ITEM, _delta_sql("dl", "mem", "fx", "own"))
_DELTAS = (_PI, _F, _MENTIONS, _TOK, _IDF, _CAND, _FIX, _ITEM, _delta_sql("dl", "mem", "fx", "own"))
_BUILT = f"""sch AS (SELECT 'schema/' || namespace || '/' || group_id AS schema_id, * FROM dl WHERE delta_f < 0 AND n_fixed >= {lx.MIN_FIXED_TOKENS}),
arc AS (SELECT schema_id, namespace, mem_id FROM sch JOIN mem USING (namespace, group_id))"""
_ABSORBED = f"""taken AS (SELECT namespace, mem_id, schema_id FROM (SELECT *, row_number() OVER (PARTITION BY namespace, mem_id ORDER BY formed, schema_id) AS r FROM
  (SELECT t.namespace, t.mem_id, schema_id, formed, len(tokens) AS n, count(*) AS k FROM (SELECT *, unnest(tokens) AS token FROM sch) w JOIN tok t USING (namespace, token)
   WHERE NOT EXISTS (SELECT 1 FROM arc a WHERE a.namespace = t.namespace AND a.mem_id = t.mem_id) GROUP BY ALL)
  WHERE k / n::DOUBLE >= {lx.ABSORB_COVERAGE}) WHERE r = 1)"""


@query("schemas_delta", o.sql("", "SELECT namespace, group_id, subject, n_fixed, round(h_schema, 5) AS h_schema, round(h_sum, 5) AS h_sum, round(delta_f, 5) AS delta_f FROM dl", *_DELTAS))
def schemas_delta(spark, sf):
    d = _deltas(spark, sf)[3]
    return d.select("namespace", "group_id", "subject", "n_fixed", F.round("h_schema", 5).alias("h_schema"), F.round("h_sum", 5).alias("h_sum"), F.round("delta_f", 5).alias("delta_f"))


@query("schemas_build", o.sql("", f"""SELECT schema_id AS mem_id, namespace, '[Schema: ' || subject || '] ' || value AS text, {lx.TAU_SCHEMA}::DOUBLE AS tau, formed,
  (SELECT string_agg(mem_id, ' ' ORDER BY mem_id) FROM arc WHERE arc.schema_id = sch.schema_id) AS members FROM sch""", *_DELTAS, _BUILT))
def schemas_build(spark, sf):
    s = sc.build_schemas(_deltas(spark, sf)[3])
    return s.select("mem_id", "namespace", "text", "tau", "formed", F.array_join("member_ids", " ").alias("members"))


@query("schemas_fade", o.sql("", f"""SELECT namespace, mem_id, CASE WHEN EXISTS (SELECT 1 FROM arc WHERE arc.namespace = f.namespace AND arc.mem_id = f.mem_id)
  THEN {lx.TAU_CRITICAL / 2} WHEN override THEN {lx.TAU_OVERRIDE} ELSE {lx.TAU_DEFAULT} END::DOUBLE AS tau FROM f""", *_DELTAS, _BUILT))
def schemas_fade(spark, sf):
    items, _, _, d = _deltas(spark, sf)
    return sc.fade_members(items, sc.archive_rows(stored(sc.build_schemas(d)))).select("namespace", "mem_id", "tau")


def _absorbed(spark, sf):
    items, idf, mentions, d = _deltas(spark, sf)
    schemas = stored(sc.build_schemas(d))
    after, archive, faded = sc.absorb(items, schemas, sc.archive_rows(schemas))
    return stored(after), stored(archive), faded, idf, mentions


@query("schemas_absorb", o.sql("", """SELECT schema_id, namespace, mem_id FROM arc UNION ALL SELECT schema_id, namespace, mem_id FROM taken""", *_DELTAS, _BUILT, _ABSORBED))
def schemas_absorb(spark, sf):
    return _absorbed(spark, sf)[1].select("schema_id", "namespace", "mem_id")


@query("schemas_absorbed_state", o.sql("", """SELECT schema_id AS mem_id, namespace, n AS absorbed, n AS retrieval_count, round(h_sum + more, 5) AS h_sum, CASE WHEN n >= 3 THEN 'glass' ELSE 'solid' END AS phase
  FROM (SELECT s.schema_id, s.namespace, s.h_sum, count(t.mem_id) AS n, coalesce(sum(it.bits), 0) AS more FROM sch s LEFT JOIN taken t USING (schema_id)
  LEFT JOIN it ON it.namespace = t.namespace AND it.mem_id = t.mem_id GROUP BY ALL)""", *_DELTAS, _BUILT, _ABSORBED))
def schemas_absorbed_state(spark, sf):
    after = _absorbed(spark, sf)[0]
    return after.select("mem_id", "namespace", F.col("absorbed").cast("long").alias("absorbed"), F.col("retrieval_count").cast("long").alias("retrieval_count"), F.round("h_sum", 5).alias("h_sum"), "phase")


_MELTED = ("ar2 AS (SELECT schema_id AS group_id, namespace, mem_id FROM arc UNION ALL SELECT schema_id, namespace, mem_id FROM taken), "
  "pres AS (SELECT a.* FROM ar2 a JOIN f USING (namespace, mem_id) WHERE f.seq % 2 = 1)",
  """fx2 AS (SELECT namespace, group_id, token, k / size::DOUBLE AS coverage, idf * idf * k / size AS weight FROM (SELECT m.namespace, group_id, token, count(*) AS k
  FROM pres m JOIN tok USING (namespace, mem_id) GROUP BY 1, 2, 3) JOIN (SELECT namespace, group_id, count(*) AS size FROM pres GROUP BY 1, 2) USING (namespace, group_id)
  JOIN idf USING (namespace, token) WHERE k >= 0.8 * size)""",
  _delta_sql("dm", "pres", "fx2", "(SELECT any_value(sch.tokens) FROM sch WHERE sch.schema_id = c.group_id)"),
  f"""grown AS (SELECT s.schema_id, s.namespace, s.h_schema, s.h_sum + coalesce(sum(it.bits), 0) AS h_sum FROM sch s LEFT JOIN taken t USING (schema_id)
  LEFT JOIN it ON it.namespace = t.namespace AND it.mem_id = t.mem_id GROUP BY s.schema_id, s.namespace, s.h_schema, s.h_sum),
  fate AS (SELECT g.schema_id, g.namespace, coalesce(dm.size >= 2 AND dm.delta_f <= {lx.KT * lx.LN2} * greatest(g.h_sum - g.h_schema, 0), false) AS stays
  FROM grown g LEFT JOIN dm ON dm.group_id = g.schema_id AND dm.namespace = g.namespace)""")


@query("schemas_melt", o.sql("", "SELECT schema_id AS mem_id, namespace, stays FROM fate", *_DELTAS, _BUILT, _ABSORBED, *_MELTED))
def schemas_melt(spark, sf):
    return _melted(spark, sf)[0].select("mem_id", "namespace", (F.col("strength") > 0).alias("stays"))


def _melted(spark, sf):
    """Every other item has died when the schemas are judged."""
    after, archive, faded, idf, mentions = _absorbed(spark, sf)
    dimmed = stored(faded.withColumn("strength", F.when(F.col("seq") % 2 == 0, 0.0).otherwise(1.0)))
    return sc.melt(after, archive, dimmed, idf, mentions)


@query("schemas_freed", o.sql("", f"""SELECT f.namespace, f.mem_id, CASE WHEN EXISTS (SELECT 1 FROM pres p JOIN fate ON p.group_id = schema_id AND p.namespace = fate.namespace
  WHERE NOT stays AND p.namespace = f.namespace AND p.mem_id = f.mem_id) THEN {lx.TAU_DEFAULT}
  WHEN EXISTS (SELECT 1 FROM taken t WHERE t.namespace = f.namespace AND t.mem_id = f.mem_id) THEN {lx.TAU_CRITICAL / 2}
  WHEN override THEN {lx.TAU_OVERRIDE} ELSE {lx.TAU_DEFAULT} END::DOUBLE AS tau FROM f""", *_DELTAS, _BUILT, _ABSORBED, *_MELTED))
def schemas_freed(spark, sf):
    return _melted(spark, sf)[1].select("namespace", "mem_id", "tau")


# --- belief ----------------------------------------------------------------


def _vector_pairs(spark, sf):
    v = ad.table(spark, sf, "embeddings").select(
        F.col("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("vec"),
        F.concat(F.lit("fact number "), (F.col("vec_id") % 7).cast("string"), F.lit(" of label "), F.col("label").cast("string")).alias("text"),
    )
    nxt = v.select((F.col("vec_id") - 5).alias("vec_id"), F.col("vec").alias("new_embedding"), F.col("text").alias("new_text"))
    return v.join(nxt, "vec_id").select(
        "vec_id", "new_text", "new_embedding", F.col("text").alias("old_text"), F.col("vec").alias("old_embedding"),
        (F.col("vec_id") % 6).cast("int").alias("n_evidence"),
    )


_VP = """vt AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, 'fact number ' || vec_id % 7 || ' of label ' || label AS text FROM embeddings),
vp AS (SELECT a.vec_id, list_cosine_similarity(a.vec, b.vec) AS s, string_split(a.text, ' ') AS x, string_split(b.text, ' ') AS y, a.vec_id % 6 AS ev FROM vt a JOIN vt b ON b.vec_id = a.vec_id + 5),
vc AS (SELECT *, CASE WHEN s < 0.7 THEN 0.0 WHEN len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) < 0.3 AND s > 0.7 THEN 0.5 ELSE 0.0 END AS conflict FROM vp)"""


@query("belief_judge", o.sql("", "SELECT vec_id, round(s, 5) AS similarity, conflict, s >= 0.7 AND conflict < 0.3 AS merge, conflict < 0.3 OR ev >= 4 AS overwrite FROM vc", _VP))
def belief_judge(spark, sf):
    j = bl.judge(_vector_pairs(spark, sf))
    return j.select("vec_id", F.round("similarity", 5).alias("similarity"), "conflict", "merge", "overwrite")


@query("belief_revise", """SELECT 'n' || vec_id AS mem_id, 'm' || vec_id AS lineage, vec_id % 5 + 2 AS version, true AS accepted FROM embeddings""")
def belief_revise(spark, sf):
    v = ad.table(spark, sf, "embeddings")
    i = F.col("vec_id").cast("string")
    old = v.select(F.concat(F.lit("m"), i).alias("mem_id"), F.concat(F.lit("old "), i).alias("text"),
                   F.col("embedding").cast("array<double>").alias("embedding"), F.array().cast("array<string>").alias("lineage"),
                   (F.col("vec_id") % 5 + 1).alias("version"))
    new = v.select(F.concat(F.lit("m"), i).alias("old_id"), F.concat(F.lit("n"), i).alias("mem_id"), F.concat(F.lit("new "), i, F.lit(" text here and more")).alias("text"),
                   F.col("embedding").cast("array<double>").alias("embedding"), F.lit(4).alias("n_evidence"))
    current, _ = bl.revise(new, old)
    return current.select("mem_id", F.array_join("lineage", ",").alias("lineage"), "version", "accepted")


_SUP = o.facts("f", "memories", "namespace, seq, event_at")


@query("belief_superseded", o.sql("memories", """SELECT namespace, seq, subject <> '' AND relation <> '' AND mx IS NOT NULL AND (event_at IS NULL OR event_at < mx) AS superseded FROM
  (SELECT *, max(event_at) OVER (PARTITION BY namespace, subject, relation) AS mx FROM f)""", _SUP))
def belief_superseded(spark, sf):
    f = st.derive_facts(ad.memories(spark, sf).drop("superseded"))
    return bl.mark_superseded(f).select("namespace", "seq", "superseded")


@query("belief_superseded_gated", """WITH v AS (SELECT 'n' || label % 4 AS namespace, vec_id AS seq, CAST(embedding AS DOUBLE[]) AS e, label, TIMESTAMP '2024-01-01' + to_days(CAST(vec_id % 3 AS INTEGER)) AS at0, 'w' || vec_id AS text FROM embeddings)
  SELECT a.namespace, a.seq, EXISTS (SELECT 1 FROM v b WHERE b.namespace = a.namespace AND b.label = a.label AND b.at0 > a.at0 AND list_cosine_similarity(a.e, b.e) <= 0.7) AS superseded FROM v a""")
def belief_superseded_gated(spark, sf):
    v = F.col("vec_id")
    items = ad.table(spark, sf, "embeddings").select(
        F.concat(F.lit("n"), (F.col("label") % 4).cast("string")).alias("namespace"), v.alias("seq"),
        F.col("label").cast("string").alias("subject"), F.lit("r").alias("relation"),
        F.concat(F.lit("w"), v.cast("string")).alias("text"), F.col("embedding").cast("array<double>").alias("embedding"),
        F.timestamp_seconds(F.lit(ad.EPOCH_2024) + (v % 3) * 86400).alias("event_at"),
    )
    return bl.mark_superseded_gated(items).select("namespace", "seq", "superseded")
