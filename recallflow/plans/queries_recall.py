"""Queries over retrieval and evaluation."""

import string

from pyspark.sql import functions as F

from recallflow.functions import lexicon as lx
from recallflow.functions import text as tx
from recallflow.operators import corpus as cp
from recallflow.operators import factor as fa
from recallflow.operators import entities as en
from recallflow.operators import evaluation as ev
from recallflow.operators import recall as rc
from recallflow.operators import strength as st
from recallflow.operators.scans import top_k
from recallflow.plans import oracle as o
from recallflow.plans.queries_entities import _EDGE, prompt_idf, prompt_items
from recallflow.plans.registry import query
from recallflow.session import stored
from recallflow.sources import adapters as ad

_TOK = o.tokens("tok", "memories", "namespace, mem_id")
_QT = o.tokens("qt", "queries", "query_id, namespace")
_W = """nt AS (SELECT namespace, mem_id, count(*) AS nt FROM tok GROUP BY 1, 2),
df AS (SELECT namespace, token, count(*) AS df FROM tok GROUP BY 1, 2), sizes AS (SELECT namespace, count(*) AS n FROM memories GROUP BY 1),
wt AS (SELECT namespace, token, ln(1 + n / (1.0::DOUBLE + df)) AS idf, ln(1 + n / (1.0::DOUBLE + df)) * CASE WHEN df = n THEN 1.0 ELSE
  greatest(0.1, 1 + (df / n::DOUBLE) * log2(df / n::DOUBLE) + (1 - df / n::DOUBLE) * log2(1 - df / n::DOUBLE)) END AS w FROM df JOIN sizes USING (namespace)),
va AS (SELECT DISTINCT query_id, q.namespace, v.token FROM qt q JOIN df v ON v.namespace = q.namespace AND (v.token = q.token OR
  (length(q.token) >= 4 AND length(v.token) >= 4 AND left(v.token, 4) = left(q.token, 4)))),
ca AS (SELECT query_id, va.namespace, mem_id, sum(w) AS raw, count(*) AS matched, max(nt) AS nt FROM va JOIN wt USING (namespace, token)
  JOIN tok USING (namespace, token) JOIN nt USING (namespace, mem_id) GROUP BY 1, 2, 3),
ls AS (SELECT *, raw / sqrt(nt) * (1 + matched / nt::DOUBLE) AS score FROM ca)"""


def _tokens(spark, sf):
    m = ad.memories(spark, sf).select("namespace", "mem_id", "seq", "text")
    return stored(m.withColumn("tokens", tx.tokenize(F.col("text"))))


def _weights(items):
    full = items.select("namespace", "mem_id", F.explode("tokens").alias("token"))
    return cp.token_weights(cp.token_df(full), cp.namespace_size(items))


def _scored(spark, sf):
    items = _tokens(spark, sf)
    index = rc.item_index(items.withColumn("strength", F.lit(1.0)))
    return rc.lexical_score(rc.candidates(rc.query_tokens(ad.queries(spark, sf)), index, stored(_weights(items))))


@query("recall_lexical_top5", o.sql("memories queries", """SELECT query_id, mem_id, r AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY round(score, 9) DESC, mem_id) AS r FROM ls) WHERE r <= 5""", _TOK, _QT, _W))
def recall_lexical_top5(spark, sf):
    items = _tokens(spark, sf)
    index = rc.item_index(items.withColumn("strength", F.lit(1.0)))
    t = rc.best_lexical(rc.query_tokens(ad.queries(spark, sf)), index, _weights(items), 5)
    return t.select("query_id", "mem_id", "rank", F.round("lexical", 6).alias("score"))


@query("recall_candidates", o.sql("memories queries", "SELECT query_id, mem_id, matched, round(raw, 5) AS raw, round(score, 5) AS lexical FROM ls", _TOK, _QT, _W))
def recall_candidates(spark, sf):
    return _scored(spark, sf).select("query_id", "mem_id", "matched", F.round("raw", 5).alias("raw"), F.round("lexical", 5).alias("lexical"))


_SUB = f"""rw AS (SELECT DISTINCT namespace, mem_id, unnest(list_filter(regexp_split_to_array(lower(text), '{o.SPACE}+'), lambda w: w <> '')) AS w FROM memories WHERE namespace = 'en'),
vw AS (SELECT DISTINCT namespace, w FROM rw), qv AS (SELECT query_id, q.namespace, token, w FROM qt q JOIN vw ON vw.namespace = q.namespace AND contains(w, token)),
sh AS (SELECT query_id, namespace, mem_id, count(DISTINCT token) AS hits FROM qv JOIN rw USING (namespace, w) GROUP BY 1, 2, 3)"""


@query("recall_substring_hits", o.sql("memories queries", "SELECT query_id, mem_id, hits FROM sh", _QT, _SUB))
def recall_substring_hits(spark, sf):
    return rc.substring_hits(rc.query_tokens(ad.queries(spark, sf)), ad.memories(spark, sf)).select("query_id", "mem_id", "hits")


def _state_items(spark, sf):
    """Documents with a simple known state: strength 1, energy from the sequence."""
    return _tokens(spark, sf).withColumns(
        {"strength": F.lit(1.0), "phase": F.when(F.col("seq") % 5 == 0, "gas").otherwise("liquid"), "free_energy": (F.col("seq") % 13) / 13.0}
    )


@query("recall_search", o.sql("memories queries", """SELECT query_id, mem_id, r AS rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mem_id) AS r FROM
  (SELECT ls.query_id, ls.mem_id, (ls.score - (seq % 13) / 13.0::DOUBLE) * CASE WHEN seq % 5 = 0 THEN 0.7 ELSE 1.0 END AS score FROM ls JOIN memories USING (namespace, mem_id)
  UNION ALL SELECT sh.query_id, sh.mem_id, hits / nq::DOUBLE * CASE WHEN c.query_id IS NOT NULL THEN 5.0 / sqrt(greatest(coalesce(nt, 0), 1)) ELSE 10.0 END * CASE WHEN seq % 5 = 0 THEN 0.7 ELSE 1.0 END - 0.01 * (seq % 13) / 13.0::DOUBLE
  FROM sh JOIN memories USING (namespace, mem_id) LEFT JOIN nt USING (namespace, mem_id) JOIN (SELECT query_id, count(*) AS nq FROM qt GROUP BY 1) USING (query_id) LEFT JOIN (SELECT DISTINCT query_id FROM ls) c ON c.query_id = sh.query_id
  WHERE NOT EXISTS (SELECT 1 FROM ls l WHERE l.query_id = sh.query_id AND l.mem_id = sh.mem_id))) WHERE r <= 10""", _TOK, _QT, _W, _SUB))
def recall_search(spark, sf):
    # Energy enters the rank with a minus sign: thermo = -energy.
    h = rc.lexical_search(ad.queries(spark, sf), _state_items(spark, sf), 10)
    return h.select("query_id", "mem_id", "rank", F.round("score", 5).alias("score"))


def _qvecs(spark, sf):
    """Every vector asks."""
    return ad.vectors(spark, sf).select(F.col("vec_id").alias("query_id"), "namespace", "vec")


def _vitems(spark, sf):
    return ad.vectors(spark, sf).select("namespace", F.col("vec_id").alias("mem_id"), "vec", "confidence")


@query("recall_knn", o.sql("vectors", """SELECT query_id, mem_id, r AS rank, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, mem_id) AS r FROM
  (SELECT q.vec_id AS query_id, v.vec_id AS mem_id, list_cosine_similarity(q.vec, v.vec) AS s FROM vectors q JOIN vectors v USING (namespace) WHERE v.confidence >= 0.6)) WHERE r <= 10"""))
def recall_knn(spark, sf):
    k = rc.knn(_qvecs(spark, sf), _vitems(spark, sf), 10, 0.6)
    return k.select("query_id", "mem_id", "rank", F.round("similarity", 6).alias("similarity"))


@query("recall_knn_approx", o.sql("vectors", """SELECT query_id, mem_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, mem_id) AS r FROM
  (SELECT q.vec_id AS query_id, v.vec_id AS mem_id, list_cosine_similarity(q.vec, v.vec) AS s FROM vectors q JOIN vectors v USING (namespace))) WHERE r <= 10"""))
def recall_knn_approx(spark, sf):
    """All cells probed: the index must then give the exact neighbours. Recall with fewer
    probes is a test."""
    items = _vitems(spark, sf)
    model = rc.train_cells(items, rc.cells_for(items.count()))
    return rc.knn_approx(_qvecs(spark, sf), rc.assign_cells(items, model), model, 10, None).select("query_id", "mem_id", "rank")


_KNN = """kn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, mem_id) AS r FROM (SELECT q.vec_id AS query_id, v.vec_id AS mem_id,
  list_cosine_similarity(q.vec, v.vec) AS score, v.confidence FROM vectors q JOIN vectors v USING (namespace))), kt AS (SELECT * FROM kn WHERE r <= 20)"""


@query("recall_rerank", o.sql("vectors", """SELECT query_id, mem_id, round(0.6 * (score - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END + 0.4 * confidence, 5) AS score FROM
  (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM kt)""", _KNN))
def recall_rerank(spark, sf):
    items = _vitems(spark, sf)
    hits = rc.knn(_qvecs(spark, sf), items, 20).withColumnRenamed("similarity", "score").join(items.select("mem_id", "confidence"), "mem_id")
    return rc.semantic_rerank(hits, F.col("confidence")).select("query_id", "mem_id", F.round("score", 5).alias("score"))


AS_OF = "2024-03-20 12:00:00"


def _timed(spark, sf):
    m = ad.memories(spark, sf)
    return m.select(
        (F.col("seq") % 20).alias("query_id"), "namespace", "mem_id", "seq", "event_at", F.col("confidence").alias("score"), "text",
        F.when(F.col("seq") % 4 != 0, F.lit("2024-01-20").cast("timestamp")).alias("tf_start"),
        F.lit("2024-03-01").cast("timestamp").alias("tf_end"), (F.col("seq") % 3 * 10.0).alias("tf_half_life"), F.lit(0.5).alias("tf_alpha"),
    )


@query("recall_time_filter", o.sql("memories", """SELECT mem_id FROM memories WHERE event_at IS NULL OR ((seq % 4 = 0 OR event_at >= TIMESTAMP '2024-01-20') AND event_at <= TIMESTAMP '2024-03-01')"""))
def recall_time_filter(spark, sf):
    return rc.time_filter(_timed(spark, sf)).select("mem_id")


@query("recall_recency_blend", o.sql("memories", f"""SELECT mem_id, round(0.5 * confidence + 0.5 * exp(-CASE WHEN event_at IS NULL THEN 0 ELSE greatest(0, date_diff('microsecond', event_at, TIMESTAMP '{AS_OF}') / 86400e6) END
  * ln(2) / greatest(seq % 3 * 10.0, 1.0)), 6) AS score FROM memories"""))
def recall_recency_blend(spark, sf):
    return rc.recency_blend(_timed(spark, sf), AS_OF).select("mem_id", F.round("score", 6).alias("score"))


def _pairs(spark, sf):
    c = ad.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(nxt, ["conv_id", "turn"])


_PAIR = "pr AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


@query("recall_choose_alpha", o.sql("", f"""SELECT conv_id, turn, CASE WHEN list_has_any(list_filter(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}_]+'), lambda t: t NOT IN ({o.quoted(lx.EVENT_STOP_WORDS)})),
  regexp_extract_all(lower(y), '[\\p{{L}}\\p{{N}}_]+')) THEN 0.4 ELSE 0.85 END::DOUBLE AS alpha FROM pr""", _PAIR))
def recall_choose_alpha(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", rc.choose_alpha(F.col("text"), F.col("next")).alias("alpha"))


@query("recall_embedding_rescue", o.sql("vectors", """SELECT query_id, mem_id, round(score, 6) AS score, mem_id % 9 = 0 AS is_schema, false AS rescued FROM k5
  UNION ALL SELECT query_id, mem_id, round(score * 10, 6), false, true FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, mem_id) AS r2 FROM kn0 WHERE mem_id % 9 <> 0
   AND query_id NOT IN (SELECT query_id FROM k5 WHERE r = 1 AND mem_id % 9 <> 0)) n WHERE r2 <= 5
   AND NOT EXISTS (SELECT 1 FROM k5 WHERE k5.query_id = n.query_id AND k5.mem_id = n.mem_id AND mem_id % 9 <> 0)""",
  """kn0 AS (SELECT q.vec_id AS query_id, v.vec_id AS mem_id, list_cosine_similarity(q.vec, v.vec) AS score FROM vectors q JOIN vectors v USING (namespace)),
  k5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, mem_id) AS r FROM kn0) WHERE r <= 5)"""))
def recall_embedding_rescue(spark, sf):
    items = _vitems(spark, sf).withColumns({"strength": F.lit(1.0), "is_schema": F.col("mem_id") % 9 == 0})
    hits = rc.knn(_qvecs(spark, sf), items, 5).select("query_id", "namespace", "mem_id", F.col("similarity").alias("score"), (F.col("mem_id") % 9 == 0).alias("is_schema"))
    out = rc.embedding_rescue(hits, _qvecs(spark, sf), items, 5)
    return out.select("query_id", "mem_id", F.round("score", 6).alias("score"), "is_schema", "rescued")


def _as_hits(spark, sf, k=20):
    m = ad.memories(spark, sf).select((F.col("seq") % 20).alias("query_id"), "namespace", "mem_id", "seq", "text", F.col("confidence").alias("score"))
    return top_k(m, rc.Q, [F.desc("score"), F.asc("mem_id")], k)


@query("recall_quality_tiers", o.sql("memories", """SELECT query_id, namespace, mem_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY query_id, namespace ORDER BY tier, confidence DESC, mem_id) AS r2 FROM (SELECT seq % 20 AS query_id, namespace, mem_id, confidence,
  CASE WHEN rtrim(text) LIKE '%?' THEN 2 ELSE 0 END AS tier, row_number() OVER (PARTITION BY seq % 20, namespace ORDER BY confidence DESC, mem_id) AS r FROM memories) WHERE r <= 20) WHERE r2 <= 8"""))
def recall_quality_tiers(spark, sf):
    return rc.quality_tiers(_as_hits(spark, sf), 8).select("query_id", "namespace", "mem_id", "tier")


_HITS = """hh AS (SELECT * FROM (SELECT seq % 20 AS query_id, namespace, mem_id, seq, text, confidence, row_number() OVER (PARTITION BY seq % 20, namespace ORDER BY confidence DESC, mem_id) AS r
  FROM memories) WHERE r <= 20)"""


@query("recall_merge_cross_session", o.sql("memories", """SELECT query_id, namespace, src, r2 AS rank, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY query_id, namespace ORDER BY src, r) AS r2 FROM
  (SELECT query_id, namespace, text, r, 0 AS src FROM cr UNION ALL SELECT d.query_id, d.namespace, d.text, d.r, 1 FROM hh d
   LEFT JOIN (SELECT query_id, namespace, count(*) AS n FROM cr GROUP BY 1, 2) u USING (query_id, namespace) WHERE seq % 2 = 1 AND d.r <= 10 - coalesce(n, 0))) WHERE r2 <= 10""",
  _HITS, "cr AS (SELECT * FROM hh WHERE seq % 2 = 0 AND r <= 4)"))
def recall_merge_cross_session(spark, sf):
    h = _as_hits(spark, sf)
    return rc.merge_cross_session(h.where("seq % 2 = 0"), h.where("seq % 2 = 1"), 10).select("query_id", "namespace", "src", "rank", F.md5("text").alias("text_md5"))


@query("recall_digest", o.sql("memories", """SELECT query_id, lower(trim(text)) AS low FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, mem_id) AS r2 FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id, lower(trim(text)) ORDER BY confidence DESC, mem_id) AS r FROM (SELECT seq % 20 AS query_id, * FROM memories) WHERE length(trim(text)) >= 8) WHERE r = 1) WHERE r2 <= 5"""))
def recall_digest(spark, sf):
    m = ad.memories(spark, sf).select((F.col("seq") % 20).alias("query_id"), "namespace", "mem_id", "text", F.col("confidence").alias("score"))
    return rc.relevance_digest(m).select("query_id", F.lower(F.trim("text")).alias("low"))


@query("recall_context_block", o.sql("memories", """SELECT query_id, namespace, md5('Memory (strongest recall first):' || chr(10) || string_agg(printf('- [strength=%.2f] ', confidence) || text, chr(10) ORDER BY r)) AS context_md5
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, namespace ORDER BY confidence DESC, mem_id) AS r FROM (SELECT seq % 20 AS query_id, * FROM memories)) WHERE r <= 5 GROUP BY 1, 2"""))
def recall_context_block(spark, sf):
    h = _as_hits(spark, sf, 5).withColumns({"strength": F.col("score"), "phase": F.lit("liquid")})
    return rc.context_block(h).select("query_id", "namespace", F.md5("context").alias("context_md5"))


def _labelled(spark, sf):
    m = ad.memories(spark, sf)
    return m.select(
        "mem_id", "seq", "ts", "text", F.col("confidence").alias("strength"), F.col("source").alias("source_model"), tx.categorize(F.col("text")).alias("category"),
        F.when(F.col("seq") % 10 == 0, "gas").otherwise("liquid").alias("phase"), F.array(F.concat(F.lit("l"), (F.col("seq") % 3).cast("string")), F.lit("all")).alias("labels"),
    ).withColumn("layer", rc.layer_of(F.col("phase")))


@query("recall_browse", o.sql("memories", """SELECT mem_id FROM memories WHERE seq % 10 <> 0 AND seq % 3 = 1 AND text NOT LIKE '[Schema:%'"""))
def recall_browse(spark, sf):
    return rc.browse(_labelled(spark, sf), label="l1", layer="L1", sort="strength").select("mem_id")


@query("recall_facets", o.sql("memories", """SELECT 'model' AS facet, source AS value, count(*) AS n FROM memories GROUP BY 2 UNION ALL SELECT 'layer', CASE WHEN seq % 10 = 0 THEN 'L0' ELSE 'L1' END, count(*) FROM memories GROUP BY 2"""))
def recall_facets(spark, sf):
    return rc.facets(_labelled(spark, sf)).where("facet <> 'category'")


@query("recall_labels", o.sql("memories", """SELECT CASE seq % 3 WHEN 1 THEN 'one' ELSE 'l' || seq % 3 END AS label, count(*) AS n FROM memories GROUP BY 1"""))
def recall_labels(spark, sf):
    items = rc.drop_label(rc.rename_label(_labelled(spark, sf), "l1", "one"), "all")
    return rc.label_counts(items)


@query("recall_profile", o.sql("memories", """SELECT namespace, count(*) AS n, md5(string_agg(text, '; ' ORDER BY p) FILTER (p <= 5)) AS summary_md5 FROM
  (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY r, query_id, text) AS p FROM (SELECT *, row_number() OVER (PARTITION BY namespace, text ORDER BY r, query_id) AS one FROM hh) WHERE one = 1) WHERE p <= 20 GROUP BY 1""", _HITS))
def recall_profile(spark, sf):
    return rc.profile(_as_hits(spark, sf)).select("namespace", "n", F.md5("summary").alias("summary_md5"))


@query("recall_conversation_window", o.sql("prompt_log", """SELECT session_id, md5(string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || content, chr(10) ORDER BY sequence_num)) AS window_md5 FROM
  (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sequence_num DESC) AS r FROM prompt_log WHERE role IN ('user', 'assistant')) WHERE r <= 3 GROUP BY 1"""))
def recall_conversation_window(spark, sf):
    return rc.conversation_window(ad.prompt_log(spark, sf), 3).select("session_id", F.md5("window").alias("window_md5"))


def _hop(spark, sf):
    items = _state_items(spark, sf)
    q = ad.queries(spark, sf)
    first = stored(rc.lexical_search(q, items, 20))
    return rc.multi_hop(first, q, items, lambda qq: rc.lexical_search(qq, items, 20), 10)


@query("recall_multi_hop")
def recall_multi_hop(spark, sf):
    return _hop(spark, sf).select("query_id", "mem_id", "rank", F.round("score", 5).alias("score"))


def entity_setup(spark, sf):
    items = prompt_items(spark, sf).withColumn("free_energy", F.col("upkeep") * 0.5)
    idf = stored(prompt_idf(items))
    mentions = stored(en.entity_mentions(items))
    spectrum = stored(en.entity_spectrum(items, mentions, idf))
    edges = stored(en.coupling(en.candidate_edges(mentions), spectrum, idf, mentions))
    members, coherence, joint = (stored(x) for x in en.clusters(edges, spectrum))
    asks = items.select(F.col("mem_id").alias("query_id"), "namespace", "text")
    return items, idf, mentions, spectrum, edges, members, coherence, joint, asks


@query("recall_query_entities")
def recall_query_entities(spark, sf):
    items = prompt_items(spark, sf)
    asks = items.select(F.col("mem_id").alias("query_id"), "namespace", "text")
    return rc.query_entities(asks, en.entity_mentions(items))


@query("recall_entity_search")
def recall_entity_search(spark, sf):
    """Every turn asks; no schemas, no token vectors."""
    items, idf, mentions, spectrum, edges, members, coherence, joint, asks = entity_setup(spark, sf)
    graph = {"mentions": mentions, "spectrum": spectrum, "edges": edges, "members": members, "coherence": coherence, "joint": joint, "idf": idf}
    return rc.search(asks, items, graph, k=10).select("query_id", "mem_id", "rank", F.round("score", 4).alias("score"))


@query("recall_full_search")
def recall_full_search(spark, sf):
    """With schemas formed from the items and token vectors for the semantic bonus."""
    from recallflow.operators import schemas as sc

    items, idf, mentions, spectrum, edges, members, coherence, joint, asks = entity_setup(spark, sf)
    graph = {"mentions": mentions, "spectrum": spectrum, "edges": edges, "members": members, "coherence": coherence, "joint": joint, "idf": idf}
    groups = stored(sc.schema_candidates(items, mentions, idf))
    schemas = stored(sc.build_schemas(sc.schema_delta(groups, items, sc.fixed_point(groups, items, idf), mentions)))
    tokens = items.select("namespace", "mem_id", F.explode("tokens").alias("token"))
    pairs, df = stored(cp.cooccurrence_window(items)), stored(cp.token_df(tokens))
    weights = stored(cp.ppmi(pairs, df, cp.namespace_size(items)))
    vectors = fa.ppmi_vectors(weights, cp.svd_vocab(df, pairs), dims=8, iterations=2)
    return rc.search(asks, items, graph, schemas, vectors, 10, 8).select("query_id", "mem_id", "rank", F.round("score", 4).alias("score"))


# --- evaluation ------------------------------------------------------------

_AP = "".join("\\" + c if c in r"\[]^-&~|" else c for c in string.punctuation).replace("'", "''")


def _ew(t):
    return (f"list_filter(list_transform(regexp_split_to_array(lower({t}), '{o.SPACE}+'), lambda w: regexp_replace(regexp_replace(w, '^[{_AP}]+|[{_AP}]+$', '', 'g'), "
            f"'[''’]s$', '')), lambda w: w <> '')")


@query("eval_token_f1", o.sql("", f"""SELECT conv_id, turn, CASE WHEN h = 0 OR len(p) = 0 OR len(g) = 0 THEN 0 ELSE round(2 * (h / len(p)::DOUBLE) * (h / len(g)::DOUBLE) / (h / len(p)::DOUBLE + h / len(g)::DOUBLE), 4) END AS f1
  FROM (SELECT *, len(list_intersect(p, g)) AS h FROM (SELECT conv_id, turn, list_distinct({_ew('x')}) AS p, list_distinct({_ew('y')}) AS g FROM pr))""", _PAIR))
def eval_token_f1(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", ev.token_f1(F.col("text"), F.col("next")).alias("f1"))


def _gold(spark, sf):
    """First five words of each conversation as the answer sought in all its turns."""
    c = ad.table(spark, sf, "conversations")
    gold = c.where("turn = 0").select("conv_id", F.array_join(F.slice(tx.split_words(F.col("text")), 1, 5), " ").alias("gold"))
    return c.select("conv_id", "turn", "text").join(gold, "conv_id")


_GOLD = f"""go AS (SELECT c.conv_id, turn, {_ew('c.text')} AS ws, list_distinct({_ew("array_to_string(list_filter(regexp_split_to_array(z.text, '" + o.SPACE + "+'), lambda w: w <> '')[1:5], ' ')")}) AS g
  FROM conversations c JOIN (SELECT conv_id, text FROM conversations WHERE turn = 0) z ON z.conv_id = c.conv_id)"""


@query("eval_fusion_f1", o.sql("", """SELECT conv_id, CASE WHEN hit = 0 THEN 0 ELSE round(2.0::DOUBLE * hit / (np + ng), 4) END AS fusion_f1 FROM (SELECT conv_id, count(DISTINCT w) AS np, max(len(g)) AS ng,
  count(DISTINCT w) FILTER (WHERE list_contains(g, w)) AS hit FROM (SELECT conv_id, g, unnest(ws) AS w FROM go) GROUP BY 1)""", _GOLD))
def eval_fusion_f1(spark, sf):
    return ev.fusion_f1(_gold(spark, sf), ["conv_id"])


@query("eval_best_span_f1", o.sql("", """SELECT conv_id, round(coalesce(max(2.0::DOUBLE * h / (len(s) + len(g))), 0), 4) AS best_span_f1 FROM (SELECT conv_id, g, s, len(list_intersect(s, g)) AS h FROM
  (SELECT conv_id, g, list_distinct(ws[i:i + k - 1]) AS s FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM go), (SELECT unnest(range(1, 16)) AS k) WHERE k >= len(g) AND k <= least(3 * len(g), len(ws)) AND i + k - 1 <= len(ws))) GROUP BY 1""", _GOLD))
def eval_best_span_f1(spark, sf):
    return ev.best_span_f1(_gold(spark, sf), ["conv_id"])


_JUDGE = "kt2 AS (SELECT * FROM kn WHERE r <= 5), ju AS (SELECT q.vec_id AS query_id, v.vec_id AS mem_id FROM vectors q JOIN vectors v ON v.label = q.label AND v.namespace = q.namespace)"


def _judged(spark, sf):
    v = ad.vectors(spark, sf)
    q = v.select(F.col("vec_id").alias("query_id"), "label")
    return q.join(v.select("label", F.col("vec_id").alias("mem_id")), "label").select("query_id", "mem_id")


@query("eval_precision_recall", o.sql("vectors", """SELECT query_id, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 4) ELSE 0 END AS f1 FROM (SELECT query_id, round(coalesce(good, 0) / got::DOUBLE, 4) AS p, round(coalesce(good, 0) / want::DOUBLE, 4) AS r FROM
  (SELECT query_id, count(*) AS want FROM ju GROUP BY 1) JOIN (SELECT query_id, count(*) AS got FROM kt2 GROUP BY 1) USING (query_id) LEFT JOIN (SELECT query_id, count(*) AS good FROM kt2 JOIN ju USING (query_id, mem_id) GROUP BY 1) USING (query_id))""", _KNN, _JUDGE))
def eval_precision_recall(spark, sf):
    return ev.precision_recall_at(rc.knn(_qvecs(spark, sf), _vitems(spark, sf), 5), _judged(spark, sf), 5)


_MEANS = ", ".join(f"round(avg(doc_id % {k} / {k}.0) {{0}}, 4) AS {n}" for k, n in [(10, "j1"), (9, "p5"), (8, "r5"), (7, "r20"), (6, "f1")])
_REAL = _MEANS.replace("{0}", "FILTER (WHERE toxic = 0)")
_ALL = _MEANS.replace("{0}", "")


@query("eval_report", f"""SELECT CASE WHEN toxic = 1 THEN 'ADV' WHEN doc_id % 2 = 0 THEN 'SH' ELSE 'MH' END AS category, count(*) AS n, CAST(sum(quality) AS BIGINT) AS passed, {_ALL}
  FROM labels GROUP BY 1 UNION ALL SELECT 'ALL', count(*), CAST(sum(quality) AS BIGINT), {_REAL} FROM labels""")
def eval_report(spark, sf):
    d = F.col("doc_id")
    r = ad.table(spark, sf, "labels").select(
        F.when(F.col("toxic") == 1, "ADV").when(d % 2 == 0, "SH").otherwise("MH").alias("category"), (F.col("quality") == 1).alias("passed"),
        (d % 10 / 10.0).alias("j1"), (d % 9 / 9.0).alias("p5"), (d % 8 / 8.0).alias("r5"), (d % 7 / 7.0).alias("r20"), (d % 6 / 6.0).alias("f1"),
    )
    return ev.eval_report(r)


@query("eval_lifecycle")
def eval_lifecycle(spark, sf):
    items = _state_items(spark, sf)
    b = ad.queries(spark, sf)
    hits = rc.lexical_search(b, items, 10)
    written = b.select(F.col("query_id").alias("statement_id"), "query_id", F.concat(F.lit("m"), F.col("query_id").cast("string")).alias("mem_id"))
    return ev.lifecycle_check(written, hits, items)
