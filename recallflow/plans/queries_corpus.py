"""Queries over corpus statistics."""

from pyspark.sql import functions as F

from recallflow.operators import corpus as cp
from recallflow.operators import factor as fa
from recallflow.plans import oracle as o
from recallflow.plans.registry import query
from recallflow.sources import adapters as ad

_TOK = o.tokens("tok", "memories", "namespace, mem_id")
_DF = "df AS (SELECT namespace, token, count(*) AS df FROM tok GROUP BY 1, 2)"
_N = "sizes AS (SELECT namespace, count(*) AS n FROM memories GROUP BY 1)"


def _passages(spark, sf):
    """Benchmark passages as short items of four namespaces."""
    i = F.col("item_id")
    return ad.table(spark, sf, "benchmark").select(
        F.concat(F.lit("b"), (i % 4).cast("string")).alias("namespace"),
        i.cast("string").alias("mem_id"),
        "text",
    )


_PT = o.tokens("tok", "p", "namespace, id")
_P = "p AS (SELECT 'b' || item_id % 4 AS namespace, text, item_id AS id FROM benchmark)"
_PAIRS = """pairs AS (SELECT a.namespace, a.token AS token_a, b.token AS token_b, count(*) AS pairs
  FROM tok a JOIN tok b ON a.namespace = b.namespace AND a.id = b.id AND a.token < b.token GROUP BY 1, 2, 3)"""


@query("corpus_token_df", o.sql("memories", "SELECT * FROM df", _TOK, _DF))
def corpus_token_df(spark, sf):
    return cp.token_df(cp.item_tokens(ad.memories(spark, sf)))


_ENT = """CASE WHEN df = 0 OR df = n THEN 1.0 ELSE greatest(0.1, 1 + (df / n::DOUBLE) * log2(df / n::DOUBLE)
  + (1 - df / n::DOUBLE) * log2(1 - df / n::DOUBLE)) END"""


@query(
    "corpus_token_weights",
    o.sql("memories", f"""SELECT namespace, token, df, round(ln(1 + n / (1.0::DOUBLE + df)), 6) AS idf,
      round({_ENT}, 6) AS entropy_weight FROM df JOIN sizes USING (namespace)""", _TOK, _DF, _N),
)
def corpus_token_weights(spark, sf):
    m = ad.memories(spark, sf)
    w = cp.token_weights(cp.token_df(cp.item_tokens(m)), cp.namespace_size(m))
    return w.select(
        "namespace", "token", "df", F.round("idf", 6).alias("idf"),
        F.round("entropy_weight", 6).alias("entropy_weight"),
    )


@query("corpus_cooccurrence_all", o.sql("", "SELECT * FROM pairs", _P, _PT, _PAIRS))
def corpus_cooccurrence_all(spark, sf):
    return cp.cooccurrence_all(_passages(spark, sf))


@query(
    "corpus_cooccurrence_window",
    o.sql("prompt_log", """SELECT a.namespace, least(a.token, b.token) AS token_a, greatest(a.token, b.token) AS token_b,
      count(*) AS pairs FROM ot a JOIN ot b ON a.session_id = b.session_id AND a.sequence_num = b.sequence_num
      AND a.r BETWEEN b.r + 1 AND b.r + 5 GROUP BY 1, 2, 3""",
          o.ordered_tokens("ot", "prompt_log", "namespace, session_id, sequence_num", "content")),
)
def corpus_cooccurrence_window(spark, sf):
    log = ad.prompt_log(spark, sf)
    return cp.cooccurrence_window(log.select("namespace", F.col("content").alias("text")))


_CELLS = """seeds(r) AS (VALUES (0), (1), (2), (3)),
cells AS (SELECT namespace, token_a, token_b, pairs, r AS cms_row,
  CAST('0x' || right(md5(r || ':' || token_a || ':' || token_b), 4) AS INTEGER) AS cms_bucket FROM pairs, seeds),
sketch AS (SELECT namespace, cms_row, cms_bucket, CAST(sum(pairs) AS BIGINT) AS total FROM cells GROUP BY 1, 2, 3)"""


@query("corpus_cms_build", o.sql("", "SELECT * FROM sketch", _P, _PT, _PAIRS, _CELLS))
def corpus_cms_build(spark, sf):
    return cp.cms_build(cp.cooccurrence_all(_passages(spark, sf)))


@query(
    "corpus_cms_query",
    o.sql("", """SELECT namespace, token_a, token_b, min(total) AS estimate
      FROM cells JOIN sketch USING (namespace, cms_row, cms_bucket) GROUP BY 1, 2, 3""",
          _P, _PT, _PAIRS, _CELLS),
)
def corpus_cms_query(spark, sf):
    pairs = cp.cooccurrence_all(_passages(spark, sf))
    return cp.cms_query(cp.cms_build(pairs), pairs)


_PDF = "df AS (SELECT namespace, token, count(*) AS df FROM tok GROUP BY 1, 2)"
_PN = "sizes AS (SELECT namespace, count(*) AS n FROM p GROUP BY 1)"
_PPMI = """ppmi AS (SELECT namespace, token_a, token_b, ln(n * pairs / (a.df * b.df)::DOUBLE) AS ppmi
  FROM pairs JOIN df a USING (namespace) JOIN df b USING (namespace) JOIN sizes USING (namespace)
  WHERE a.token = token_a AND b.token = token_b)"""


def _ppmi(spark, sf):
    items = _passages(spark, sf)
    df = cp.token_df(cp.item_tokens(items))
    pairs = cp.cooccurrence_all(items)
    return df, pairs, cp.ppmi(pairs, df, cp.namespace_size(items))


@query(
    "corpus_ppmi",
    o.sql("", "SELECT namespace, token_a, token_b, round(ppmi, 6) AS ppmi FROM ppmi WHERE ppmi > 0",
          _P, _PT, _PAIRS, _PDF, _PN, _PPMI),
)
def corpus_ppmi(spark, sf):
    return _ppmi(spark, sf)[2].withColumn("ppmi", F.round("ppmi", 6))


@query(
    "corpus_svd_vocab",
    o.sql("", """SELECT namespace, token, df FROM (SELECT *, row_number() OVER
      (PARTITION BY namespace ORDER BY df DESC, token) AS r FROM df WHERE df >= 2 AND EXISTS
      (SELECT 1 FROM pairs p WHERE p.namespace = df.namespace AND token IN (p.token_a, p.token_b))) WHERE r <= 100""",
          _P, _PT, _PAIRS, _PDF),
)
def corpus_svd_vocab(spark, sf):
    df, pairs, _ = _ppmi(spark, sf)
    return cp.svd_vocab(df, pairs, cap=100)


@query("corpus_ppmi_vectors")
def corpus_ppmi_vectors(spark, sf):
    df, pairs, weights = _ppmi(spark, sf)
    return fa.ppmi_vectors(weights, cp.svd_vocab(df, pairs), dims=16, iterations=3)


_VOCAB = """vocab AS (SELECT namespace, token FROM df WHERE df >= 2 AND (namespace, token) IN
  (SELECT (namespace, token_a) FROM pairs UNION SELECT (namespace, token_b) FROM pairs)),
inside AS (SELECT p.* FROM ppmi p JOIN vocab a ON a.namespace = p.namespace AND a.token = token_a
  JOIN vocab b ON b.namespace = p.namespace AND b.token = token_b WHERE ppmi > 0)"""


@query("corpus_basis_products", o.sql("", "SELECT DISTINCT namespace, i, j, (i = j)::DOUBLE AS product FROM inside, range(4) a(i), range(4) b(j)", _P, _PT, _PAIRS, _PDF, _PN, _PPMI, _VOCAB))
def corpus_basis_products(spark, sf):
    """Products of the columns of every namespace's basis: those of an orthonormal one."""
    df, pairs, weights = _ppmi(spark, sf)
    g = fa.grams(fa.ppmi_vectors(weights, cp.svd_vocab(df, pairs), dims=4, iterations=4), 4)
    each = g.select("namespace", F.col("i").cast("long").alias("i"), F.posexplode("row").alias("j", "p"))
    return each.select("namespace", "i", F.col("j").cast("long").alias("j"), (F.round("p", 6) + 0.0).alias("product"))


@query("corpus_basis_energy", o.sql("", """SELECT namespace, round(2 * sum(ppmi * ppmi), 3) AS norm2, TRUE AS within FROM inside GROUP BY 1""",
                                    _P, _PT, _PAIRS, _PDF, _PN, _PPMI, _VOCAB))
def corpus_basis_energy(spark, sf):
    """Norm of the matrix, and whether what the basis holds is within its image and the norm."""
    df, pairs, weights = _ppmi(spark, sf)
    vocab = cp.svd_vocab(df, pairs)
    e = fa.energy(weights, vocab, fa.ppmi_vectors(weights, vocab, dims=4, iterations=12), 4)
    within = (F.col("inside2") <= F.col("image2") * (1 + 1e-9)) & (F.col("image2") <= F.col("norm2") * (1 + 1e-9)) & (F.col("inside2") > 0)
    return e.select("namespace", F.round("norm2", 3).alias("norm2"), within.alias("within"))


@query("corpus_basis_warm", o.sql("", "SELECT DISTINCT namespace, TRUE AS orthonormal, TRUE AS same_space FROM inside", _P, _PT, _PAIRS, _PDF, _PN, _PPMI, _VOCAB))
def corpus_basis_warm(spark, sf):
    """Two runs, the second from the first one's rows: it stays in the dominant space."""
    from recallflow.plans import jobs

    df, pairs, weights = _ppmi(spark, sf)
    vocab = cp.svd_vocab(df, pairs)
    first = jobs.token_space(weights, vocab, 4, iterations=12)
    second = jobs.token_space(weights, vocab, 4, previous=first)
    both = first.withColumnRenamed("vec", "w").join(second, ["namespace", "token"]).select("namespace", F.concat("w", "vec").alias("vec"))
    g = fa.grams(both, 8)
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
    unit = F.abs(F.get("row", F.col("i")) - 1) < 1e-9
    shared = F.sum(F.when(F.col("i") < 4, square(F.slice("row", 5, 4))).otherwise(0.0))
    return g.groupBy("namespace").agg(F.min(unit).alias("orthonormal"), (shared >= 0.5 * 4).alias("same_space"))


@query(
    "corpus_evicted_vocab",
    o.sql("memories", """SELECT namespace, token, df FROM (SELECT *, count(*) OVER (PARTITION BY namespace) AS v,
      row_number() OVER (PARTITION BY namespace ORDER BY df, token) AS r FROM df) WHERE v <= 3000 OR r > v // 5""",
          _TOK, _DF),
)
def corpus_evicted_vocab(spark, sf):
    return cp.evict_vocab(cp.token_df(cp.item_tokens(ad.memories(spark, sf))), limit=3000)


@query(
    "corpus_decayed_frequency",
    o.sql("memories", "SELECT namespace, token, round((1 - pow(0.995::DOUBLE, df)) / 0.005, 5) AS frequency FROM df",
          _TOK, _DF),
)
def corpus_decayed_frequency(spark, sf):
    df = cp.token_df(cp.item_tokens(ad.memories(spark, sf)))
    return df.select("namespace", "token", F.round(cp.decayed_frequency(F.col("df")), 5).alias("frequency"))


@query(
    "corpus_prefix_variants",
    o.sql("memories queries", """SELECT DISTINCT query_id, q.namespace, q.token, v.token AS variant FROM qt q
      JOIN df v ON v.namespace = q.namespace AND (v.token = q.token OR
      (length(q.token) >= 4 AND length(v.token) >= 4 AND left(v.token, 4) = left(q.token, 4)))""",
          _TOK, _DF, o.tokens("qt", "queries", "query_id, namespace")),
)
def corpus_prefix_variants(spark, sf):
    q = cp.item_tokens(ad.queries(spark, sf), key="query_id").drop("n_tokens")
    vocab = cp.token_df(cp.item_tokens(ad.memories(spark, sf)))
    return cp.prefix_variants(q, vocab)


@query(
    "corpus_space_stats",
    o.sql("", """SELECT *, unique_tokens * 12 + pairs * 16 AS memory_bytes FROM (SELECT namespace, s.n AS docs, (SELECT count(*) FROM tok t WHERE t.namespace = s.namespace) AS tokens_seen,
      (SELECT count(*) FROM df t WHERE t.namespace = s.namespace) AS unique_tokens,
      (SELECT count(*) FROM pairs t WHERE t.namespace = s.namespace) AS pairs, 0 AS vectors FROM sizes s)""", _P, _PT, _PAIRS, _PDF, _PN),
)
def corpus_space_stats(spark, sf):
    log = _passages(spark, sf)
    return cp.space_stats(
        cp.item_tokens(log), cp.namespace_size(log), cp.cooccurrence_all(log)
    )


@query(
    "corpus_neighbors",
    o.sql("user_vectors", """SELECT namespace, token, round(similarity, 6) AS similarity FROM (
      SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY similarity DESC, token) AS r FROM (
      SELECT a.namespace, a.token, list_cosine_similarity(a.vec, b.vec) AS similarity FROM u a JOIN u b
      ON a.namespace = b.namespace WHERE b.token = 't1' AND a.token <> 't1') WHERE similarity > 0) WHERE r <= 10""",
          """u AS (SELECT user_id AS namespace, token, arg_max(vec, epoch) AS vec FROM user_vectors GROUP BY 1, 2)"""),
)
def corpus_neighbors(spark, sf):
    v = ad.user_vectors(spark, sf).groupBy(F.col("user_id").alias("namespace"), "token").agg(
        F.max_by("vec", "epoch").alias("vec")
    )
    return cp.neighbors(v, "t1", 10).select(
        "namespace", "token", F.round("similarity", 6).alias("similarity")
    )


@query(
    "corpus_mean_vector",
    o.sql("user_vectors", """SELECT user_id AS namespace, array_to_string(list(x ORDER BY i), ' ') AS mean FROM (
      SELECT user_id, i, printf('%.5f', round(avg(v), 5) + 0.0) AS x FROM (SELECT user_id, unnest(vec) AS v,
      generate_subscripts(vec, 1) AS i FROM user_vectors) GROUP BY 1, 2) GROUP BY 1"""),
)
def corpus_mean_vector(spark, sf):
    v = ad.user_vectors(spark, sf).select(F.col("user_id").alias("namespace"), "token", "epoch", "vec")
    tokens = v.select("namespace", "token").distinct()
    m = cp.mean_vector(tokens, v, ["namespace"], 64)
    return m.select(
        "namespace",
        F.array_join(
            F.transform("vec", lambda x: F.format_string("%.5f", F.round(x, 5) + F.lit(0.0))), " "
        ).alias("mean"),
    )
