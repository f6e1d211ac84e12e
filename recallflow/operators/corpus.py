"""Corpus statistics: document frequency, co-occurrence, sketches, PPMI spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallflow.functions import text as tx
from recallflow.functions import vectors as vx
from recallflow.operators.scans import top_k
from recallflow.session import stored

CMS_WIDTH = 65536
CMS_DEPTH = 4


def item_tokens(items: DataFrame, text: str = "text", key: str = "mem_id") -> DataFrame:
    """(namespace, key, token, n_tokens): one row per distinct token of an item.

    Outer explode plus a null filter, here and wherever an array is computed from text: the
    optimizer answers an inner explode with a "size > 0" filter below it and would tokenise
    every text twice.
    """
    t = items.select("namespace", key, tx.token_set(F.col(text)).alias("_t"))
    # The length is fixed before the explode, so the array itself is not copied per token.
    sized = t.withColumn("n_tokens", F.size("_t"))
    return sized.select("namespace", key, F.explode_outer("_t").alias("token"), "n_tokens").where(
        F.col("token").isNotNull()
    )


def namespace_size(items: DataFrame) -> DataFrame:
    return items.groupBy("namespace").agg(F.count(F.lit(1)).alias("n_items"))


def token_df(tokens: DataFrame) -> DataFrame:
    """Items per (namespace, token). Tokens are distinct per item already, so a plain
    count combines map-side and no distinct shuffle is needed."""
    return tokens.groupBy("namespace", "token").agg(F.count(F.lit(1)).alias("df"))


def idf_expr(df: Column, n: Column) -> Column:
    return F.log(1.0 + F.greatest(n, F.lit(1)) / (1.0 + df))


def entropy_weight_expr(df: Column, n: Column) -> Column:
    p = df / n
    h = -p * F.log2(F.greatest(p, F.lit(1e-15))) - (1 - p) * F.log2(
        F.greatest(1 - p, F.lit(1e-15))
    )
    return F.when((df == 0) | (df == n), 1.0).otherwise(F.greatest(F.lit(0.1), 1 - h))


def token_weights(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """(namespace, token, df, idf, entropy_weight)."""
    n = F.greatest("n_items", F.lit(1))
    return df.join(sizes, "namespace").select(
        "namespace",
        "token",
        "df",
        idf_expr(F.col("df"), F.col("n_items")).alias("idf"),
        entropy_weight_expr(F.col("df"), n).alias("entropy_weight"),
    )


def global_idf(tokens: DataFrame, n_items: int) -> DataFrame:
    """idf over all namespaces together."""
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn(
        "idf", idf_expr(F.col("df"), F.lit(n_items))
    )


def _pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("namespace", "token_a", "token_b").agg(F.count(F.lit(1)).alias("pairs"))


def cooccurrence_all(items: DataFrame, text: str = "text") -> DataFrame:
    """Counts of unordered distinct token pairs per item.

    The pairs of one item are its result, so the form is meant for short items; they are
    streamed token by token (never held as one array) and combined map-side. Long texts
    use :func:`cooccurrence_window`, whose pair count is linear.
    """
    t = items.select("namespace", F.array_sort(tx.token_set(F.col(text))).alias("t"))
    head = t.select("namespace", "t", F.posexplode_outer("t").alias("i", "token_a")).where(F.col("i").isNotNull())
    pairs = head.select(
        "namespace",
        "token_a",
        F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("token_b"),
    )
    return _pair_counts(pairs)


def cooccurrence_window(items: DataFrame, window: int = 5, text: str = "text") -> DataFrame:
    """Counts of pairs of each token with the ``window`` tokens before it (index order)."""
    t = items.select("namespace", tx.tokenize(F.col(text)).alias("t"))
    head = t.select("namespace", "t", F.posexplode_outer("t").alias("i", "tok")).where(F.col("i").isNotNull())
    start = F.greatest(F.col("i") - window, F.lit(0))
    near = head.select(
        "namespace", "tok", F.explode(F.slice("t", start + 1, F.col("i") - start)).alias("prev")
    )
    pairs = near.select(
        "namespace", F.least("tok", "prev").alias("token_a"), F.greatest("tok", "prev").alias("token_b")
    )
    return _pair_counts(pairs)


def _cms_cells(pairs: DataFrame, *cols: str) -> DataFrame:
    cells = F.array(
        *[
            F.struct(
                F.lit(r).alias("cms_row"),
                F.conv(
                    F.right(
                        F.md5(F.concat_ws(":", F.lit(str(r)), F.col("token_a"), F.col("token_b"))),
                        F.lit(4),
                    ),
                    16,
                    10,
                ).cast("int").alias("cms_bucket"),
            )
            for r in range(CMS_DEPTH)
        ]
    )
    return pairs.select(*cols, F.explode(cells).alias("c")).select(*cols, "c.*")


def cms_build(pair_counts: DataFrame) -> DataFrame:
    """Count-min sketch as rows: (namespace, row, bucket, total); at most 4 x 65536 each."""
    cells = _cms_cells(pair_counts, "namespace", "pairs")
    return cells.groupBy("namespace", "cms_row", "cms_bucket").agg(F.sum("pairs").alias("total"))


def cms_query(sketch: DataFrame, pairs: DataFrame) -> DataFrame:
    """Estimated count per pair: the least of its four cells."""
    keys = ["namespace", "token_a", "token_b"]
    cells = _cms_cells(pairs.select(*keys).distinct(), *keys)
    return (
        cells.join(sketch, ["namespace", "cms_row", "cms_bucket"], "left")
        .groupBy(*keys)
        .agg(F.min(F.coalesce("total", F.lit(0))).alias("estimate"))
    )


def ppmi(pair_counts: DataFrame, df: DataFrame, sizes: DataFrame) -> DataFrame:
    """Positive pointwise mutual information per pair; pairs at or below 0 are left out."""
    a = df.select("namespace", F.col("token").alias("token_a"), F.col("df").alias("df_a"))
    b = df.select("namespace", F.col("token").alias("token_b"), F.col("df").alias("df_b"))
    value = F.log(F.col("n_items") * F.col("pairs") / (F.col("df_a") * F.col("df_b")))
    return (
        pair_counts.join(a, ["namespace", "token_a"])
        .join(b, ["namespace", "token_b"])
        .join(sizes, "namespace")
        .select("namespace", "token_a", "token_b", value.alias("ppmi"))
        .where(F.col("ppmi") > 0)
    )


def svd_vocab(df: DataFrame, pair_counts: DataFrame, cap: int | None = None) -> DataFrame:
    """Tokens that occur in a pair and in two items or more; with ``cap`` only that many of
    the most frequent per namespace, the others then have no vector."""
    paired = pair_counts.select("namespace", F.col("token_a").alias("token")).unionByName(
        pair_counts.select("namespace", F.col("token_b").alias("token"))
    ).distinct()
    common = df.where(F.col("df") >= 2).join(paired, ["namespace", "token"], "left_semi")
    return common if cap is None else top_k(common, ["namespace"], [F.desc("df"), F.asc("token")], cap).drop("rank")


def mean_vector(tokens: DataFrame, vectors: DataFrame, keys: list[str], dims: int) -> DataFrame:
    """Mean of the available token vectors per group; groups without one are left out."""
    joined = tokens.join(vectors, ["namespace", "token"])
    return vx.fold(joined, keys, "vec", dims, F.avg)


def neighbors(vectors: DataFrame, token: str, k: int = 10) -> DataFrame:
    """Nearest tokens of one token inside every namespace that knows it."""
    probe = vectors.where(F.col("token") == token).select(
        "namespace", F.col("vec").alias("probe")
    )
    sims = (
        vectors.where(F.col("token") != token)
        .join(probe, "namespace")
        .select("namespace", "token", vx.cosine(F.col("vec"), F.col("probe")).alias("similarity"))
        .where(F.col("similarity") > 0)
    )
    return top_k(sims, ["namespace"], [F.desc("similarity"), F.asc("token")], k)


def decayed_frequency(n: Column) -> Column:
    """Sum of 0.995^i over n own observations, in closed form."""
    return (1 - F.pow(F.lit(0.995), n)) / 0.005


def evict_vocab(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Drop the least frequent fifth of every vocabulary larger than ``limit`` tokens; None,
    the default, keeps all. Tokens of one frequency go by their code points.

    Buckets of one frequency and one first letter pair go or stay as a whole; only the one
    that holds the border of its namespace has its tokens numbered.
    """
    if limit is None:
        return df
    columns = df.columns
    df = stored(df.withColumn("_head", F.substring("token", 1, 2)))
    buckets = df.groupBy("namespace", F.struct("df", "_head").alias("_edge")).agg(F.count(F.lit(1)).alias("_n"))
    order = W.partitionBy("namespace").orderBy("_edge").rowsBetween(W.unboundedPreceding, 0)
    buckets = buckets.withColumns({"_upto": F.sum("_n").over(order), "_size": F.sum("_n").over(W.partitionBy("namespace"))})
    gone = F.floor(F.col("_size") / 5)
    # The first bucket that is not dropped as a whole; in a vocabulary that stays, the first one.
    # Written, so that its size is known: a row per namespace.
    border = stored(buckets.where((F.col("_size") <= limit) | (F.col("_upto") > gone)).groupBy("namespace").agg(
        F.min(F.struct("_edge", F.when(F.col("_size") > limit, gone - F.col("_upto") + F.col("_n")).otherwise(0).alias("_drop"))).alias("_b")
    ).withColumnRenamed("namespace", "_of"))
    placed = df.join(border, F.col("namespace").eqNullSafe(F.col("_of")))
    own = F.struct("df", "_head")
    above = placed.where(own > F.col("_b._edge"))
    inside = placed.where(own == F.col("_b._edge")).withColumn("_at", F.row_number().over(W.partitionBy("namespace").orderBy("token")))
    return above.select(*columns).unionByName(inside.where(F.col("_at") > F.col("_b._drop")).select(*columns))


def evict_pairs(pair_counts: DataFrame, kept: DataFrame) -> DataFrame:
    """Pairs whose two tokens both survived :func:`evict_vocab`."""
    k = kept.select("namespace", "token")
    return pair_counts.join(
        k.withColumnRenamed("token", "token_a"), ["namespace", "token_a"], "left_semi"
    ).join(k.withColumnRenamed("token", "token_b"), ["namespace", "token_b"], "left_semi")


def prefix_variants(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Indexed tokens sharing a four-character prefix; shorter tokens match exactly.

    ``tokens`` has (query_id, namespace, token); the result adds ``variant``.
    """
    key = F.substring("token", 1, 4)
    # One equi-join serves both cases: long tokens meet on their prefix, short ones on
    # themselves (a short token never equals a four-character prefix).
    q = tokens.withColumn("stem", key)
    v = vocab.select("namespace", F.col("token").alias("variant")).withColumn(
        "stem", F.substring("variant", 1, 4)
    )
    return q.join(v, ["namespace", "stem"]).drop("stem")


def space_stats(
    tokens: DataFrame,
    sizes: DataFrame,
    pair_counts: DataFrame,
    vectors: DataFrame | None = None,
    dims: int = 50,
) -> DataFrame:
    """Documents, tokens seen, distinct tokens, pairs, vectors and bytes per namespace."""
    seen = tokens.groupBy("namespace").agg(F.count(F.lit(1)).alias("tokens_seen"))
    uniq = token_df(tokens).groupBy("namespace").agg(F.count(F.lit(1)).alias("unique_tokens"))
    pairs = pair_counts.groupBy("namespace").agg(F.count(F.lit(1)).alias("pairs"))
    out = (
        sizes.withColumnRenamed("n_items", "docs")
        .join(seen, "namespace", "left")
        .join(uniq, "namespace", "left")
        .join(pairs, "namespace", "left")
    )
    if vectors is None:
        out = out.withColumn("vectors", F.lit(0).cast("bigint"))
    else:
        counts = vectors.groupBy("namespace").agg(F.count(F.lit(1)).alias("vectors"))
        out = out.join(counts, "namespace", "left")
    out = out.fillna(0)
    return out.withColumn(
        "memory_bytes", F.col("vectors") * dims * 8 + F.col("unique_tokens") * 12 + F.col("pairs") * 16
    )
