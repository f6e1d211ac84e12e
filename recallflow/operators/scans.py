"""Running totals and per-group top-k that survive a hot key.

A plain ``sum().over(partitionBy(key))`` sends a whole key to one task. The two-level
form here splits a key into buckets that follow the ordering: bucket totals are
pre-aggregated map-side, a small window turns them into offsets, and the row-level
window only ever sees one bucket of one key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    sums: Mapping[str, Column],
    inclusive: bool = True,
    descending: bool = False,
) -> DataFrame:
    """Add running totals ``sums`` over ``order`` within ``keys``.

    ``bucket`` must be monotone in ``order`` (for instance ``seq / 65536`` or a day).
    """

    def direct(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    df = df.withColumn("_b", bucket)
    inner = (
        W.partitionBy(*keys, "_b")
        .orderBy(*[direct(c) for c in order])
        .rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    )
    outer = W.partitionBy(*keys).orderBy(direct("_b")).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, "_b")
        .agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
        .select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
            F.col("_b").alias("_ob"),
            *[F.coalesce(F.sum(f"_t_{n}").over(outer), F.lit(0)).alias(f"_o_{n}") for n in sums],
        )
    )
    local = df.select(
        "*", *[F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"_l_{n}") for n, v in sums.items()]
    )
    match = F.col("_b").eqNullSafe(F.col("_ob"))
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = local.join(offsets, match)
    kept = [c for c in df.columns if c != "_b"]
    return out.select(*kept, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    name: str = "rank",
    descending: bool = False,
) -> DataFrame:
    """Row numbers 1..n within ``keys``, safe for a hot key."""
    return running_sum(df, keys, order, bucket, {name: F.lit(1)}, descending=descending)


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per group. The row-number filter becomes a group limit that
    prunes every map task to ``k`` rows per key before the shuffle."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def entropy_of(df: DataFrame, keys: Sequence[str], weight: str, name: str = "omega") -> DataFrame:
    """Shannon bits of positive weights per group in one aggregation.

    H = log2(T) - sum(w*log2(w))/T, so no second pass over the group is needed.
    """
    w = F.col(weight)
    return df.where(w > 0).groupBy(*keys).agg(
        (F.log2(F.sum(w)) - F.sum(w * F.log2(w)) / F.sum(w)).alias(name)
    )
