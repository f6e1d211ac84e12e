"""Exact percentiles of a large column: count into cells, then rank inside a cell.

The cells follow the order of the values: 256 an octave, then 4,096 in a cell that holds a
wanted rank, then single values with their counts. Every pass adds up map-side, and only the
rows of the few wanted cells go on, so nothing is sorted or held as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OCTAVE, FINE = 256, 4096


def _coarse(v: Column) -> Column:
    """Number of the cell of a value; it rises with the value, below zero as well."""
    size = F.floor(F.log2(1 + F.abs(v)) * OCTAVE)
    return F.when(v < 0, -size - 1).otherwise(size).cast("long")


def _fine(v: Column, cell: Column) -> Column:
    """Place in the coarse cell, 0 to FINE - 1."""
    def edge(c: Column) -> Column:
        size = F.pow(F.lit(2.0), F.when(c < 0, -c).otherwise(c) / OCTAVE) - 1
        return F.when(c < 0, -size).otherwise(size)

    low, high = edge(cell), edge(cell + 1)
    place = F.floor((v - low) / F.greatest(high - low, F.lit(1e-300)) * FINE)
    return F.least(F.greatest(place, F.lit(0)), F.lit(FINE - 1)).cast("long")


def _located(counts: DataFrame, wanted: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The wanted (rank, keys, left) with the step of ``order`` that holds each and what is
    left of the rank inside it. ``counts`` has keys, order and n."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0) if keys else W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.sum("n").over(w))
    lists = wanted.groupBy(*keys).agg(F.collect_list(F.struct("rank", "left")).alias("ranks"))  # two a percentile
    both = upto.join(F.broadcast(lists), keys) if keys else upto.crossJoin(F.broadcast(lists))
    here = F.filter("ranks", lambda r: (r["left"] >= F.col("upto") - F.col("n")) & (r["left"] < F.col("upto")))
    found = both.select(*keys, order, "upto", "n", F.explode(here).alias("r"))
    return found.select(F.col("r.rank").alias("rank"), *keys, order, (F.col("r.left") - F.col("upto") + F.col("n")).alias("left"))


def percentiles(df: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """One row, a column ``p_<k>`` for the k-th share: the percentile between the two
    nearest ranks, by linear interpolation. Nulls and NaN do not count; without a value
    all are null."""
    v = F.col(value).cast("double")
    rows = df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).withColumn("cell", _coarse(F.col("v")))
    total = rows.agg((F.count(F.lit(1)) - 1).alias("last"))
    ranks = F.flatten(F.array(*[F.array(F.floor(F.lit(q) * F.col("last")), F.ceil(F.lit(q) * F.col("last"))) for q in shares]))
    wanted = total.where("last >= 0").select(F.explode(F.array_distinct(ranks)).alias("rank")).withColumn("left", F.col("rank"))
    first = _located(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), wanted, [], "cell")
    near = rows.join(F.broadcast(first.select("cell").distinct()), "cell").withColumn("place", _fine(F.col("v"), F.col("cell")))
    second = _located(near.groupBy("cell", "place").agg(F.count(F.lit(1)).alias("n")), first, ["cell"], "place")
    close = near.join(F.broadcast(second.select("cell", "place").distinct()), ["cell", "place"])
    third = _located(close.groupBy("cell", "place", "v").agg(F.count(F.lit(1)).alias("n")), second, ["cell", "place"], "v")
    held = third.agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    out = []
    for k, q in enumerate(shares):
        spot = F.lit(q) * F.col("last")
        low, high = (F.element_at("at", f(spot)) for f in (F.floor, F.ceil))
        out.append(F.when(F.floor(spot) == F.ceil(spot), low).otherwise(low * (F.ceil(spot) - spot) + high * (spot - F.floor(spot))).alias(f"p_{k}"))
    return total.crossJoin(F.broadcast(held)).select(*out)
