"""Vector arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallflow.functions.text import bind


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 when either side has (nearly) no length."""
    scale = norm(a) * norm(b)
    tiny = (norm(a) < 1e-12) | (norm(b) < 1e-12)
    return F.when(tiny, 0.0).otherwise(dot(a, b) / scale)


def cosine_damped(a: Column, b: Column) -> Column:
    """Cosine with 1e-9 added to the denominator."""
    return dot(a, b) / (norm(a) * norm(b) + 1e-9)


def unit(a: Column) -> Column:
    """Scale to length one; null when the length is (nearly) zero."""
    return bind(norm(a), lambda n: F.when(n > 1e-12, F.transform(a, lambda v: v / n)))


def fold(df: DataFrame, keys: list[str], vec: str, dims: int, how, out: str = "vec", *more) -> DataFrame:
    """Element-wise aggregate of a vector column.

    One aggregate per dimension keeps the combine map-side and in generated code; no
    row per (vector, dimension) is ever shuffled.
    """
    v = F.col(vec)
    aggs = [how(F.get(v, F.lit(d))).alias(f"_d{d}") for d in range(dims)]
    wide = df.groupBy(*keys).agg(*aggs, *more)
    extra = [c for c in wide.columns if not c.startswith("_d")]
    return wide.select(*extra, F.array(*[F.col(f"_d{d}") for d in range(dims)]).alias(out))
