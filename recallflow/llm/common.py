"""Helpers the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallflow.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = " \t\n\x0b\x0c\r"


def bound_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Bound what Spark hands to a Python worker at once, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet files in the folder that driver and executors share."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """True for the fold no label is learnt from; a null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def chunks(items: list[bytes], size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges (from, to) of ``items`` of about ``size`` bytes; one longer item stands alone."""
    first = total = 0
    for i, item in enumerate(items):
        if total and total + len(item) > size:
            yield first, i
            first, total = i, 0
        total += len(item)
    if items:
        yield first, len(items)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` less the columns whose names an operator is about to give out."""
    clash = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in clash])


def appended(
    df: DataFrame, column: str, fn: Callable[[pa.Array], list[pa.Array]], fields: list[tuple[str, str]], finish: Callable[[], None] | None = None
) -> DataFrame:
    """``df`` with the columns ``fn`` makes from one column, batch by batch.

    ``fields`` are (name, type); columns of those names already there are replaced.
    ``finish`` runs at the end of each partition, so that a worker that is used again does
    not hold what the partition needed.
    """
    kept = without(df, [n for n, _ in fields])
    names = [*kept.columns, *[n for n, _ in fields]]
    schema = T.StructType([*kept.schema.fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(batch.column(batch.schema.get_field_index(column)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)
        if finish:
            finish()

    return kept.mapInArrow(run, schema)
