"""Shards of near equal bytes by histogram sort.

Rows are ordered by a key that any task can compute: hash of the text, hash of the id, and
the row's number in a written table, so equal texts are neighbours and no two keys are
equal. Candidate boundaries are counted exactly, in all partitions at once; of every wanted
place the interval around it is kept and the next candidates lie inside, until one meets
the tolerance or a single row is left. Then each row's block follows from the boundaries
alone and rows move once. Blocks are pieces of shards of a bounded size, so no task holds a
shard; a row's slot is its rank in the block plus the rows of its shard before the block,
which the counting has told.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallflow.llm.common import bound_batches, without, written

COLUMNS = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
KEY = ("k1", "k2", "k3")
WIDTH = 8 * len(KEY)
TEXT = 128  # keys of one text agree above so many bits
PROBES = 24  # candidates a wanted place and round


@dataclass(frozen=True)
class Interval:
    """Neighbouring rows: what lies before them, what they hold, the least and greatest key."""

    bytes_before: int
    rows_before: int
    bytes: int
    rows: int
    least: int
    greatest: int

    def sides(self) -> list[tuple[int, int, int]]:
        """(bytes below, rows below, key) of the boundaries before and behind."""
        return [
            (self.bytes_before, self.rows_before, self.least),
            (self.bytes_before + self.bytes, self.rows_before + self.rows, self.greatest + 1),
        ]

    def one_text(self) -> bool:
        return self.least >> TEXT == self.greatest >> TEXT

    def candidates(self, count: int) -> list[int]:
        """Up to ``count`` keys that part the rows: edges of texts, or keys within the one
        text. The last one always parts the greatest key from the least."""
        unit = 0 if self.one_text() else TEXT
        first, last = (self.least >> unit) + 1, self.greatest >> unit
        count = min(count, last - first + 1)
        return sorted({(last - (last - first) * k // count) << unit for k in range(count)})


def _packed(keys: list[int]) -> np.ndarray:
    last = (1 << 8 * WIDTH) - 1
    return np.array([min(k, last).to_bytes(WIDTH, "big") for k in keys], dtype=f"S{WIDTH}")


def _keys(columns: list[pa.Array]) -> np.ndarray:
    """Big-endian bytes of the three signed numbers, in their unsigned order."""
    parts = [c.to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63) for c in columns]
    return np.ascontiguousarray(np.stack(parts, axis=1).astype(">u8")).view(f"S{WIDTH}").ravel()


def counted(rows: DataFrame, keys: list[int]) -> list[Interval]:
    """The non-empty intervals between the sorted candidates. Every partition adds up its
    rows between two of them, then the partitions' sums are added."""
    bounds, many = _packed(keys), len(keys) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(many, dtype=np.int64), np.zeros(many, dtype=np.int64)
        ends: dict[int, tuple[bytes, bytes]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            key = _keys([batch.column(k) for k in range(3)])
            order = np.argsort(key)
            key, own = key[order], batch.column(3).to_numpy()[order]
            at = np.searchsorted(bounds, key, side="right")
            first = np.flatnonzero(np.diff(at, prepend=-1))
            size[at[first]] += np.add.reduceat(own, first)
            rows += np.bincount(at, minlength=many)
            for a, b in zip(first.tolist(), [*(first[1:] - 1).tolist(), len(at) - 1], strict=True):
                low, high = ends.get(at[a], (key[a], key[b]))
                ends[at[a]] = (min(low, key[a]), max(high, key[b]))
        used = np.flatnonzero(rows)
        sides = [[bytes(ends[u][k]).ljust(WIDTH, b"\0") for u in used] for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(size[used]), pa.array(rows[used]), *[pa.array(s, pa.binary()) for s in sides]], names=["at", "size", "many", "least", "greatest"]
        )

    parts = rows.select(*KEY, "size").mapInArrow(run, "at bigint, size bigint, many bigint, least binary, greatest binary")
    total = parts.groupBy("at").agg(F.sum("size").alias("size"), F.sum("many").alias("many"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    out, size, before = [], 0, 0
    for r in sorted(total.toArrow().to_pylist(), key=lambda r: r["at"]):
        out.append(Interval(size, before, r["size"], r["many"], *(int.from_bytes(r[k], "big") for k in ("least", "greatest"))))
        size, before = size + r["size"], before + r["many"]
    return out


def splitters(rows: DataFrame, whole: Interval, wanted: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """(bytes below, rows below, key) for each wanted (bytes below, tolerance), rising.

    Within the tolerance any edge between texts does, the nearest counted; where it lies
    inside one text with both edges too far, any row within the tolerance, at last the
    nearest row."""
    found: dict[int, tuple[int, int, int]] = {}
    around = {k: whole for k in range(len(wanted))}
    while around:
        for k, held in list(around.items()):
            want, slack = wanted[k]
            near = min(held.sides(), key=lambda s: (abs(s[0] - want), s))
            if held.rows == 1 or abs(near[0] - want) <= slack:
                found[k] = near
                del around[k]
        sharing: dict[Interval, int] = defaultdict(int)
        for held in around.values():
            sharing[held] += 1
        inner = {c for held, places in sharing.items() for c in held.candidates(PROBES * places)}
        parts = counted(rows, sorted(inner | {c for held in sharing for c in (held.least, held.greatest + 1)}))
        starts = np.array([p.bytes_before for p in parts], dtype=np.float64)
        for k in around:
            at = max(0, int(np.searchsorted(starts, wanted[k][0], side="right")) - 1)
            around[k] = parts[at]
    out = [found[k] for k in range(len(wanted))]
    return list(accumulate(out, max))


def sharded(
    docs: DataFrame, shards: int = 24, tolerance: float = 0.002, block_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text",
    carry: list[str] | None = None,
) -> DataFrame:
    """Rows with ``COLUMNS``: shards 0 to ``shards`` - 1 of near equal bytes (law ``bytes``).

    A row's size is the UTF-8 bytes of its text and 8. A shard ends within ``tolerance``
    of its share, between two texts if there is such a place, else at the row nearest to
    it; a text that many rows hold is cut only there, so it lies in neighbouring shards.
    Slots count the rows of a shard from 0. ``carry`` names the columns that travel (all by
    default); those named like the new ones are replaced. Null text: size 8, the same text
    as an empty one. Null ids, ties and repeated rows are told apart by their number in the
    written table. Fewer rows than shards leave some shards empty; no rows, no result.
    """
    bound_batches(docs.sparkSession, rows=10_000)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    names = [c for c in docs.columns if carry is None or c in carry]
    names = without(docs.select(*[F.col(f"`{c}`") for c in names]), COLUMNS).columns
    rows = written(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names], F.lit(0).alias("_")).alias("row"), F.xxhash64(text).alias("k1"), F.xxhash64(F.col(f"`{id_col}`")).alias("k2"),
        F.monotonically_increasing_id().alias("k3"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
    ))
    all_rows = counted(rows, [])
    if all_rows:
        whole = all_rows[0]
        each = whole.bytes / shards
        pieces = max(1, -(-int(each) // block_bytes))
        wanted = [(each * k / pieces, each * tolerance if k % pieces == 0 else each / pieces / 4) for k in range(1, shards * pieces)]
        found = splitters(rows, whole, wanted)
    else:
        found, pieces = [], 1
    bounds = _packed([k for _, _, k in found])
    before = np.array([0, *[r for _, r, _ in found]], dtype=np.int64)
    before -= before[np.arange(len(before)) // pieces * pieces]

    @F.arrow_udf("struct<block: int, before: bigint>")
    def place(k1: pa.Array, k2: pa.Array, k3: pa.Array) -> pa.Array:
        at = np.searchsorted(bounds, _keys([k1, k2, k3]), side="right")
        return pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(before[at])], names=["block", "before"])

    placed = rows.withColumn("place", place(*KEY)).withColumns({"block": F.col("place.block"), "before": F.col("place.before")})
    rank = F.row_number().over(Window.partitionBy("block").orderBy(*KEY))
    return placed.withColumn("slot", F.col("before") + rank - 1).select(
        *[F.col(f"row.`{c}`").alias(c) for c in names], "size", "text_crc32", F.lit("bytes").alias("law"),
        F.floor(F.col("block") / pieces).cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
