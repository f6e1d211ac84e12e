"""Quartile bucket digests: short fingerprints whose difference follows that of the texts.

Byte triplets are hashed into buckets; a bucket's count is coded by the quartile of all
counts it falls in, two bits each, behind a code of the text's length. Two digests differ
by the steps between their codes, and the likeness is one less that difference, bounded,
where one is the difference that codes of these frequencies have by chance: a short text
fills few buckets, and the empty ones that it shares with any other prove nothing.
The three bytes of a triplet lie apart: neighbouring letters tell the language rather than
the text.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallflow.llm.common import bound_batches
from recallflow.session import cut

BUCKETS = 1024
PLACES = (0, 5, 11)  # of a triplet's bytes
_STEPS = np.abs(np.arange(4)[:, None] - np.arange(4))
QUARTILES = [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]


def _length_code(n: int) -> int:
    return min(255, round(8 * np.log2(n + 1)))


def counts(data: bytes) -> np.ndarray:
    """Counts of the hashed triplets, one a byte: the text closes to a ring, so that a short
    one has them too."""
    b = np.frombuffer(data, dtype=np.uint8)
    x, y, z = PLACES
    out = np.zeros(BUCKETS, dtype=np.int64)
    if not len(b):
        return out
    b = np.concatenate([b, np.resize(b, z)])
    for at in range(0, len(b) - z, 1 << 20):
        n = min(1 << 20, len(b) - z - at)
        part = b[at : at + n + z].astype(np.uint32)
        h = (part[x : x + n] | part[y : y + n] << 8 | part[z : z + n] << 16) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        out += np.bincount(h >> np.uint32(33 - BUCKETS.bit_length()), minlength=BUCKETS)
    return out


def digest(data: bytes) -> bytes:
    """Length code, then two bits a bucket: how many quartiles its count is above."""
    c = counts(data)
    q = np.partition(c, QUARTILES)[QUARTILES]
    code = (c > q[0]).astype(np.uint8) + (c > q[1]) + (c > q[2])
    return bytes([_length_code(len(data))]) + np.packbits(np.stack([code >> 1, code & 1], axis=1).ravel()).tobytes()


def likeness(x: bytes, y: bytes) -> float:
    """One for equal digests, zero from the difference on that chance would give."""
    if x == y:
        return 1.0
    a, b = (np.unpackbits(np.frombuffer(d, dtype=np.uint8)[1:]).reshape(-1, 2).astype(np.int64) for d in (x, y))
    a, b = 2 * a[:, 0] + a[:, 1], 2 * b[:, 0] + b[:, 1]
    steps = np.abs(a - b).sum() + max(0, abs(x[0] - y[0]) - 8) / 2
    by_chance = np.bincount(a, minlength=4) @ _STEPS @ np.bincount(b, minlength=4) / BUCKETS
    return float(max(0.0, 1.0 - steps / by_chance)) if by_chance else 0.0


Place = tuple[bool, int, int]


def _places(batch: pa.RecordBatch) -> list[Place]:
    """Sort keys in descending doc_id: nulls last, then by the hash of the text."""
    ids, hashes = batch.column("doc_id").to_pylist(), batch.column("hash").to_pylist()
    return [(i is None, 0 if i is None else ~i, h) for i, h in zip(ids, hashes, strict=True)]


def _ranges(rows: DataFrame, range_rows: int, max_ranges: int) -> tuple[list[Place], dict[Place, int]]:
    """Bounds of the ranges in reading order; the first row of each range with a row, and
    the range before it, which needs that row too. Both are bounded by ``max_ranges``."""
    total = rows.count()
    n = max(1, min(total // range_rows, max_ranges))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "hash"), 12) / float(1 << 52)
    sample = rows.where(draw < min(1.0, 20 * n / max(total, 1))).toArrow()
    keys = sorted(k for b in sample.to_batches() for k in _places(b))
    bounds = sorted({keys[i] for i in range(20, len(keys), 20)}) if n > 1 else []

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _places(batch)
            parts = zip(*keys, strict=True) if keys else ([], [], [])
            columns = [pa.array(c, t) for c, t in zip(parts, (pa.bool_(), pa.int64(), pa.int64()), strict=True)]
            numbers = pa.array([bisect_right(bounds, k) for k in keys], pa.int32())
            yield pa.record_batch([numbers, *columns], ["range", "last", "place", "hash"])

    firsts = (
        rows.mapInArrow(number, "range int, last boolean, place bigint, hash bigint")
        .groupBy("range").agg(F.min(F.struct("last", "place", "hash")).alias("k")).orderBy("range").collect()
    )
    if not firsts:
        return bounds, {}
    before = [firsts[-1]["range"], *[r["range"] for r in firsts[:-1]]]
    return bounds, {tuple(r["k"]): b for r, b in zip(firsts, before, strict=True)}


def with_next(docs: DataFrame, range_rows: int = 500, max_ranges: int = 100_000) -> DataFrame:
    """(doc_id, text, ...) digests of each text, of its edit and of the next document.

    The next document is the one of the next smaller doc_id; the first again after the last;
    null ids come last, equal ids in the order of their texts' hashes. The edit of a text
    replaces its last third (rounded down, code points) by as many first code points of the
    next text. Texts are dealt into ranges of doc_id, each holding the first row of the
    range behind it, so every text meets its neighbour in one pass; no range is unbounded
    unless one doc_id repeats with one text. A null text counts as empty.
    """
    bound_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = keyed.withColumn("hash", F.xxhash64("text"))
    bounds, guests = _ranges(cut(keyed.select("doc_id", "hash")), range_rows, max_ranges)
    shared = docs.sparkSession.sparkContext.broadcast((bounds, guests))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, guests = shared.value
        for batch in batches:
            keys = _places(batch)
            own = [(i, bisect_right(bounds, k), False) for i, k in enumerate(keys)]
            own += [(i, guests[k], True) for i, k in enumerate(keys) if k in guests]
            take, ranges, guest = (list(c) for c in zip(*own, strict=True)) if own else ([], [], [])
            columns = batch.take(pa.array(take, pa.int32())).columns
            yield pa.record_batch(
                [pa.array(ranges, pa.int32()), pa.array(guest, pa.bool_()), *columns], ["range", "guest", "doc_id", "text", "hash"]
            )

    kind = keyed.schema["doc_id"].dataType.simpleString()
    dealt = keyed.mapInArrow(deal, f"range int, guest boolean, doc_id {kind}, text string, hash bigint")
    ordered = dealt.repartition("range").sortWithinPartitions(
        "range", "guest", F.col("doc_id").desc_nulls_last(), "hash"
    )

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (range, doc_id, text, digest) that waits for its next
        for batch in batches:
            out: list[tuple] = []
            for at, guest, doc_id, text in zip(*[batch.column(c).to_pylist() for c in ("range", "guest", "doc_id", "text")], strict=True):
                mine = digest(text.encode("utf-8", "replace"))
                if last is not None and last[0] == at:
                    _, i, t, d = last
                    k = len(t) // 3
                    edit = t[: len(t) - k] + text[:k]
                    e = digest(edit.encode("utf-8", "replace"))
                    out.append((i, len(t), edit, d, e, likeness(d, e), likeness(d, mine)))
                last = None if guest else (at, doc_id, text, mine)
            columns = list(zip(*out, strict=True)) if out else [[]] * len(schema)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    schema = pa.schema([
        ("doc_id", batch_type(kind)), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.binary()),
        ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ])
    return ordered.mapInArrow(
        pair, f"doc_id {kind}, n_chars bigint, edited string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    )


def batch_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16()}[kind]
