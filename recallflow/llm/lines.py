"""Removal of lines that many documents share, through a sharded minimal perfect hash.

Distinct line keys become 128 bits: ``h`` places a key, ``f`` confirms it. The frequent ones
are dealt into shards by ``h``; each shard is a minimal perfect hash (levels of bit arrays;
a key's place is the rank of its bit) that indexes arrays of fingerprints and counts.
Documents probe these arrays line by line. While all shards together stay under a checked
size they travel to every task and no text is shuffled; beyond it the hashes of the lines,
not the texts, travel to the shards.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallflow.llm.common import WHITE, appended, ascii_lower, bound_batches, unused, without
from recallflow.llm.features import mix
from recallflow.session import cut

SEED = 42
SALT = b"line"
SEED_F = xxhash.xxh64_intdigest(SALT, SEED)
LOAD = 1.5  # bits per key and level
SPREAD = 16  # parts of a shard's probes, so that no line's probes meet in one task


class Index:
    """Minimal perfect hash over (h, f) with a fingerprint and a count per key."""

    def __init__(self, levels: list[np.ndarray], fingerprints: np.ndarray, counts: np.ndarray):
        self.levels, self.fingerprints, self.counts = levels, fingerprints, counts
        self.ranks, before = [], 0
        for bits in levels:
            words = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(before + np.concatenate([[0], np.cumsum(words)]))
            before = int(self.ranks[-1][-1])

    @staticmethod
    def _place(h: np.ndarray, f: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            salt = np.array([level + 1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            return (mix(h + salt) ^ mix(f ^ salt)) % np.uint64(size)

    @classmethod
    def build(cls, h: np.ndarray, f: np.ndarray, counts: np.ndarray) -> Index:
        """``h`` and ``f`` are unsigned; the pairs are distinct."""
        left, levels = np.arange(len(h)), []
        while len(left):
            size = 64 * max(1, int(len(left) * LOAD) // 64 + 1)
            place = cls._place(h[left], f[left], len(levels), size)
            alone = np.bincount(place.astype(np.int64), minlength=size)[place.astype(np.int64)] == 1
            flags = np.zeros(size, dtype=np.uint8)
            flags[place[alone]] = 1
            levels.append(np.packbits(flags, bitorder="little").view("<u8"))
            left = left[~alone]
        index = cls(levels, np.zeros(len(h), dtype=np.uint64), np.zeros(len(h), dtype=np.int64))
        at = index.find(h, f)
        index.fingerprints[at], index.counts[at] = f, counts
        return index

    def find(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Place of each key; -1 where no level has a bit. Strangers may get a place too."""
        out, left = np.full(len(h), -1, dtype=np.int64), np.arange(len(h))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            place = self._place(h[left], f[left], level, 64 * len(bits))
            word, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.ranks[level][word] + np.bitwise_count(below))[hit]
            left = left[~hit]
        return out

    def count(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Documents that hold each key; 0 for keys that are not in the index."""
        at = self.find(h, f)
        known = at >= 0
        known[known] = self.fingerprints[at[known]] == f[known]
        return np.where(known, self.counts[np.maximum(at, 0)] if len(self.counts) else 0, 0)

    def dump(self) -> bytes:
        head = struct.pack("<qq", len(self.levels), len(self.counts))
        sizes = np.array([len(b) for b in self.levels], dtype="<i8")
        parts = [sizes, *self.levels, self.fingerprints, self.counts]
        return head + b"".join(p.tobytes() for p in parts)

    @classmethod
    def load(cls, data: bytes) -> Index:
        n_levels, n = struct.unpack_from("<qq", data)
        sizes, at = np.frombuffer(data, "<i8", n_levels, 16), 16 + 8 * n_levels
        levels = []
        for s in sizes.tolist():
            levels.append(np.frombuffer(data, "<u8", s, at))
            at += 8 * s
        return cls(levels, np.frombuffer(data, "<u8", n, at), np.frombuffer(data, "<i8", n, at + 8 * n))


def _hashes(text: Column, min_chars: int) -> Column:
    """Distinct (h, f) of a text's line keys; short keys give null."""

    def one(line: Column) -> Column:
        key = ascii_lower(F.btrim(line, F.lit(WHITE)))
        return F.when(F.char_length(key) >= min_chars, F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(SALT.decode()), key).alias("f")))

    return F.array_distinct(F.transform(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1), one))


def frequent(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(h, f, n): line keys in at least ``min_docs`` rows, counted once per row."""
    each = docs.select(F.explode_outer(_hashes(F.col("text"), min_chars)).alias("k")).where("k IS NOT NULL")
    return each.groupBy("k.h", "k.f").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)


def shards(counted: DataFrame, shard_keys: int = 100_000) -> tuple[DataFrame, int]:
    """(shard, index) of the frequent keys, about ``shard_keys`` each; number of shards."""
    n_shards = max(1, -(-counted.count() // shard_keys))

    def build(group: pa.Table) -> pa.Table:
        h, f = (group.column(c).to_numpy().view(np.uint64) for c in ("h", "f"))
        index = Index.build(h, f, group.column("n").to_numpy())
        return pa.table({"shard": group.column("shard")[:1], "index": pa.array([index.dump()], pa.binary())})

    dealt = counted.withColumn("shard", F.pmod("h", F.lit(n_shards)).cast("int"))
    return cut(dealt.groupBy("shard").applyInArrow(build, "shard int, index binary")), n_shards


def _keys(lines: list[bytes], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """h and f of each line, and whether its key is long enough."""
    keys = [x.strip().lower() for x in lines]  # bytes: ASCII white space, A-Z
    h = np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in keys), dtype=np.uint64, count=len(keys))
    f = np.fromiter((xxhash.xxh64_intdigest(k, SEED_F) for k in keys), dtype=np.uint64, count=len(keys))
    if min_chars <= 1:
        long = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys)) >= min_chars
    else:
        long = np.array([len(k.decode("utf-8", "replace")) >= min_chars for k in keys], dtype=bool)
    return h, f, long


def _without(texts: list[bytes], drops) -> list[pa.Array]:
    """Kept text, number of lines and of dropped lines; ``drops`` judges all lines at once."""
    split = [t.split(b"\n") for t in texts]
    size = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    flat = [x for ls in split for x in ls]
    drop = drops(flat, np.repeat(np.arange(len(split)), size))
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    lost = np.add.reduceat(drop, at[:-1]) if len(split) else np.zeros(0, dtype=np.int64)
    flags = drop.tolist()
    kept = [
        texts[i] if not lost[i] else b"\n".join([x for x, d in zip(split[i], flags[at[i] : at[i + 1]], strict=True) if not d])
        for i in range(len(split))
    ]
    return [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(size, pa.int64()), pa.array(lost, pa.int64())]


_MADE = [("kept_text", "string"), ("n_lines", "bigint"), ("n_dropped", "bigint")]


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _probe_here(docs: DataFrame, blobs: list[bytes], n_shards: int, min_chars: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(blobs)
    loaded: list[list[Index]] = []

    def drops(lines: list[bytes], _: np.ndarray) -> np.ndarray:
        if not loaded:
            loaded.append([Index.load(b) for b in shared.value])
        h, f, long = _keys(lines, min_chars)
        shard = h.view(np.int64) % n_shards
        out = np.zeros(len(lines), dtype=np.int64)
        for s, index in enumerate(loaded[0]):
            mine = np.flatnonzero(long & (shard == s))
            out[mine] = index.count(h[mine], f[mine]) > 0
        return out

    return appended(docs, "text", lambda column: _without(_bytes(column), drops), _MADE)


def _probe_there(docs: DataFrame, indexes: DataFrame, n_shards: int, min_chars: int) -> DataFrame:
    """Hashes of lines go to the shards, hits come back to their documents."""
    spread = F.pmod(F.xxhash64("doc_id", "k.h"), F.lit(SPREAD)).cast("int")
    asked = (
        docs.select("doc_id", F.explode_outer(_hashes(F.col("text"), min_chars)).alias("k")).where("k IS NOT NULL")
        .select(F.pmod("k.h", F.lit(n_shards)).cast("int").alias("shard"), spread.alias("part"), F.lit(1).alias("turn"), "doc_id", "k.h", "k.f", F.lit(None).cast("binary").alias("index"))
    )
    none = F.lit(None).cast("bigint")
    held = indexes.select(
        "shard", F.explode(F.array(*[F.lit(i) for i in range(SPREAD)])).alias("part"), F.lit(0).alias("turn"),
        none.cast(docs.schema["doc_id"].dataType).alias("doc_id"), none.alias("h"), none.alias("f"), "index",
    )
    both = held.unionByName(asked).repartition("shard", "part").sortWithinPartitions("shard", "part", "turn")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None  # of the shard whose rows are passing; it comes before its probes
        for batch in batches:
            turns = batch.column("turn").to_numpy()
            starts = np.flatnonzero(turns == 0).tolist()
            hits = np.zeros(len(turns), dtype=bool)
            h, f = (batch.column(c).fill_null(0).to_numpy().view(np.uint64) for c in ("h", "f"))
            for a, b in zip([0, *starts], [*starts, len(turns)], strict=True):
                if a < b and turns[a] == 0:
                    index = Index.load(batch.column("index")[a].as_py())
                    a += 1
                if a < b and index is not None:
                    hits[a:b] = index.count(h[a:b], f[a:b]) > 0
            yield batch.select(["doc_id", "h", "f"]).filter(pa.array(hits))

    kind = docs.schema["doc_id"].dataType.simpleString()
    hits = both.mapInArrow(probe, f"doc_id {kind}, h bigint, f bigint")
    lost = unused(docs, "lost")
    lists = cut(hits.groupBy("doc_id").agg(F.collect_set(F.struct("h", "f")).alias(lost)).withColumnRenamed("doc_id", "_id"))
    joined = docs.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    packed = joined.withColumn(lost, F.struct(F.col("text").alias("text"), F.col(lost).alias("lost")))

    def run(column: pa.Array) -> list[pa.Array]:
        sets = [{(x["h"], x["f"]) for x in ls or []} for ls in column.field("lost").to_pylist()]

        def drops(lines: list[bytes], owner: np.ndarray) -> np.ndarray:
            h, f, long = _keys(lines, min_chars)
            pairs = zip(h.view(np.int64).tolist(), f.view(np.int64).tolist(), owner.tolist(), long.tolist(), strict=True)
            return np.array([k and (x, y) in sets[o] for x, y, o, k in pairs], dtype=np.int64)

        return _without(_bytes(column.field("text")), drops)

    return appended(packed, lost, run, _MADE).drop(lost)


def deduplicated(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, shard_keys: int = 100_000, here_bytes: int = 64 << 20
) -> DataFrame:
    """``docs`` with kept_text, n_lines and n_dropped.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys
    of at least ``min_chars`` code points in at least ``min_docs`` rows lose all their lines;
    the others stay, joined by a newline. A null or empty text is one empty line. Indexes
    of at most ``here_bytes`` in all are sent to the tasks; larger ones are probed where
    they are, with the same result.
    """
    bound_batches(docs.sparkSession)
    docs = without(docs, [n for n, _ in _MADE])
    counted = cut(frequent(docs, min_docs, min_chars))
    indexes, n_shards = shards(counted, shard_keys)
    total = indexes.agg(F.sum(F.octet_length("index"))).first()[0] or 0
    if total > here_bytes:
        return _probe_there(docs, indexes, n_shards, min_chars)
    found = dict(indexes.collect())
    empty = Index.build(*[np.zeros(0, dtype=np.uint64)] * 2, np.zeros(0, dtype=np.int64)).dump()
    return _probe_here(docs, [found.get(s, empty) for s in range(n_shards)], n_shards, min_chars)
