"""Near copies by the exact Jaccard similarity of word-shingle sets.

SimHash fingerprints of the sets, joined by the binary trie of ``simhash.py``, propose most
pairs; whatever is proposed is compared on the whole sets. What no fingerprint brings
together is found through shared shingles: two sets at ``SHARE`` or more have a shingle in
common among the first n - ceil(0.8 n) + 1 of each, under any one order of all shingles, so
only those are posted. Shingles that are frequent in a sample come last in that order, which
moves work, not results. The members of a posting list that no component joins are compared
with a few of them; lists still open after that have all their remaining pairs compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallflow.llm import simhash
from recallflow.llm.common import appended, bound_batches, unused, written
from recallflow.llm.components import components
from recallflow.operators.scans import top_k

WIDTH = 5
SHARE = (4, 5)
FACTORS = np.array([xxhash.xxh64_intdigest(b"%d" % k, 1) | 1 for k in range(64)], dtype=np.uint64)
HUBS = 16  # members of a list that all others are compared with
BUDGET = 3  # bits in which fingerprints may differ


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 7)], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out += h[k : k + n] * FACTORS[k]
    out ^= out >> np.uint64(31)
    return np.unique(out * FACTORS[-1])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach ``SHARE``; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SHARE[1] >= SHARE[0] * (len(a) + len(b) - both)


def sketch(s: np.ndarray, places: int = 2048) -> bytes:
    """Parities of so many places, a power of two. Two sketches differ in at most as many
    places as their sets in members."""
    odd = np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_sketch(s: np.ndarray) -> bytes | None:
    """A sketch with as many places as members, for sets that fill the usual one: of those
    all differ in about half of its places, alike or not. None for smaller sets."""
    return None if len(s) <= 2048 else sketch(s, 1 << (len(s) - 1).bit_length())


def _differ(p: bytes, q: bytes) -> int:
    """Places in which two sketches differ; the longer one is folded to the shorter."""
    a, b = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
    n = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def fingerprint(s: np.ndarray) -> int:
    """SimHash of a set: a bit is 1 if set in over half of its hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(s), 1 << 15):
        part = np.ascontiguousarray(s[at : at + (1 << 15)])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(s)).astype(np.uint8)).view(np.int64)[0])


def _head(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles of a set that are posted."""
    if not len(s):
        return s
    n = len(s) - -(-SHARE[0] * len(s) // SHARE[1]) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        last = frequent[at] == s
        s = np.concatenate([s[~last], s[last]])
    return s[:n]


def frequent(texts: DataFrame, total: int, sample: int = 10_000, least: int = 4, most: int = 200_000) -> np.ndarray:
    """Shingles in ``least`` or more of about ``sample`` different texts, sorted."""
    draw = F.shiftrightunsigned(F.xxhash64("hash", F.lit("sample")), 12) / float(1 << 52)
    few = texts.where(draw < sample / max(total, 1)).groupBy("hash").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t).view(np.int64))], names=["h"])

    seen = few.select("text").mapInArrow(run, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rows = seen.where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(most).toArrow()
    return np.sort(rows["h"].to_numpy().astype(np.int64).view(np.uint64))


def _fit(a: Column, b: Column) -> Column:
    """Sizes that leave the similarity possible."""
    return (a * SHARE[0] <= b * SHARE[1]) & (b * SHARE[0] <= a * SHARE[1])


def _bodies(asked: DataFrame, marked: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, set) of the asked keys, made anew from one text of each, written."""
    hashes = written(marked.join(asked, "key", "left_semi").groupBy("key").agg(F.min("hash").alias("hash")))
    bodies = texts.join(hashes, "hash").groupBy("key").agg(F.first("text").alias("text"))

    def run(column: pa.Array) -> list[pa.Array]:
        return [pa.array([shingles(t).tobytes() for t in column.cast(pa.binary()).to_pylist()], pa.binary())]

    return written(appended(bodies, "text", run, [("set", "binary")]).drop("text"))


def _verified(pairs: DataFrame, sets: DataFrame, marked: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (x, y) whose whole sets reach ``SHARE``, written. Sketches and
    sizes leave few for which the sets have to travel."""
    low = SHARE[1] - SHARE[0], SHARE[1] + SHARE[0]
    a, b = (sets.select(F.col("key").alias(k), F.col("sketch").alias(f"s{k}"), F.col("n").alias(f"n{k}")) for k in "xy")

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("sx", "sy"))
            size = batch.column("nx").to_numpy() + batch.column("ny").to_numpy()
            near = np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64) * low[1] <= low[0] * size
            yield batch.select(["x", "y"]).filter(pa.array(near, pa.bool_()))

    sized = pairs.join(a, "x").join(b, "y").where(_fit(F.col("nx"), F.col("ny")))
    pairs = written(sized.select("x", "y", "sx", "sy", "nx", "ny").mapInArrow(maybe, "x bigint, y bigint"))

    def still(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q, nx, ny = (batch.column(c).to_pylist() for c in ("wx", "wy", "nx", "ny"))
            near = [u is None or v is None or _differ(u, v) * low[1] <= low[0] * (i + j) for u, v, i, j in zip(p, q, nx, ny, strict=True)]
            yield batch.select(["x", "y"]).filter(pa.array(near, pa.bool_()))

    a, b = (sets.select(F.col("key").alias(k), F.col("wide").alias(f"w{k}"), F.col("n").alias(f"n{k}")) for k in "xy")
    pairs = written(pairs.join(a, "x").join(b, "y").select("x", "y", "wx", "wy", "nx", "ny").mapInArrow(still, "x bigint, y bigint"))
    # Whole sets are neither kept nor moved but for the few still asked for; the list of
    # their keys is most often small enough to be sent to the texts.
    held = _bodies(written(pairs.select(F.explode(F.array("x", "y")).alias("key")).distinct()), marked, texts)
    a, b = (held.select(F.col("key").alias(k), F.col("set").alias(f"s{k}")) for k in "xy")
    both = pairs.join(a, "x").join(b, "y").select("x", "y", "sx", "sy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sx, sy = (batch.column(k).to_pylist() for k in (2, 3))
            near = [similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(sx, sy, strict=True)]
            yield batch.select(["x", "y"]).filter(pa.array(near, pa.bool_()))

    return written(both.mapInArrow(run, "x bigint, y bigint"))


def _open(lists: DataFrame, found: DataFrame) -> DataFrame:
    """Postings (h, key, n, component) of the lists that hold several components, written."""
    labels = components(found, "x", "y").withColumnRenamed("node", "key")
    named = lists.join(labels, "key", "left").select("h", "key", "n", F.coalesce("component", "key").alias("component"))
    some = named.groupBy("h").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("h")
    return written(named.join(some, "h", "left_semi"))


def _met(lists: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs (x, y) of a list's members with those of ``other`` (h, k2, n2, c2)."""
    pairs = lists.join(other, "h").where((F.col("component") != F.col("c2")) & _fit(F.col("n"), F.col("n2")))
    return pairs.select(F.least("key", "k2").alias("x"), F.greatest("key", "k2").alias("y")).distinct()


def links(marked: DataFrame, texts: DataFrame) -> DataFrame:
    """(x, y) keys of different sets with the components of "similar at ``SHARE`` or more"."""
    sets = written(marked.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "fp", "head", "sketch", "wide")]))  # copies once
    named = sets.groupBy("fp").agg(F.min("key").alias("first"))
    alike = sets.select("key", "fp").join(named, "fp").where("key <> first").select(F.col("first").alias("x"), F.col("key").alias("y"))
    ends = [named.select(F.col("fp").alias(k), F.col("first").alias(f"k{k}")) for k in "xy"]
    close = simhash.links(written(named.select("fp")), BUDGET).join(ends[0], "x").join(ends[1], "y").select(F.least("kx", "ky").alias("x"), F.greatest("kx", "ky").alias("y"))
    found = _verified(alike.unionByName(close).distinct(), sets, marked, texts)
    posts = sets.select("key", F.col("n").cast("int").alias("n"), F.explode("head").alias("h"))
    shared = posts.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    # Most shingles are in one set: only the lists of several are written.
    lists = _open(posts.join(shared, "h", "left_semi"), found)
    hubs = top_k(lists, ["h"], [F.xxhash64("key"), F.col("key")], HUBS + 1)
    other = lambda df: df.select("h", F.col("key").alias("k2"), F.col("n").alias("n2"), F.col("component").alias("c2"))
    found = found.unionByName(_verified(_met(lists, other(hubs.where(F.col("rank") <= HUBS))), sets, marked, texts))
    # Lists of more members: those beyond the hubs have not met one another.
    rest = written(lists.join(hubs.where(F.col("rank") > HUBS).select("h"), "h", "left_semi"))
    if not rest.isEmpty():
        rest = _open(rest.select("h", "key", "n"), found)
        found = found.unionByName(_verified(_met(rest, other(rest)), sets, marked, texts))
    return found


def marks(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, hash, key, n, fp, head, sketch, wide) per row, written, and (hash, text) of all
    rows. ``key`` stands for the set, ``hash`` for the text; null text: no words."""
    bound_batches(docs.sparkSession)
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    texts = plain.select("hash", "text")
    often = frequent(texts, docs.count())

    def run(column: pa.Array) -> list[pa.Array]:
        sets = [shingles(t) for t in column.cast(pa.binary()).to_pylist()]
        heads = [_head(s, often).view(np.int64) for s in sets]
        at = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
        flat = np.concatenate(heads) if heads else np.zeros(0, dtype=np.int64)
        key = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
        return [
            pa.array(key), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.int64()),
            pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int64())), pa.array([sketch(s) for s in sets], pa.binary()),
            pa.array([wide_sketch(s) for s in sets], pa.binary()),
        ]

    fields = [("key", "bigint"), ("n", "bigint"), ("fp", "bigint"), ("head", "array<bigint>"), ("sketch", "binary"), ("wide", "binary")]
    return written(appended(plain, "text", run, fields).drop("text")), texts


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest (doc_id,
    text hash). Documents without an id cannot be told apart and all stay."""
    marked, texts = marks(docs)
    labels = components(links(marked, texts), "x", "y").withColumnRenamed("node", "key")
    named = marked.where("doc_id IS NOT NULL").select("doc_id", "hash", "key").join(labels, "key", "left")
    group = F.coalesce("component", "key")
    best = named.groupBy(group.alias("group")).agg(F.min(F.struct("doc_id", "hash")).alias("one"))
    kept = written(best.select(F.col("one.doc_id").alias("doc_id"), F.col("one.hash").alias("hash")))
    turn = unused(docs, "hash")
    rows = docs.withColumn(turn, F.xxhash64(F.col("text").cast("string"))).join(kept.withColumnRenamed("hash", turn), ["doc_id", turn], "left_semi")
    again = rows.groupBy("doc_id", turn).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not again.isEmpty():
        rows = rows.dropDuplicates(["doc_id", turn])
    return rows.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
