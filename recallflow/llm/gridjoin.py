"""Cosine near-duplicates of embeddings by an epsilon grid order join.

Unit vectors are turned onto their leading principal directions and sorted by the grid cells
(side epsilon) there. The sorted sequence is cut into blocks with bounding boxes. Intervals
of blocks are joined from the whole sequence downwards, sixteen parts at a time: boxes
further apart than epsilon cannot hold a link, so the pair is left out. Pairs of blocks that
remain are joined in a task by the same recursion down to small dot products.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallflow.llm.common import bound_batches
from recallflow.llm.components import components, forest
from recallflow.operators.scans import numbered
from recallflow.session import cut

LEADING = 8  # principal directions that boxes and cells use
SORTED = 3  # of them, how many order the sequence
FAN = 4  # bits: intervals split in sixteen
LEAF = 64


def _marked(vectors: DataFrame) -> DataFrame:
    """(vec_id, grp, key, vector): key is null for vectors that link with nothing."""
    typed = vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, keys, data = [], [], []
            for label, values in zip(batch.column("label").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                good = label is not None and values is not None and None not in values
                x = np.array(values if good else [], dtype=np.float64) + 0.0  # no negative zero
                good = good and len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
                group = f"{len(x)}|{label}"
                groups.append(group if good else None)
                keys.append(hashlib.md5(group.encode() + x.tobytes()).digest() if good else None)
                data.append(x.tobytes() if good else None)
            yield pa.record_batch([batch.column("vec_id"), pa.array(groups, pa.string()), pa.array(keys, pa.binary()), pa.array(data, pa.binary())], ["vec_id", "grp", "key", "vector"])

    schema = T.StructType([vectors.schema["vec_id"], *T._parse_datatype_string("grp string, key binary, vector binary").fields])
    return typed.mapInArrow(run, schema)


def _unit(data: list[bytes], width: int = 0) -> np.ndarray:
    """Rows of length one, padded with zeros to ``width``; huge and tiny values are scaled first."""
    rows = [np.frombuffer(d, dtype=np.float64) for d in data]
    width = max([width, *map(len, rows)])
    x = np.stack([np.pad(r, (0, width - len(r))) for r in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _directions(units: DataFrame) -> np.ndarray:
    """Leading principal directions as columns. Sums of products are combined map-side; any
    orthonormal columns would give the same links."""
    width = (units.agg(F.max(F.octet_length("vector"))).first()[0] or 8) // 8

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width + width + 1)
        for batch in batches:
            if batch.num_rows:
                x = _unit(batch.column("vector").to_pylist(), width)
                total += np.concatenate([(x.T @ x).ravel(), x.sum(axis=0), [len(x)]])
        if total[-1]:
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int64)), pa.array(total)], ["i", "v"])

    sums = units.select("vector").mapInArrow(moments, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(width * width + width + 1)
    for i, v in sums:
        total[i] = v
    n = max(total[-1], 1.0)
    mean = total[-1 - width : -1] / n
    cov = total[: width * width].reshape(width, width) / n - np.outer(mean, mean)
    return np.linalg.eigh(cov)[1][:, ::-1][:, : min(LEADING, width)]


def _blocks(units: DataFrame, axes: np.ndarray, eps: float, block_rows: int) -> DataFrame:
    """Blocks of the sequence: one group, up to ``block_rows`` vectors, a bounding box.

    A vector's number is its block's number times 2^20 plus its place.
    """
    width, k = axes.shape

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _unit(batch.column("vector").to_pylist(), width) @ axes if batch.num_rows else np.zeros((0, k))
            c = np.floor(y / eps).astype(np.int32)
            extra = [pa.array(c[:, i] if i < k else np.zeros(len(c), dtype=np.int32)) for i in range(SORTED)]
            yield pa.record_batch([*batch.columns, *extra], [*batch.schema.names, *[f"c{i}" for i in range(SORTED)]])

    order = ["grp", *[f"c{i}" for i in range(SORTED)], "key"]
    kinds = ", ".join(f"c{i} int" for i in range(SORTED))
    ordered = units.select("grp", "key", "vector", "copies").mapInArrow(cells, f"grp string, key binary, vector binary, copies bigint, {kinds}")
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            nonlocal number
            data = [h[2] for h in held]
            y = _unit(data, width) @ axes
            row = {
                "block": number, "grp": held[0][0], "keys": b"".join(h[1] for h in held), "vectors": b"".join(data),
                "copies": np.array([h[3] for h in held], dtype=np.int64).tobytes(),
                **{f"lo{i}": float(y[:, i].min()) for i in range(k)}, **{f"hi{i}": float(y[:, i].max()) for i in range(k)},
            }
            number += 1
            held.clear()
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("grp", "key", "vector", "copies")], strict=True):
                if held and (held[0][0] != row[0] or len(held) >= block_rows):
                    yield block()
                held.append(row)
        if held:
            yield block()

    boxes = ", ".join([f"lo{i} double" for i in range(k)] + [f"hi{i} double" for i in range(k)])
    return cut(ordered.mapInArrow(pack, f"block bigint, grp string, keys binary, vectors binary, copies binary, {boxes}"))


def _near(a: str, b: str, k: int, eps: float) -> Column:
    """Whether two boxes (columns with prefixes ``a`` and ``b``) may hold a link."""
    gap = sum(
        (F.pow(F.greatest(F.lit(0.0), F.col(f"{a}lo{i}") - F.col(f"{b}hi{i}"), F.col(f"{b}lo{i}") - F.col(f"{a}hi{i}")), F.lit(2.0)) for i in range(k)),
        F.lit(0.0),
    )
    return gap <= (eps + 1e-9) ** 2


def _block_pairs(blocks: DataFrame, k: int, eps: float) -> DataFrame:
    """Pairs (a, b) of blocks, a before b or equal, whose boxes are near."""
    sides = [f"lo{i}" for i in range(k)] + [f"hi{i}" for i in range(k)]
    ranked = cut(numbered(blocks.select("block", "grp", *sides), ["grp"], ["block"], F.shiftright("block", 24), "rank").withColumn("rank", F.col("rank") - 1))
    longest = ranked.agg(F.max("rank")).first()[0]
    level = 0 if not longest else -(-int(longest).bit_length() // FAN)

    def nodes(at: int, prefix: str) -> DataFrame:
        here = F.shiftright("rank", FAN * at)
        boxes = ranked.groupBy("grp", here.alias("node")).agg(*[(F.min if c[0] == "l" else F.max)(c).alias(c) for c in sides])
        return boxes.select(
            F.col("grp").alias(f"{prefix}grp"), F.shiftright("node", FAN).alias(f"{prefix}up"), F.col("node").alias(f"{prefix}node"),
            *[F.col(c).alias(f"{prefix}{c}") for c in sides],
        )

    pairs = ranked.select("grp").distinct().select("grp", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for at in range(level - 1, -1, -1):
        pairs = cut(
            pairs.join(nodes(at, "a_"), (F.col("grp") == F.col("a_grp")) & (F.col("a") == F.col("a_up")))
            .join(nodes(at, "b_"), (F.col("grp") == F.col("b_grp")) & (F.col("b") == F.col("b_up")))
            .where((F.col("a_node") <= F.col("b_node")) & _near("a_", "b_", k, eps))
            .select("grp", F.col("a_node").alias("a"), F.col("b_node").alias("b"))
        )
    first = ranked.select("grp", F.col("rank").alias("a"), F.col("block").alias("block_a"))
    second = ranked.select("grp", F.col("rank").alias("b"), F.col("block").alias("block_b"))
    return pairs.join(first, ["grp", "a"]).join(second, ["grp", "b"]).select("block_a", "block_b")


def join_blocks(x: np.ndarray, y: np.ndarray, axes: np.ndarray, eps: float, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of rows of two sequences with a cosine of at least ``least``."""
    px, py = x @ axes, y @ axes
    found_i, found_j = [], []
    stack = [(0, len(x), 0, len(y))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if same and a0 > b0:
            continue
        p, q = px[a0:a1], py[b0:b1]
        gap = np.maximum(0, np.maximum(p.min(axis=0) - q.max(axis=0), q.min(axis=0) - p.max(axis=0)))
        if gap @ gap > (eps + 1e-9) ** 2:
            continue
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            i, j = np.nonzero(x[a0:a1] @ y[b0:b1].T >= least)
            i, j = i + a0, j + b0
            if same:
                i, j = i[i < j], j[i < j]
            found_i.append(i)
            found_j.append(j)
            continue
        am = [(a0, a1)] if a1 - a0 <= LEAF else [(a0, a0 + _half(a1 - a0)), (a0 + _half(a1 - a0), a1)]
        bm = [(b0, b1)] if b1 - b0 <= LEAF else [(b0, b0 + _half(b1 - b0)), (b0 + _half(b1 - b0), b1)]
        stack += [(*s, *t) for s in am for t in bm]
    if not found_i:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def _half(n: int) -> int:
    """A split of both sequences at the same multiples, so that equal halves stay aligned."""
    return LEAF << max(0, (-(-n // LEAF) - 1).bit_length() - 1)


def _linked(blocks: DataFrame, pairs: DataFrame, axes: np.ndarray, eps: float, least: float) -> DataFrame:
    """(vec, links, root): per pair of blocks, how many vectors each links with, copies
    counted, and the root of its tree in the pair's spanning forest (null for a root)."""
    width = axes.shape[0]
    a = blocks.select(F.col("block").alias("block_a"), F.col("vectors").alias("va"), F.col("copies").alias("na"), F.length("keys").alias("ka"))
    b = blocks.select(F.col("block").alias("block_b"), F.col("vectors").alias("vb"), F.col("copies").alias("nb"), F.length("keys").alias("kb"))
    both = pairs.join(a, "block_a").join(b, "block_b")

    def rows(data: bytes, keys: int) -> np.ndarray:
        n = keys // 16
        return _unit([r.tobytes() for r in np.frombuffer(data, dtype=np.float64).reshape(n, -1)], width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros((0, 3), dtype=np.int64)]
            for r in batch.to_pylist():
                same = r["block_a"] == r["block_b"]
                x = rows(r["va"], r["ka"])
                y = x if same else rows(r["vb"], r["kb"])
                i, j = join_blocks(x, y, axes, eps, least, same)
                if not len(i):
                    continue
                na, nb = np.frombuffer(r["na"], dtype=np.int64), np.frombuffer(r["nb"], dtype=np.int64)
                here, there = (r["block_a"] << 20) + np.arange(len(x)), (r["block_b"] << 20) + np.arange(len(y))
                if same:
                    ids, size = here, na
                else:
                    ids, size, j = np.concatenate([here, there]), np.concatenate([na, nb]), j + len(x)
                links = np.bincount(i, weights=size[j], minlength=len(ids)) + np.bincount(j, weights=size[i], minlength=len(ids))
                root = ids[forest(i, j, len(ids))]
                hit = links > 0
                out.append(np.stack([ids[hit], links[hit].astype(np.int64), root[hit]], axis=1))
            rows_ = np.concatenate(out)
            yield pa.record_batch([pa.array(rows_[:, c]) for c in range(3)], ["vec", "links", "root"])

    return both.mapInArrow(run, "vec bigint, links bigint, root bigint")


def groups(vectors: DataFrame, least: float = 0.93, block_rows: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    Vectors of equal, non-null label and equal length link at a cosine of at least
    ``least``. Null or zero vectors and those with a null or non-finite component, or
    without a label, link with nothing and stay. Equal vectors are joined once and counted
    as often as they occur; repeated ids count as vectors of their own. A null vec_id is
    larger than any other.
    """
    bound_batches(vectors.sparkSession)
    eps = math.sqrt(2 - 2 * least)
    marked = cut(_marked(vectors))
    units = cut(
        marked.where("key IS NOT NULL").groupBy("grp", "key")
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
    )
    axes = _directions(units)
    blocks = _blocks(units, axes, eps, block_rows)
    linked = cut(_linked(blocks, _block_pairs(blocks, axes.shape[1], eps), axes, eps, least))
    labels = components(linked.where("vec <> root"), "vec", "root")
    counts = linked.groupBy("vec").agg(F.sum("links").alias("links"))
    sixteen = F.expr("transform(sequence(0, cast(length(keys) / 16 as int) - 1), i -> substring(keys, i * 16 + 1, 16))")
    numbers = blocks.select("block", F.posexplode(sixteen).alias("place", "key")).select(
        (F.shiftleft("block", 20) + F.col("place")).alias("vec"), "key"
    )
    named = cut(
        numbers.join(units.select("key", "first", "copies"), "key").join(counts, "vec", "left")
        .join(labels.withColumnRenamed("node", "vec"), "vec", "left")
        .select("key", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "vec").alias("component"))
    )
    least_id = cut(named.groupBy("component").agg(F.min("first").alias("component_id")))
    classes = cut(named.join(least_id, "component").select("key", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"))
    found = marked.select("vec_id", "key").join(classes, "key", "left")
    alone = F.col("key").isNull()
    return found.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.lit(True)).otherwise(F.col("vec_id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )
