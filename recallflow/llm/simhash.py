"""SimHash near-duplicates by a binary trie joined with itself.

Distinct fingerprints form a binary trie. Node pairs are walked down together: a pair
carries the bits in which its two prefixes differ and is dropped once they exceed the
budget. The first bits are taken in one step, chosen so that a node holds about
``node_rows`` fingerprints; pairs of larger nodes (one crowded prefix) go down further as a
join of node tables until they fit; then a task walks its pair of subtries to the leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallflow.llm.common import appended, bound_batches
from recallflow.llm.components import components, forest
from recallflow.session import cut

BITS = 64
STEP = 4


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """64-bit majority fingerprint of the word shingles, as a signed number."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) < width:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*[words[k:] for k in range(width)], strict=False)))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(grams), 1 << 15):
        part = grams[at : at + (1 << 15)]
        h = np.fromiter([digest(g, seed) for g in part], dtype="<u8", count=len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(grams)).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of the whole text; null text: that of no words, zero."""
    bound_batches(docs.sparkSession)

    def run(column: pa.Array) -> list[pa.Array]:
        texts = column.cast(pa.binary()).to_pylist()
        return [pa.array([fingerprint(t, width) for t in texts], pa.int64())]

    return appended(docs, "text", run, [(name, "bigint")])


def walk(a: np.ndarray, b: np.ndarray, depth: int, spent: int, budget: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with a[i] and b[j] at most ``budget`` bits apart.

    ``a`` and ``b`` are sorted, each with one common prefix of ``depth`` bits; the prefixes
    differ in ``spent`` bits. ``same``: both are one node, and each pair is given once.
    """
    node = np.array([[0, len(a), 0, len(b), spent]], dtype=np.int64)
    node = node[(node[:, 1] > 0) & (node[:, 3] > 0)]
    left, right = [], []
    while len(node):
        few = (node[:, 1] - node[:, 0]) * (node[:, 3] - node[:, 2]) <= 64
        if depth == BITS:
            few[:] = True
        if few.any():
            alo, ahi, blo, bhi, _ = node[few].T
            size = (ahi - alo) * (bhi - blo)
            which = np.repeat(np.arange(len(size)), size)
            rank = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            i, j = alo[which] + rank // (bhi - blo)[which], blo[which] + rank % (bhi - blo)[which]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            left.append(i[near])
            right.append(j[near])
            node = node[~few]
            if not len(node):
                break
        bit = np.uint64(1 << (BITS - 1 - depth))
        below = np.uint64((1 << (BITS - 1 - depth)) - 1)
        alo, ahi, blo, bhi, used = node.T
        am = np.searchsorted(a, (a[alo] & ~(bit | below)) | bit)
        bm = np.searchsorted(b, (b[blo] & ~(bit | below)) | bit)
        kids = [
            np.stack([alo, am, blo, bm, used], axis=1), np.stack([am, ahi, bm, bhi, used], axis=1),
            np.stack([alo, am, bm, bhi, used + 1], axis=1),
        ]
        cross = np.stack([am, ahi, blo, bm, used + 1], axis=1)
        kids.append(cross[alo != blo] if same else cross)  # a node against itself: once
        node = np.concatenate(kids)
        node = node[(node[:, 1] > node[:, 0]) & (node[:, 3] > node[:, 2]) & (node[:, 4] <= budget)]
        depth += 1
    if not left:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(left), np.concatenate(right)


def _prefix(fp: Column, depth: int) -> Column:
    return F.shiftrightunsigned(fp, BITS - depth) if depth else F.lit(0).cast("long")


def _node_pairs(fps: DataFrame, budget: int, node_rows: int) -> tuple[DataFrame | None, list[int]]:
    """Pairs (depth, a, b, spent) of trie nodes small enough for one task, a <= b."""
    total = fps.count()
    depth = min(BITS - STEP, max(0, (max(total, 1) // node_rows).bit_length()))
    masks = [sum(1 << k for k in c) for r in range(min(budget, depth) + 1) for c in combinations(range(depth), r)]
    nodes = cut(fps.groupBy(_prefix(F.col("fp"), depth).alias("p")).agg(F.count(F.lit(1)).alias("n")))
    other = nodes.select(F.col("p").alias("b"), F.col("n").alias("nb"))
    pairs = (
        nodes.select(F.col("p").alias("a"), F.col("n").alias("na"), F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("m"))
        .select("a", "na", F.col("a").bitwiseXOR(F.col("m")).alias("b"), F.bit_count("m").alias("spent"))
        .where("a <= b").join(other, "b")
    )
    done, depths = None, []
    while True:
        pairs = cut(pairs)
        large = F.col("na") + F.col("nb") > 4 * node_rows
        if depth >= BITS:
            large = F.lit(False)
        fits = pairs.where(~large).select(F.lit(depth).alias("depth"), "a", "b", "spent")
        done = fits if done is None else done.unionByName(fits)
        depths.append(depth)
        if pairs.where(large).isEmpty():
            return done, depths
        deep = min(BITS, depth + STEP)
        kids = cut(fps.groupBy(_prefix(F.col("fp"), deep).alias("k")).agg(F.count(F.lit(1)).alias("n")))
        up = F.shiftrightunsigned("k", deep - depth)
        ka = kids.select(up.alias("a"), F.col("k").alias("ka"), F.col("n").alias("nka"))
        kb = kids.select(up.alias("b"), F.col("k").alias("kb"), F.col("n").alias("nkb"))
        spent = F.col("spent") + F.bit_count(
            F.col("ka").bitwiseXOR(F.col("kb")).bitwiseAND(F.lit((1 << (deep - depth)) - 1).cast("long"))
        )
        pairs = (
            pairs.where(large).select("a", "b", "spent").join(ka, "a").join(kb, "b")
            .where((spent <= budget) & ((F.col("a") != F.col("b")) | (F.col("ka") <= F.col("kb"))))
            .select(F.col("ka").alias("a"), F.col("nka").alias("na"), F.col("kb").alias("b"), spent.alias("spent"), F.col("nkb").alias("nb"))
        )
        depth = deep


def links(fps: DataFrame, budget: int = 2, node_rows: int = 1024) -> DataFrame:
    """(x, y) fingerprints of a forest with the components of "at most ``budget`` bits
    apart". ``fps`` has distinct ``fp``. No link between different fingerprints is lost to
    the components; within a task's pair of subtries only its spanning forest is given."""
    pairs, depths = _node_pairs(fps, budget, node_rows)
    at = F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(F.col("fp"), d).alias("p")) for d in depths])
    here = fps.select("fp", F.explode(at).alias("n")).select("fp", "n.depth", "n.p")
    ends = pairs.select(
        "depth", "a", "b", "spent",
        F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("p"),
    )
    rows = here.join(ends, ["depth", "p"]).select("fp", "depth", "p", "a", "b", "spent")

    def join(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(np.uint64)
        depth, a, b, spent = (group.column(c)[0].as_py() for c in ("depth", "a", "b", "spent"))
        first = group.column("p").to_numpy() == a
        x = np.sort(fp[first])
        if a == b:
            y, all_ = x, x
            i, j = walk(x, x, depth, 0, budget, True)
        else:
            y = np.sort(fp[~first])
            all_ = np.concatenate([x, y])
            i, j = walk(x, y, depth, spent, budget, False)
            j = j + len(x)
        if not len(i):
            return pa.table({"x": pa.array([], pa.int64()), "y": pa.array([], pa.int64())})
        root = forest(i, j, len(all_))
        moved = np.flatnonzero(root != np.arange(len(all_)))
        signed = all_.view(np.int64)
        return pa.table({"x": signed[moved], "y": signed[root[moved]]})

    return rows.groupBy("depth", "a", "b").applyInArrow(join, "x bigint, y bigint")


def groups(docs: DataFrame, budget: int = 2, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``budget`` bits. A
    null doc_id counts as larger than any other. Equal texts share a fingerprint, so copies
    meet as one row of the trie.
    """
    marked = cut(fingerprints(docs.select("doc_id", F.col("text").cast("string").alias("text")), width).select("doc_id", "fp"))
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(links(fps.select("fp"), budget), "x", "y")
    named = cut(
        fps.join(labels, fps["fp"] == labels["node"], "left")
        .select("fp", "first", F.coalesce("component", "fp").alias("component"))
    )
    least = cut(named.groupBy("component").agg(F.min("first").alias("component_id")))
    classes = cut(named.join(least, "component").select("fp", "component_id"))
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")
