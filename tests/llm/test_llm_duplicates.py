import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from recallflow.llm import gridjoin, lines, simhash
from recallflow.llm.components import components, forest


def _simple_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _classes(ids, pairs):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def test_fingerprint_is_spark_and_library_hash(spark):
    texts = ["", "one", "One  two\tTHREE\nfour É é", "a b c " * 200, None]
    for t in texts:
        assert simhash.fingerprint(None if t is None else t.encode()) & (1 << 64) - 1 == _simple_fingerprint(t)
    h = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert h & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("same", [True, False])
def test_trie_walk_finds_every_pair(same):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = base[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (40, 8)).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, (40, 8)).astype(np.uint64))
    a = np.unique(np.concatenate([base, near.ravel()]))
    b = a if same else np.unique(near.ravel() ^ np.uint64(1))
    i, j = simhash.walk(a, b, 0, 0, 2, same)
    want = np.bitwise_count(a[:, None] ^ b[None, :]) <= 2
    if same:
        want = np.triu(want, 1)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(zip(*[x.tolist() for x in np.nonzero(want)], strict=True))


def test_crowded_prefix_is_split_and_keeps_all_links(spark):
    values = [k ^ (k << 3) for k in range(300)] + [(1 << 63) - 1 - (k << 7) for k in range(60)] + [-5, -6, -(1 << 60)]
    fps = spark.createDataFrame([(v,) for v in sorted(set(values))], "fp long")
    found = {r.node: r.component for r in components(simhash.links(fps, 2, node_rows=16), "x", "y").collect()}
    vs = np.array(sorted(set(values)), dtype=np.int64)
    u = vs.view(np.uint64)
    i, j = np.nonzero(np.bitwise_count(u[:, None] ^ u) <= 2)
    root = forest(i, j, len(vs))
    assert all(found.get(int(v), int(v)) == int(vs[r]) for v, r in zip(vs, root, strict=True))


def test_simhash_groups_odd_rows(odd, odd_rows, none):
    rows = simhash.groups(odd).collect()
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1) for r in rows) == sorted((str(i), _simple_fingerprint(t)) for i, t, _ in odd_rows)
    assert {r.doc_id: r.component_id for r in rows if r.doc_id} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}
    assert simhash.groups(none).collect() == []


def test_groups_of_the_sample_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    fp = {r.doc_id: _simple_fingerprint(r.text) for r in docs.collect()}
    ids, u = np.array(sorted(fp)), np.array([fp[i] for i in sorted(fp)], dtype=np.uint64)
    i, j = np.nonzero(np.bitwise_count(u[:, None] ^ u) <= 2)
    want = {int(ids[k]): int(ids[r]) for k, r in enumerate(forest(i, j, len(u)))}
    rows = simhash.groups(docs).collect()
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in rows} == fp and {r.doc_id: r.component_id for r in rows} == want


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(50)] + [(1000, 1000 + k) for k in range(1, 40)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert {found[k] for k in range(51)} == {0} and {found[1000 + k] for k in range(40)} == {1000}


def _drop_lines(rows, min_docs, min_chars=1):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if seen.get(key(x), 0) < min_docs]
        out.append((str(i), len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def _lines(df, **k):
    found = lines.deduplicated(df, **k).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("h"))
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.h) for r in found.collect())


@pytest.mark.parametrize("here", [1 << 26, -1])
def test_line_dedup_both_ways(spark, here):
    rows = [(k, f"Shared LINE \n\nown {k}\n  shared line{' É' if k % 2 else ''}\nx{k % 3}\r") for k in range(12)] + [(99, None), (98, ""), (97, "\n")]
    df = spark.createDataFrame([*rows, (None, "shared line\nz")], "doc_id long, text string")
    for k in ({"min_docs": 4}, {"min_docs": 4, "min_chars": 3}):
        assert _lines(df, here_bytes=here, shard_keys=2, **k) == _drop_lines([*rows, (None, "shared line\nz")], **k)


@pytest.mark.parametrize("here", [1 << 26, -1])
def test_line_dedup_odd_rows(odd, odd_rows, none, here):
    assert _lines(odd, min_docs=3, here_bytes=here) == _drop_lines([(i, t) for i, t, _ in odd_rows], 3)
    assert lines.deduplicated(none, here_bytes=here).collect() == []


def test_perfect_hash_is_minimal_and_knows_strangers():
    rng = np.random.default_rng(5)
    h, f = rng.integers(0, 1 << 63, 5000, dtype=np.uint64), rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    index = lines.Index.load(lines.Index.build(h, f, np.arange(5000) + 1).dump())
    assert sorted(index.find(h, f).tolist()) == list(range(5000))
    assert (index.count(h, f) == np.arange(5000) + 1).all()
    assert not index.count(f, h).any()


def _cosine(rows, least):
    out, pairs = {k: 0 for k in range(len(rows))}, []
    def good(r):
        return r[1] is not None and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1]) and r[2] is not None and len(r[1])
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a], rows[b]
            if good(x) and good(y) and x[2] == y[2] and len(x[1]) == len(y[1]):
                u, v = np.array(x[1]), np.array(y[1])
                if u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= least:
                    out[a] += 1
                    out[b] += 1
                    pairs.append((a, b))
    label = _classes(range(len(rows)), pairs)
    least_id = {}
    for k, r in enumerate(rows):
        least_id[label[k]] = min(least_id.get(label[k], 1 << 60), r[0])
    return sorted((r[0], out[k], least_id[label[k]], r[0] == least_id[label[k]]) for k, r in enumerate(rows))


def test_grid_join_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 16))
    rows = []
    for k in range(400):
        x = centre[k % 12] + rng.normal(size=16) * rng.choice([0.02, 0.25, 0.6])
        rows.append((k, [float(v) for v in x], None if k % 50 == 7 else k % 3))
    rows += [(400 + k, rows[5][1], rows[5][2]) for k in range(30)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None] * 16, 1), (504, [1.0, 2.0], 1), (505, [2.0, 4.0], 1), (506, [], 1), (507, [1e200] * 16, 1), (508, [1e-200] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit("clash"))
    found = sorted(tuple(r) for r in gridjoin.groups(df, 0.93, block_rows=16).collect())
    want = _cosine([r if r[0] not in (507, 508) else (r[0], [1.0] * 16, 1) for r in rows], 0.93)
    assert found == want
    assert gridjoin.groups(df.where("vec_id < 0")).collect() == []
