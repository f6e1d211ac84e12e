import random

import numpy as np
import pytest

import corpus_pipeline
from recallflow.llm import near


def _grams(text, width=5):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def _kept(rows):
    """Smallest id of each class under Jaccard 0.8, all pairs compared."""
    sets = {i: _grams(t) for i, t in rows}
    label = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return sorted({*label.values()})


def _edited():
    """Texts of 20 to 300 words, copies with 1 to 12 changed words, chains of copies, and a
    passage that half of the texts share."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(30)]
    rows = []
    for _ in range(40):
        text = [word() for _ in range(rng.choice([20, 60, 150, 300]))]
        if rng.random() < 0.5:
            text[10:10] = passage
        rows.append(text)
        for _ in range(rng.randrange(5)):
            text = list(text if rng.random() < 0.5 else rows[-1])
            for _ in range(rng.choice([1, 3, 6, 12])):
                text[rng.randrange(len(text))] = word()
            rows.append(text)
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, " ".join(t)) for i, t in zip(order, rows, strict=True)]


def test_pipeline_stage_drops_edited_copies(spark, sf):
    rows = _edited()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'xx' AS lang", "'a' AS source", "length(text) AS n_chars")
    want = _kept(rows)
    assert 40 <= len(want) < len(rows) - 20
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, sf).collect()) == want


def test_sample_data_equals_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(r.doc_id for r in near.deduplicated(df).collect()) == _kept(rows)


@pytest.mark.parametrize("hubs", [0, 3])
def test_lists_are_settled_with_and_without_hubs(spark, monkeypatch, hubs):
    monkeypatch.setattr(near, "HUBS", hubs)
    rows = _edited()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near.deduplicated(df).collect()) == _kept(rows)


def test_order_of_frequent_shingles_moves_no_result():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, 80, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.permutation(80)[: rng.integers(60, 80)]], rng.integers(0, 1 << 63, rng.integers(0, 12), dtype=np.uint64)]))
        often = np.sort(rng.permutation(np.union1d(a, b))[:40])
        if near.similar(a, b):
            assert len(np.intersect1d(near._head(a, often), near._head(b, often)))


def test_odd_rows(odd, none):
    kept = near.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "6", "None"]
    assert near.deduplicated(none).collect() == []


def test_one_id_with_two_texts_keeps_both(spark):
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (1, "u v w x y z"), (2, "u v w x y z"), (3, "A b c d e f")]
    found = near.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in found) == [(1, "a b c d e f"), (1, "u v w x y z")]


def test_wide_sketches_tell_long_texts_apart():
    rnd = np.random.default_rng(8)
    draw = lambda n: np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
    excluded = lambda a, b: near._differ(near.wide_sketch(a), near.wide_sketch(b)) * 9 > len(a) + len(b)
    for n in (2100, 4096, 5000, 15000, 40000):
        base = draw(n)
        half = np.union1d(base[: n // 2], draw(n // 2))
        assert excluded(base, draw(n)) and excluded(base, half)
        # The usual sketch is full at that length: it lets the unlike pair through.
        full = np.bitwise_count(np.frombuffer(near.sketch(base), np.uint8) ^ np.frombuffer(near.sketch(half), np.uint8)).sum() * 9 <= len(base) + len(half)
        assert full or n <= 5000
        for share in (0.8, 0.85, 0.99, 1.0):
            # One set within the other, as far apart in size as is allowed, crosses powers of two.
            inner = base[: int(np.ceil(n * share))]
            if len(inner) > 2048:
                assert near.similar(base, inner) and not excluded(base, inner)
    assert near.wide_sketch(base[:2048]) is None and len(near.wide_sketch(base[:2049])) == 512
