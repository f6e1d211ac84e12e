import random
import zlib
from collections import defaultdict

from recallflow.llm import queries, sharding


def _checked(rows, shards, tolerance, longest):
    """Shares, gapless slots, and how many texts lie in several shards."""
    size, slots, texts = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        texts[r.text_crc32].add(r.shard)
    assert set(size) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    each, ends = sum(size.values()) / shards, 0
    for k in range(shards):
        ends += size[k]
        assert abs(ends - each * (k + 1)) <= max(each * tolerance, longest / 2) + 1e-6
    return texts


def test_query_keeps_every_row(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op11_histogram_shards"](spark, sf).collect()
    assert len(rows) == len(docs) and {r.doc_id for r in rows} == set(docs)
    for r in rows:
        text = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 8, zlib.crc32(text), "bytes", None)
    _checked(rows, 24, 0.002, max(r.size for r in rows))


def test_blocks_of_a_shard_give_the_same_shares(spark):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choices("abc ", k=rng.randint(0, 60)))) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for block in (1 << 30, 2000):
        found = sharding.sharded(df, shards=7, tolerance=0.01, block_bytes=block).collect()
        assert {(r.doc_id, r.text) for r in found} == set(rows) and len(found) == 4000
        _checked(found, 7, 0.01, 0)


def test_hot_text_is_cut_between_rows_and_others_stay_whole(spark):
    rows = [(k, "hot text " * 9) for k in range(900)] + [(1000 + k, f"pair {k // 2} " * 5) for k in range(1200)]
    found = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), shards=8, tolerance=0.05).collect()
    texts = _checked(found, 8, 0.05, 0)
    cut = [k for k, v in texts.items() if len(v) > 1]
    assert cut == [zlib.crc32(("hot text " * 9).encode())]
    shards = sorted(texts[cut[0]])
    assert shards == list(range(shards[0], shards[-1] + 1))


def test_repeated_rows_are_dealt_too(spark):
    df = spark.createDataFrame([(7, "same")] * 1000, "doc_id long, text string")
    found = sharding.sharded(df, shards=10, tolerance=0.0).collect()
    _checked(found, 10, 0.0, 0)
    assert len(found) == 1000 and {sum(r.shard == k for r in found) for k in range(10)} == {100}


def test_candidates_always_part(spark):
    for least, greatest in ((5, 6), (5, 5 + (1 << 130)), ((1 << 128) - 1, 1 << 128), (0, (1 << 192) - 1)):
        for count in (1, 2, 50):
            found = sharding.Interval(0, 0, 9, 2, least, greatest).candidates(count)
            assert 0 < len(found) <= count and all(least < k <= greatest for k in found)


def test_odd_rows(odd, none):
    found = sharding.sharded(odd, shards=3).collect()
    assert len(found) == odd.count() and {r.score for r in found} == {"x"}
    assert {r.size for r in found if r.doc_id in (1, 2)} == {8}
    _checked(found, 3, 0.0, max(r.size for r in found))
    clash = odd.selectExpr("*", "'x' AS size", "'x' AS shard", "'x' AS row", "'x' AS place", "'x' AS k1")
    again = sharding.sharded(clash, shards=3)
    assert set(again.columns) == {*odd.columns, "row", "place", "k1", *sharding.COLUMNS} and len(again.collect()) == len(found)
    assert sharding.sharded(none).collect() == [] and sharding.sharded(none).columns == [*none.columns, *sharding.COLUMNS]
