import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from recallflow.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def pair():
    with open(A, encoding="utf-8") as f, open(B, "rb") as g:
        return alignment.Pair(f.read(), g.read())


def _plain(pair, libraries, text):
    """Ids, links and groups by walking the bytes."""
    a, b = libraries[0].encode(" " + (text or ""), add_special_tokens=False).ids, libraries[1].encode(text or "")
    want = (" " + (text or "")).encode()
    if not text or any(b"".join(n[i] for i in ids) != want for ids, n in ((a, pair.a_bytes), (b, pair.b_bytes))):
        return [], [], [], []
    own = [[k for k, i in enumerate(ids) for _ in n[i]] for ids, n in ((a, pair.a_bytes), (b, pair.b_bytes))]
    links = list(dict.fromkeys(zip(*own, strict=True)))
    groups, x, y = [], [], []
    for k in range(len(want)):
        x, y = [*x, own[0][k]], [*y, own[1][k]]
        if k + 1 == len(want) or (own[0][k] != own[0][k + 1] and own[1][k] != own[1][k + 1]):
            groups.append(",".join(str(a[i]) for i in dict.fromkeys(x)) + "|" + ",".join(str(b[i]) for i in dict.fromkeys(y)))
            x, y = [], []
    return a, b, links, groups


def _expected(pair, libraries, docs):
    each = [(i, *_plain(pair, libraries, t)) for i, t in docs]
    count = Counter((a[x], b[y]) for _, a, b, links, _ in each for x, y in links)
    top = Counter()
    for (_, q), n in count.items():
        top[q] = max(top[q], n)
    out = []
    for i, a, b, links, groups in each:
        n = [count[a[x], b[y]] for x, y in links]
        best = sum(m == top[b[y]] for m, (_, y) in zip(n, links, strict=True))
        out.append((i, len(a), len(b), len(groups), len(links), best, sum(n), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    return out


def test_query_equals_brute_force(spark, sf, pair, libraries):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.QUERIES["op12_token_alignment"](spark, sf)
    assert sorted(tuple(r) for r in found.collect()) == sorted(_expected(pair, libraries, docs))


def test_ids_equal_the_libraries(pair, libraries):
    rng = random.Random(8)
    letters = "abcXYZ  \n\t\r\x0b\x1c\x85\xa0'stdlm0123ßéÅØÀ̈́ΣσςЖжԯ.,;!?<|endoftext|>▁_中文字日​\U0001f600\x00\x7f"
    texts = ["<|endoftext|> in text", " two  spaces ", "▁", "a" * 500, "don't WE'LL 've", "<s> </s> <unk> <0x41>", "\x00"]
    assert pair.parted
    texts += ["".join(rng.choices(letters + "\u3000\u2009\u180e ", k=rng.randint(1, 30))) for _ in range(20_000)]
    for t in texts:
        a, b = libraries[0].encode(" " + t, add_special_tokens=False).ids, libraries[1].encode(t)
        same = all(b"".join(n[i] for i in ids) == (" " + t).encode() for ids, n in ((a, pair.a_bytes), (b, pair.b_bytes)))
        own = pair.encode(pair.stretches(t))
        if same:
            assert (own[0].tolist(), own[2].tolist()) == (a, b)
        else:
            assert (np.diff(own[1]) == 0).any() and ((np.diff(own[1]) == 0) == (np.diff(own[3]) == 0)).all()


@pytest.mark.parametrize("steps", [1, 2, 3, 7, 256])
def test_pieces_of_any_length_give_the_same_overlaps(steps):
    rng = np.random.default_rng(steps)
    for _ in range(60):
        end = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.integers(1, end + 1, size=rng.integers(0, end + 1)), end)) for _ in "ab")
        found = alignment.overlaps(a, b, steps)
        own = [np.searchsorted(e, np.arange(1, end + 1)) for e in (a, b)]
        assert list(zip(found.a, found.b, strict=True)) == list(dict.fromkeys(zip(*own, strict=True)))
        assert found.closes.sum() == len(np.intersect1d(a, b)) and (a[found.a[found.closes]] == b[found.b[found.closes]]).all()


def test_odd_rows_in_one_pass_and_in_many(spark, odd, none, pair, libraries):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    want = sorted(_expected(pair, libraries, docs), key=repr)
    clash = odd.selectExpr("*", "'x' AS n_a", "'x' AS row", "'x' AS at", "'x' AS groups")
    for size in (alignment.SLICE, 20):
        rows = alignment.aligned(clash, A, B, slice_pairs=size).collect()
        got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") for r in rows]
        assert sorted(got, key=repr) == want and {r.row for r in rows} == {"x"}
    assert alignment.aligned(none, A, B).collect() == []


def test_forgetting_changes_nothing(spark, sf, pair, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(40).collect()]
    once = alignment.Aligned(pair, alignment.Encoder(pair).batch(texts)).groups()
    monkeypatch.setattr(alignment, "HELD", 3)
    encoder = alignment.Encoder(pair)
    assert once == [g for t in texts for g in alignment.Aligned(pair, encoder.batch([t])).groups()]
