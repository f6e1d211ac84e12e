import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recallflow.llm import bpe, chat, digest, license
from recallflow.llm.bpe import Vocabulary
from recallflow.llm.merges import Lookup

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_bpe_equals_the_library():
    own, lib = Vocabulary(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)
    draw = random.Random(4)
    letters = "abcdefghinorstuABC'  \n\t.,!0129éÉñßΣς<|>😀́‍\xad\x85"
    texts = ["", "Hello WORLD's don't <|endoftext|>x<|startoftext|><|endoftext", "ΟΔΥΣΣΕΥΣ İ ſ Ⅷ ² 한국어", "a" * 3000, "ab" * 150, "\x00\x1c\x7f  "]
    texts += ["".join(draw.choice(letters) for _ in range(draw.randint(1, 60))) for _ in range(800)]
    texts += ["".join(chr(draw.choice([draw.randrange(1, 0x250), draw.randrange(0x250, 0x3000), draw.randrange(0x10000, 0x1FFFF)])) for _ in range(30)) for _ in range(400)]
    decomposed = ["Tiếng Việt là ngôn ngữ của người Việt", "ἐν ἀρχῇ ἦν ὁ λόγος", "ẗ ḧ ế Ǟ ά ΐ"]
    texts += [unicodedata.normalize(form, t) for t in decomposed for form in ("NFC", "NFD")]
    marks = "aeiouyAEOUtThwsΑαιυωΩ" + "".join(map(chr, [*range(0x300, 0x30D), 0x323, 0x327, 0x328, 0x331, 0x342, 0x345]))
    texts += ["".join(draw.choice(marks) for _ in range(draw.randint(1, 12))) for _ in range(20_000)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = lib.encode(text, add_special_tokens=False)
        assert ids.tolist() == want.ids, text
        assert " ".join(own.names[i] for i in ids) == lib.decode(want.ids, skip_special_tokens=False)


def test_bpe_proposals_fail_and_are_repaired():
    own, lib = Vocabulary(open(PATH, encoding="utf-8").read()), Tokenizer.from_file(PATH)
    draw = random.Random(6)
    words = ["the", "thaterndingha", "oferanlyor", "andanororre", "a" * 700, "a"]
    words += sorted({"".join(draw.choice("etaoinshrdluß") for _ in range(draw.randint(1, draw.choice([5, 12, 40, 140])))) for _ in range(3000)})
    flat, at = own.merges.spell([w.encode() for w in words])
    cut = lambda tokens, size: [x.tolist() for x in np.split(tokens, np.cumsum(size)[:-1])]
    proposed, exact = cut(*own.merges.propose(flat, at)), cut(*own.merges.exact(flat, at))
    want = [lib.encode(w, add_special_tokens=False).ids for w in words]
    assert exact == want and 0.1 < np.mean([p == w for p, w in zip(proposed, want, strict=True)]) < 0.9
    own.learn(words)
    assert [np.frombuffer(own.words[w], dtype=np.int32).tolist() for w in words] == want


def test_lookup_finds_every_key_and_no_other():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 40, size=5000))
    table = Lookup(keys, np.arange(len(keys), dtype=np.int32))
    assert (table(keys) == np.arange(len(keys))).all()
    assert (table(np.setdiff1d(np.concatenate([keys + 1, rng.integers(0, 1 << 40, size=5000)]), keys)) == -1).all()


def test_bpe_odd_rows(odd, none):
    lib = Tokenizer.from_file(PATH)
    for r in bpe.decoded(bpe.encoded(odd, PATH), PATH).collect():
        want = lib.encode(r.text or "", add_special_tokens=False)
        assert r.ids == want.ids and r.decoded == lib.decode(want.ids, skip_special_tokens=False)
    assert bpe.decoded(bpe.encoded(none, PATH), PATH).collect() == []


def _neighbours(rows):
    """Brute force over the whole list; ids are distinct."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        edit = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
        a, b, c = (digest.digest(x.encode()) for x in (t, edit, n))
        out[i] = (len(t), edit, a, b, digest.likeness(a, b), digest.likeness(a, c))
    return out


def test_digest_neighbours_over_many_ranges(spark):
    draw = random.Random(2)
    rows = [(k * 7, "".join(draw.choice("abcdé \n") for _ in range(draw.randint(0, 90)))) for k in range(200)] + [(None, "no id"), (-9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = _neighbours(rows)
    for size in (10, 1000):
        found = {r.doc_id: tuple(r)[1:] for r in digest.with_next(df, range_rows=size).collect()}
        assert found == want


def test_digest_odd_rows(odd, none, spark):
    rows = digest.with_next(odd).collect()
    assert len(rows) == odd.count()
    same = [r for r in rows if r.doc_id == 5]
    assert same[0].fingerprint == same[1].fingerprint and 1.0 in {r.near_next for r in same}
    assert digest.with_next(none).collect() == []
    one = digest.with_next(spark.createDataFrame([(1, "abcabc")], "doc_id long, text string")).first()
    assert one.edited == "abcaab" and one.near_next == 1.0


def test_likeness_falls_with_the_edit():
    draw = random.Random(1)
    text = " ".join("".join(draw.choice("etaoinshr") for _ in range(draw.randint(2, 9))) for _ in range(600))
    other = " ".join("".join(draw.choice("etaoinshr") for _ in range(draw.randint(2, 9))) for _ in range(600))
    d = [digest.digest((text[: len(text) - k] + other[:k]).encode()) for k in (0, 100, 1000, len(text))]
    near = [digest.likeness(d[0], x) for x in d]
    assert near[0] == 1.0 and near == sorted(near, reverse=True) and near[2] > near[3] + 0.1


def test_license_phrases_and_texts(spark, odd, odd_rows, none):
    mit = license.TEXTS["mit-text"]
    rows = [
        (1, "Under the MIT License, or the Apache-License. mit license"), (2, mit), (3, "intro words " + mit.replace("furnished", "newly furnished") + " end"),
        (4, "Licensed under CC BY-NC 4.0."), (5, mit[:120]), (6, "gnu general public"), (7, "GNU GENERAL PUBLIC LICENSE GNU general public license"),
    ]
    found = {r.doc_id: r for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[1].n_base, found[1].first_word, found[1].last_word, found[1].base_labels) == (3, 2, 8, "apache,mit")
    assert found[2].labels == "mit-text" and found[2].score == 1.0 and found[2].first_word is None
    assert found[3].labels == "mit-text" and 0.9 < found[3].score < 1
    assert found[4].base_labels == "cc-by" and found[4].labels == "cc-by,cc-by-nc"
    assert found[5].labels == "" and found[5].score == 0.0 and found[6].n_base == 0
    assert (found[7].n_base, found[7].first_word, found[7].last_word) == (2, 0, 4)
    rows = license.scan(odd).collect()
    assert len(rows) == len(odd_rows) and {r.n_words for r in rows if r.doc_id in (1, 2)} == {0}
    assert license.scan(none).collect() == []


def test_chat_reads_back(spark):
    mark = "<|im_end|><|im_start|>assistant ok"
    rows = [
        (1, 0, "user", mark), (1, 1, "assistant", mark), (2, 0, "a\\n\\\nb<|im_end|>", "\\n<\\|<\\\\|"), (2, None, None, None),
        (3, 0, "assistant", ""), (None, 1, "user", "u"), (4, 0, "user", "x"), (4, 1, "assistant", "y"), (4, 1, "assistant", "y"),
        (5, 0, "system", "s\n"), (5, 1, "user", "<|im_end|>\n"), (5, 2, "assistant", "long " * 50000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    found = chat.formatted(df).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.learnt_text(F.col("segments")))
    for r in found.collect():
        mine = sorted((t is not None, t or 0, role or "", text or "") for i, t, role, text in rows if i == r.conv_id)
        assert [tuple(b) for b in r.back] == [m[2:] for m in mine]
        assert r.loss == "".join(m[3] for m in mine if m[2] == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        assert (r.valid, r.wrong_turn) == {1: (True, None), 2: (False, 0), 3: (False, 0), None: (True, None), 4: (False, 2), 5: (True, None)}[r.conv_id]
    assert chat.formatted(df.where("1 = 0")).collect() == []


def test_sha_of_a_conversation_is_that_of_its_turns(spark, sf):
    from recallflow.llm.queries import op6

    rows = spark.read.parquet(f"{sf}/conversations.parquet").where("conv_id = 0").orderBy("turn").collect()
    got = op6(spark, sf).where("conv_id = 0").first()
    assert got.turns_sha256 == hashlib.sha256("".join(f"{r.role}\n{r.text}\n" for r in rows).encode()).hexdigest()


def test_digest_tells_short_texts_apart():
    draw = random.Random(9)
    pick = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)).encode()
    assert digest.digest(b"hello world") != digest.digest(b"abcdefghijk")
    assert digest.likeness(digest.digest(b""), digest.digest(b"hello world")) == 0 and digest.likeness(digest.digest(b""), digest.digest(b"")) == 1
    for n in (8, 20, 50, 200, 3000):
        own = other = 0.0
        for _ in range(40):
            t, u = pick(n), pick(n)
            own += digest.likeness(digest.digest(t), digest.digest(t[: n - n // 3] + u[: n // 3])) / 40
            other += digest.likeness(digest.digest(t), digest.digest(u)) / 40
        assert other < 0.1 and own > other + 0.1
