"""Text functions against a small row-wise oracle and hand-made cases."""

import re

from pyspark.sql import functions as F

from recallflow.functions import lexicon as lx
from recallflow.functions import text as tx
from recallflow.sources import adapters as ad

STOP, PUNCT = set(lx.STOP_WORDS), lx.PUNCTUATION


def norm(t):
    t = t[:-2] if t.endswith("'s") and len(t) > 3 else t[:-1] if t.endswith("'") and len(t) > 3 else t
    if t.endswith("ing") and len(t) >= 7:
        return t[:-3]
    return t[:-1] if len(t) > 3 and t.endswith("s") and not t.endswith("ss") else t


def tokens(text):
    out = []
    for w in (w.strip(PUNCT) for w in text.lower().split()):
        if len(w) > 1 and w not in STOP:
            out += [t for t in (w, norm(w), *lx.SYNONYMS.get(w, [])) if len(t) > 1]
    return sorted(dict.fromkeys(out), key=len, reverse=True)


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "text string").select(expr(F.col("text")).alias("r")).first()["r"]


def test_tokens_of_whole_documents(spark, sf):
    rows = ad.table(spark, sf, "documents").select("text", tx.tokenize(F.col("text")).alias("t")).collect()
    assert rows and all(r.t == tokens(r.text) for r in rows)


def test_tokens_of_odd_texts(spark):
    for text in ["", "   ", "--- ...", "don't (Stop) «naïve» — co-op!!", "Rome, Paris x", "a b c", "university's son", "'s ''' s'", "　Ünïcödé　"]:
        assert one(spark, tx.tokenize, text) == tokens(text), text


def test_normalize(spark):
    cases = {"visiting": "visit", "eats": "eat", "bananas": "banana", "running": "runn", "string": "string", "alice's": "alice", "dogs'": "dog", "class": "class"}
    for w, want in cases.items():
        assert one(spark, tx.normalize_token, w) == want


def test_auto_fact(spark):
    cases = {
        "Alice lives in Paris France": ("alice", "lives", "paris france"),
        "Quickly running Bob lives": ("bob", "lives", "quickly running"),
        "walking slowly": ("slowly", "walking", "walking"),
        "hello": ("hello", "", ""), "": ("", "", ""), "the of": ("", "", ""),
    }
    for text, want in cases.items():
        r = one(spark, tx.auto_fact, text)
        assert (r.subject, r.relation, r.value) == want, text


def test_override(spark):
    assert one(spark, tx.has_override, "I use Vim exclusively!")
    assert one(spark, tx.has_override, "She no longer smokes")
    assert not one(spark, tx.has_override, "unswitched lamps")


def test_entities(spark):
    assert one(spark, tx.extract_entities, "Yesterday Jean Paul met Ann in New York. The Dog barked") == ["jean paul", "ann", "new york", "dog"]
    assert one(spark, tx.extract_entities, "Rome") == []


def test_questions_and_split(spark):
    assert one(spark, tx.is_question, "How old is Alice")
    assert one(spark, tx.is_question_only, "what is my name?")
    assert one(spark, tx.split_document, "User: I am a vegetarian. I live here!\nok\nAI: remote work") == ["I am a vegetarian.", "I live here!", "remote work"]


def test_stems(spark):
    for w in ("hiking", "hike", "hiked", "hiker"):
        assert one(spark, tx.light_stem, w) == "hik"


def test_one_word_of_fifty_thousand_letters(spark):
    assert one(spark, lambda c: F.length(F.get(tx.tokenize(c), F.lit(0))), "x" * 50000) == 50000
    assert one(spark, lambda c: F.size(tx.extract_entities(c)), "a " + "Word " * 20000) == 1
    assert one(spark, lambda c: F.length(tx.auto_fact(c)["value"]), "running " * 20000) > 0


def test_noise(spark):
    assert one(spark, tx.is_noise, "Let me know if you need more")
    assert one(spark, lambda c: tx.is_noise(c, ("[Our Banner]",)), "see [our banner] here")
    assert not one(spark, tx.is_noise, "Alice likes tea")


def test_character_classes_hold_what_they_name(spark):
    space = {*" \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0     　", *map(chr, range(0x2000, 0x200B))}
    chars = spark.range(1, 65536).where("id < 55296 OR id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    for body, want in ((tx.SPACE, space), (tx.PUNCT, PUNCT)):
        assert {r.c for r in chars.where(F.col("c").rlike(f"[{body}]")).collect()} == {*want}
        assert {r.c for r in chars.where(~F.col("c").rlike(f"[^{body}]")).collect()} == {*want}
        # Java tests the members of a class one after another: few besides the table of those below 256.
        assert len(re.sub(r"\[.*\]", "", body).encode("latin-1")) and body.count("&&") == 1


def test_facts_and_tokens_of_shared_words(spark):
    from recallflow.operators import strength as st

    texts = ["Actually the running «cat» -- sat on 'Rome's' wall!", "", "a b", "—", "really quickly moved  on"]
    rows = st.derive_facts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for r in rows:
        f = one(spark, tx.auto_fact, r.text)
        assert (r.subject, r.relation, r.value, r.override) == (f.subject, f.relation, f.value, f.override)
        assert r.tokens == tokens(r.text)


def test_entropy_of_rare_and_common_characters(spark):
    from math import log2

    for text in ["", "aaaa", "a b", "ünï 漢字 «x» 漢", "?!;:(%)$^.*[]\\", "the quick brown fox 0123456789 the", "\n\n \t"]:
        share = [text.count(c) / len(text) for c in set(text)]
        assert abs(one(spark, tx.char_entropy, text) + sum(p * log2(p) for p in share)) < 1e-12, text


def test_no_noun_among_the_first_words(spark):
    lead = "running jumped quickly walking talked slowly eating tasted newly"
    f = one(spark, tx.auto_fact, f"{lead} garden wall")
    assert (f.subject, f.relation) == ("garden", "wall") and f.value == lead
    f = one(spark, tx.auto_fact, lead)
    assert f.subject == "newly"
