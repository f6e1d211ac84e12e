"""Text to tokens, facts and entities, as native column expressions.

No Python runs per row: every function returns a Column that Catalyst plans inside
the scan stage. Whole texts are processed; cost is linear in their length.
"""

from __future__ import annotations

import re
import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallflow.functions import lexicon as lx

# Unicode white space as one regex class body (Java's \s alone is ASCII only). Java looks single
# characters below 256 up in one table and asks a class for all others one by one, so those
# stand behind one range that letters fall outside of.
SPACE = r" \t\n\x0B\f\r\x1C\x1D\x1E\x1F\x85\u00A0[\u1680-\u3000&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]"


def _char_class(chars: str) -> str:
    """Body of a Java regex character class holding exactly ``chars``."""
    low = "".join("\\" + c if c in r"\[]^-&~|" else c for c in chars if c < "\u0100")
    high = sorted(c for c in chars if c >= "\u0100")
    return low + (f"[{high[0]}-{high[-1]}&&[{''.join(high)}]]" if high else "")


PUNCT = _char_class(lx.PUNCTUATION)
# Runs of punctuation touching white space or an end of the text. The pattern starts with
# the punctuation class, so letters are rejected by one table look-up.
_EDGE_PUNCT = f"[{PUNCT}](?:[{PUNCT}]*+(?![^{SPACE}])|(?<![^{SPACE}][{PUNCT}])[{PUNCT}]*+)"


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (lambda arguments are not inlined)."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def _array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _any_contains(text: Column, fragments: list[str]) -> Column:
    found = [text.contains(f) for f in fragments]
    return reduce(lambda a, b: a | b, found)


def split_words(text: Column) -> Column:
    """White-space words, empty strings removed."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def strip_punct(text: Column) -> Column:
    """Trim punctuation at both ends of every white-space word; inner marks stay."""
    return F.regexp_replace(text, _EDGE_PUNCT, "")


def clean_words(text: Column) -> Column:
    """Words after punctuation trimming, in order, duplicates kept."""
    return split_words(strip_punct(text))


def normalize_token(token: Column) -> Column:
    """Lower-case, drop a possessive, then a long ``-ing`` or a single ``-s``."""
    t = F.lower(token)
    t = (
        F.when(t.endswith("'s") & (F.length(t) > 3), F.regexp_replace(t, "'s$", ""))
        .when(t.endswith("'") & (F.length(t) > 3), F.regexp_replace(t, "'$", ""))
        .otherwise(t)
    )
    return (
        F.when(t.endswith("ing") & (F.length(t) >= 7), F.regexp_replace(t, "ing$", ""))
        .when(
            t.endswith("s") & ~t.endswith("ss") & (F.length(t) > 3),
            F.regexp_replace(t, "s$", ""),
        )
        .otherwise(t)
    )


def _synonym_map() -> Column:
    entries: list[Column] = []
    for word, others in lx.SYNONYMS.items():
        entries += [F.lit(word), _array(others)]
    return F.create_map(*entries)


def token_set(text: Column) -> Column:
    """Distinct index tokens in first-seen order (raw, normalised, synonyms)."""
    return token_set_of(clean_words(F.lower(text)))


def token_set_of(cleaned: Column) -> Column:
    """As :func:`token_set`, from the clean lower-case words."""
    words = F.filter(
        F.array_except(cleaned, _array(lx.STOP_WORDS)),
        lambda w: F.length(w) > 1,
    )
    synonyms = _synonym_map()

    def expand(w: Column) -> Column:
        norm = normalize_token(w)
        base = F.when(
            w.endswith("s") | w.endswith("ing") | w.endswith("'"),
            F.when(F.length(norm) > 1, F.array(w, norm)).otherwise(F.array(w)),
        ).otherwise(F.array(w))
        return F.when(
            w.isin(list(lx.SYNONYMS)), F.concat(base, F.element_at(synonyms, w))
        ).otherwise(base)

    return F.array_distinct(F.flatten(F.transform(words, expand)))


def by_length(tokens: Column) -> Column:
    """Stable sort of a token array, longest first."""
    keyed = F.transform(
        tokens,
        lambda t, i: F.struct((-F.length(t)).alias("k"), i.alias("i"), t.alias("t")),
    )
    return F.transform(F.sort_array(keyed), lambda s: s["t"])


def tokenize(text: Column) -> Column:
    """Index tokens, longest first."""
    return by_length(token_set(text))


def has_override(text: Column, cleaned: Column | None = None) -> Column:
    """True when the text signals that it replaces an earlier belief."""
    low = F.lower(text)
    word = F.when(
        _any_contains(low, lx.OVERRIDE_WORDS),
        F.arrays_overlap(clean_words(low) if cleaned is None else cleaned, _array(lx.OVERRIDE_WORDS)),
    ).otherwise(False)
    return word | _any_contains(low, lx.OVERRIDE_PHRASES)


def content_words(cleaned: Column) -> Column:
    """Non-stop words longer than one character, in order, duplicates kept."""
    return F.filter(cleaned, lambda w: ~w.isin(lx.STOP_WORDS) & (F.length(w) > 1))


def auto_fact(text: Column, cleaned: Column | None = None) -> Column:
    """Struct(subject, relation, value, override) guessed from word order.

    Leading words ending in ing/ed/ly move behind the rest, but never the last word.
    ``cleaned`` takes the clean lower-case words where they are at hand.
    """
    words = clean_words(F.lower(text)) if cleaned is None else cleaned

    def turn(words: Column) -> Column:
        n = F.size(words)
        # Nearly always one of the first words: only else are all of them looked at.
        found = [F.array_position(F.transform(some, lambda w: ~(w.endswith("ing") | w.endswith("ed") | w.endswith("ly"))), True) for some in (F.slice(words, 1, 8), words)]
        noun = F.when(found[0] > 0, found[0]).otherwise(found[1])
        k = F.greatest(F.when(noun > 0, noun - 1).otherwise(n - 1), F.lit(0)).cast("int")
        return F.concat(F.slice(words, k + 1, n), F.slice(words, F.lit(1), k))

    def build(w: Column) -> Column:
        subject = F.coalesce(F.get(w, F.lit(0)), F.lit(""))
        relation = F.coalesce(F.get(w, F.lit(1)), F.lit(""))
        value = F.when(F.size(w) == 2, relation).otherwise(
            F.array_join(F.slice(w, F.lit(3), F.greatest(F.size(w), F.lit(1))), " ")
        )
        return F.struct(
            subject.alias("subject"),
            relation.alias("relation"),
            value.alias("value"),
            has_override(text, cleaned).alias("override"),
        )

    return bind(bind(content_words(words), turn), build)


def index_tokens(text: Column, value: Column) -> Column:
    """Tokens of the text followed by value tokens not yet present."""
    return F.array_union(tokenize(text), tokenize(F.coalesce(value, F.lit(""))))


def extract_entities(text: Column) -> Column:
    """Distinct lower-cased runs of capitalised words, the first word excluded."""
    mark = F.lit("\u0001")
    words = F.split(F.regexp_replace(text, f"^[{SPACE}]+", ""), f"[{SPACE}]+")
    edge = f"^[{PUNCT}]+|[{PUNCT}]+$"

    def keep(w: Column, i: Column) -> Column:
        name = bind(
            F.regexp_replace(w, edge, ""),
            lambda c: F.when(
                (F.length(c) > 1) & ~F.lower(c).isin(lx.STOP_WORDS), F.lower(c)
            ).otherwise(mark),
        )
        return F.when((i > 0) & w.rlike(f"^[{PUNCT}]*\\p{{Lu}}"), name).otherwise(mark)

    runs = F.split(F.array_join(F.transform(words, keep), " "), "\u0001")
    return F.array_distinct(F.array_remove(F.transform(runs, lambda r: F.trim(r)), ""))


def fact_text(subject: Column, relation: Column, value: Column) -> Column:
    return F.lower(F.concat_ws(" ", subject, relation, value))


# Common characters, most frequent first; any order gives the same entropy.
_COMMON = " etaoinsrhldcumfpgwybvkxjqz.,0123456789"


def char_entropy(text: Column) -> Column:
    """Shannon bits per character of a string; 0 for an empty one.

    Common characters are taken out one after another, so the text soon gets short; only
    what is left is split into characters.
    """
    def bits(s: Column) -> Column:
        n = F.length(s)

        def add(acc: Column, k: Column) -> Column:
            return acc - F.when(k > 0, (k / n) * F.log2(k / n)).otherwise(0.0)

        def take(acc: Column, c: Column) -> Column:
            return bind(
                F.replace(acc["rest"], c, F.lit("")),
                lambda rest: F.struct(rest.alias("rest"), F.length(rest).alias("n"), add(acc["bits"], acc["n"] - F.length(rest)).alias("bits")),
            )

        def others(common: Column) -> Column:
            counts = F.transform(
                F.array_distinct(F.split(common["rest"], "")),
                lambda c: common["n"] - F.length(F.replace(common["rest"], c, F.lit(""))),
            )
            return F.when(common["n"] > 0, F.aggregate(counts, common["bits"], add)).otherwise(common["bits"])

        start = F.struct(s.alias("rest"), n.alias("n"), F.lit(0.0).alias("bits"))
        common = F.aggregate(_array([*_COMMON]), start, take)
        return F.when(n > 0, bind(common, others)).otherwise(0.0)

    return bind(text, bits)


def bigrams(text: Column) -> Column:
    """Distinct character bigrams; a string shorter than two is its own bigram."""
    def pairs(s: Column) -> Column:
        n = F.length(s)
        return F.when(
            n >= 2,
            bind(
                F.split(s, ""),
                lambda c: F.array_distinct(
                    F.zip_with(
                        F.slice(c, F.lit(1), n - 1),
                        F.slice(c, F.lit(2), n - 1),
                        lambda a, b: F.concat(a, b),
                    )
                ),
            ),
        ).otherwise(F.array(s))

    return bind(F.trim(F.lower(text)), pairs)


def set_divergence(a: Column, b: Column) -> Column:
    """1 - Jaccard of two distinct arrays."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, 0.0).otherwise(1.0 - shared / union)


def bigram_divergence(a: Column, b: Column) -> Column:
    return set_divergence(bigrams(a), bigrams(b))


def categorize(text: Column) -> Column:
    """First matching category, else General."""
    low = F.lower(text)
    chain = None
    for name, pattern in lx.CATEGORIES.items():
        chain = F.when(low.rlike(pattern), name) if chain is None else chain.when(
            low.rlike(pattern), name
        )
    return chain.otherwise("General")


def _hits(text: Column, signals: list[str]) -> Column:
    total = F.lit(0)
    for s in signals:
        total = total + text.contains(s).cast("int")
    return total


def visitor_intent(text: Column) -> Column:
    """Keyword vote between three visitor classes; developer by default."""
    low = F.lower(F.trim(text))
    dev = _hits(low, lx.DEVELOPER_SIGNALS)
    founder = _hits(low, lx.FOUNDER_SIGNALS)
    research = _hits(low, lx.RESEARCH_SIGNALS)
    return (
        F.when(F.length(low) < 2, "developer")
        .when((research > dev) & (research > founder), "researcher")
        .when(founder > dev, "founder")
        .otherwise("developer")
    )


def _starts(text: Column, prefixes: list[str]) -> Column:
    return text.rlike("^(?:" + "|".join(re.escape(p) for p in prefixes) + ")")


def is_question(text: Column) -> Column:
    t = F.trim(F.lower(text))
    return t.contains("?") | _starts(t, lx.QUESTION_STARTS)


def is_question_only(text: Column) -> Column:
    t = F.trim(F.lower(text))
    return _starts(t, lx.QUESTION_ONLY_STARTS) & (F.length(t) < 80)


def normalize_model(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.contains("gemini"), "gemini")
        .when(low.rlike("gpt|openai"), "chatgpt")
        .when(low.rlike("claude|anthropic"), "claude")
        .when(low.contains("copilot"), "copilot")
        .otherwise(name)
    )


def split_document(text: Column) -> Column:
    """Sentences and lines longer than eight characters, speaker labels removed."""
    lines = F.split(text, f"\n|(?<=[.!?])[{SPACE}]+")
    bare = F.transform(
        lines,
        lambda s: F.regexp_replace(
            F.regexp_replace(s, f"^(User|Assistant|Human|AI)[{SPACE}]*:[{SPACE}]*", ""),
            f"^[{SPACE}]+|[{SPACE}]+$",
            "",
        ),
    )
    return F.filter(bare, lambda s: F.length(s) > 8)


def user_text(messages: Column) -> Column:
    """Join the user's text parts of ``array<struct<role, parts: array<string>>>``."""
    users = F.filter(messages, lambda m: m["role"] == "user")
    return F.trim(F.array_join(F.flatten(F.transform(users, lambda m: m["parts"])), " "))


def user_facts(messages: Column) -> Column:
    """User statements longer than eight characters that ask nothing."""
    texts = F.transform(
        F.filter(messages, lambda m: m["role"] == "user"), lambda m: F.trim(m["content"])
    )
    return F.filter(texts, lambda t: (F.length(t) > 8) & ~t.contains("?"))


def assistant_facts(text: Column, drop_boilerplate: bool = False) -> Column:
    """First three sentences that speak about the user."""
    sentences = F.transform(F.split(text, f"(?<=[.!?])[{SPACE}]+"), lambda s: F.trim(s))
    you = "|".join(re.escape(k) for k in lx.YOU_KEYWORDS)
    skip = "|".join(re.escape(k) for k in lx.ASSISTANT_SKIP)

    def keep(s: Column) -> Column:
        low = F.lower(s)
        if drop_boilerplate:
            return (F.length(s) >= 20) & low.rlike(you) & ~low.rlike(skip)
        return (F.length(s) > 20) & low.rlike(you)

    return F.slice(F.filter(sentences, keep), 1, 3)


def meaningful_tokens(text: Column) -> Column:
    """Distinct word tokens minus the event stop list."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return F.array_except(words, _array(lx.EVENT_STOP_WORDS))


def light_stem(token: Column) -> Column:
    """Strip one common suffix; enough to match hike, hiked, hiking and hiker."""
    n = F.length(token)
    ed = F.regexp_replace(token, "ed$", "")
    return (
        F.when((n > 5) & token.endswith("ing"), F.regexp_replace(token, "ing$", ""))
        .when((n > 4) & token.endswith("ed"), F.regexp_replace(ed, "e$", ""))
        .when((n > 4) & token.endswith("er"), F.regexp_replace(token, "er$", ""))
        .when((n > 4) & token.endswith("ers"), F.regexp_replace(token, "ers$", ""))
        .when((n > 3) & token.endswith("e"), F.regexp_replace(token, "e$", ""))
        .when(
            (n > 3) & token.endswith("s") & ~token.endswith("ss"),
            F.regexp_replace(token, "s$", ""),
        )
        .otherwise(token)
    )


def event_stems(text: Column) -> Column:
    """Distinct match keys of meaningful tokens (short tokens match only themselves)."""
    return F.array_distinct(
        F.transform(
            meaningful_tokens(text),
            lambda t: F.when(F.length(t) < 3, t).otherwise(light_stem(t)),
        )
    )


def billing_subject(email: Column, api_key: Column) -> Column:
    """One subject per owner; a key without a known owner is its own subject."""
    owner = F.concat(F.lit("owner:"), F.substring(F.sha2(email, 256), 1, 16))
    key = hash_identifier(F.coalesce(api_key, F.lit("")))
    return F.when(F.coalesce(email, F.lit("")) != "", owner).otherwise(key)


def hash_identifier(api_key: Column) -> Column:
    return F.concat(F.lit("key:"), F.substring(F.sha2(api_key, 256), 1, 16))


def hash_site(url: Column) -> Column:
    return F.sha2(url, 256)


def is_noise(text: Column, extra_fragments: tuple[str, ...] = ()) -> Column:
    """Too short, a bare question, or carrying a boiler-plate fragment.

    ``extra_fragments`` takes the deployment's own banner lines.
    """
    t = F.trim(text)
    low = F.lower(t)
    fragments = lx.NOISE_FRAGMENTS + [f.lower() for f in extra_fragments]
    return (F.length(t) < 6) | _any_contains(low, fragments) | is_question_only(t)


def clip(text: Column, limit: int) -> Column:
    return F.substring(F.trim(F.coalesce(text, F.lit(""))), 1, limit)


def is_probe_path(path: Column) -> Column:
    return _any_contains(F.lower(path), lx.PROBE_FRAGMENTS)


def light_eval_token(word: Column) -> Column:
    """Answer-scoring token: ASCII punctuation and a possessive removed."""
    ascii_punct = _char_class(string.punctuation)
    bare = F.regexp_replace(word, f"^[{ascii_punct}]+|[{ascii_punct}]+$", "")
    return F.regexp_replace(bare, "['’]s$", "")


def facts_from_struct(value: Column, data_type, prefix: str = "") -> Column:
    """Array of ``"a: b: v"`` lines of a nested struct, flattened at planning time.

    Lists become one line joined with commas; the recursion follows the schema, so the
    work per row is a fixed set of string expressions.
    """
    kind = data_type.typeName()
    if kind == "struct":
        parts = [
            facts_from_struct(value[f.name], f.dataType, f"{prefix}{f.name}: ")
            for f in data_type.fields
        ]
        return F.concat(*parts)
    if kind == "array":
        line = F.array_join(value.cast("array<string>"), ", ", "None")
    else:
        line = F.coalesce(value.cast("string"), F.lit("None"))
    return F.array(F.concat(F.lit(prefix), line))
