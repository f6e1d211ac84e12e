"""Queries over row-local text functions (whole tables, whole texts)."""

from pyspark.sql import functions as F

from recallflow.functions import lexicon as lx
from recallflow.functions import text as tx
from recallflow.plans import oracle as o
from recallflow.plans.registry import query
from recallflow.sources import adapters as ad

_DOC = "SELECT doc_id, text FROM documents"


def _docs(spark, sf):
    return ad.table(spark, sf, "documents").select("doc_id", "text")


@query(
    "text_clean_words",
    f"""SELECT doc_id, len({o.words('text')}) AS n_words,
    md5(array_to_string({o.words('text')}, ' ')) AS words_md5 FROM documents""",
)
def text_clean_words(spark, sf):
    w = tx.clean_words(F.lower("text"))
    return _docs(spark, sf).select(
        "doc_id", F.size(w).alias("n_words"), F.md5(F.array_join(w, " ")).alias("words_md5")
    )


@query(
    "text_tokens",
    o.sql("", "SELECT doc_id, count(*) AS n_tokens, CAST(sum(length(token)) AS BIGINT) AS chars, "
          "min(token) AS lo, max(token) AS hi FROM tok GROUP BY 1",
          o.tokens("tok", "documents", "doc_id")),
)
def text_tokens(spark, sf):
    t = _docs(spark, sf).select("doc_id", F.explode_outer(tx.token_set(F.col("text"))).alias("token")).where("token IS NOT NULL")
    return t.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.sum(F.length("token")).alias("chars"),
        F.min("token").alias("lo"), F.max("token").alias("hi"),
    )


@query(
    "text_tokens_ordered",
    o.sql("", """SELECT doc_id, md5(string_agg(token, ' ' ORDER BY r)) AS tokens_md5, max(r) AS n_tokens
      FROM tok GROUP BY 1""", o.ordered_tokens("tok", "documents", "doc_id")),
)
def text_tokens_ordered(spark, sf):
    t = _docs(spark, sf).select("doc_id", tx.tokenize(F.col("text")).alias("t"))
    return t.where(F.size("t") > 0).select(
        "doc_id", F.md5(F.array_join("t", " ")).alias("tokens_md5"), F.size("t").cast("bigint").alias("n_tokens")
    )


@query(
    "text_normalized_tokens",
    o.sql("", f"SELECT w AS word, {o.normalized('w')} AS normal, count(*) AS n FROM "
          f"(SELECT unnest({o.words('text')}) AS w FROM documents) GROUP BY 1, 2"),
)
def text_normalized_tokens(spark, sf):
    w = _docs(spark, sf).select(F.explode_outer(tx.clean_words(F.lower("text"))).alias("word")).where("word IS NOT NULL")
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "normal", tx.normalize_token(F.col("word"))
    )


@query("text_override", f"SELECT doc_id, {o.override('text')} AS override FROM documents")
def text_override(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.has_override(F.col("text")).alias("override"))


@query(
    "text_auto_facts",
    o.sql("", "SELECT doc_id, subject, relation, md5(value) AS value_md5, override FROM f",
          o.facts("f", "documents", "doc_id")),
)
def text_auto_facts(spark, sf):
    f = _docs(spark, sf).select("doc_id", tx.auto_fact(F.col("text")).alias("f"))
    return f.select(
        "doc_id", "f.subject", "f.relation", F.md5("f.value").alias("value_md5"), "f.override"
    )


_STRIPPED = f"regexp_replace(w, '{o.EDGE}', '', 'g')"


@query(
    "text_entities",
    f"""WITH w AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '^{o.SPACE}+', ''), '{o.SPACE}+') AS ws
      FROM documents),
    p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
    c AS (SELECT doc_id, i, {_STRIPPED} AS c FROM p),
    e AS (SELECT doc_id, i, lower(c) AS c FROM c WHERE i > 1 AND length(c) > 1
      AND regexp_matches(c, '^\\p{{Lu}}') AND lower(c) NOT IN ({o.quoted(lx.STOP_WORDS)})),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
    n AS (SELECT doc_id, string_agg(c, ' ' ORDER BY i) AS entity FROM g GROUP BY doc_id, run)
    SELECT DISTINCT doc_id, entity FROM n""",
)
def text_entities(spark, sf):
    return _docs(spark, sf).select(
        "doc_id", F.explode_outer(tx.extract_entities(F.col("text"))).alias("entity")
    ).where("entity IS NOT NULL")


_SRV = "lower(concat_ws(' ', subject, relation, value))"


@query(
    "text_char_entropy",
    o.sql("", f"""SELECT doc_id, round(coalesce((SELECT -sum(n / t * log2(n / t)) FROM
      (SELECT count(*)::DOUBLE AS n, length(s)::DOUBLE AS t FROM (SELECT unnest(string_split(s, '')) AS c) GROUP BY c)), 0), 6) AS bits
      FROM (SELECT doc_id, {_SRV} AS s FROM f)""", o.facts("f", "documents", "doc_id")),
)
def text_char_entropy(spark, sf):
    f = _docs(spark, sf).select("doc_id", tx.auto_fact(F.col("text")).alias("f"))
    bits = tx.char_entropy(tx.fact_text(F.col("f.subject"), F.col("f.relation"), F.col("f.value")))
    return f.select("doc_id", F.round(bits, 6).alias("bits"))


def _grams(s: str) -> str:
    t = f"trim(lower({s}))"
    return (
        f"CASE WHEN length({t}) < 2 THEN [{t}] ELSE list_distinct(list_transform("
        f"range(1, length({t})), lambda i: {t}[i:i+1])) END"
    )


@query(
    "text_bigram_divergence",
    f"""WITH p AS (SELECT a.conv_id, a.turn, {_grams('a.text')} AS x, {_grams('b.text')} AS y
      FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
    SELECT conv_id, turn, round(1 - len(list_intersect(x, y))::DOUBLE
      / (len(x) + len(y) - len(list_intersect(x, y))), 6) AS divergence FROM p""",
)
def text_bigram_divergence(spark, sf):
    c = ad.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return c.join(nxt, ["conv_id", "turn"]).select(
        "conv_id", "turn",
        F.round(tx.bigram_divergence(F.col("text"), F.col("next")), 6).alias("divergence"),
    )


_CAT = "CASE " + " ".join(
    f"WHEN regexp_matches(lower(text), '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'"
    for n, p in lx.CATEGORIES.items()
) + " ELSE 'General' END"


@query("text_categorize", f"SELECT {_CAT} AS category, count(*) AS n FROM documents GROUP BY 1")
def text_categorize(spark, sf):
    return _docs(spark, sf).groupBy(tx.categorize(F.col("text")).alias("category")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _hits(words):
    return "(" + " + ".join(f"contains(t, '{w}')::INT" for w in words) + ")"


@query(
    "text_visitor_intent",
    f"""WITH h AS (SELECT doc_id, lower(trim(text)) AS t FROM documents), v AS (
      SELECT doc_id, t, {_hits(lx.DEVELOPER_SIGNALS)} AS d, {_hits(lx.FOUNDER_SIGNALS)} AS f,
      {_hits(lx.RESEARCH_SIGNALS)} AS r FROM h)
    SELECT doc_id, CASE WHEN length(t) < 2 THEN 'developer' WHEN r > d AND r > f THEN 'researcher'
      WHEN f > d THEN 'founder' ELSE 'developer' END AS intent FROM v""",
)
def text_visitor_intent(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.visitor_intent(F.col("text")).alias("intent"))


def _starts(t, prefixes):
    return "(" + " OR ".join(f"starts_with({t}, '{p.replace(chr(39), chr(39) * 2)}')" for p in prefixes) + ")"


@query(
    "text_questions",
    f"""SELECT conv_id, turn, contains(text, '?') OR {_starts('lower(trim(text))', lx.QUESTION_STARTS)} AS question,
    {_starts('lower(trim(text))', lx.QUESTION_ONLY_STARTS)} AND length(trim(text)) < 80 AS question_only
    FROM conversations""",
)
def text_questions(spark, sf):
    return ad.table(spark, sf, "conversations").select(
        "conv_id", "turn",
        tx.is_question(F.col("text")).alias("question"),
        tx.is_question_only(F.col("text")).alias("question_only"),
    )


@query(
    "text_model_names",
    """SELECT m AS model, CASE WHEN contains(m, 'gemini') THEN 'gemini' WHEN contains(m, 'gpt') THEN 'chatgpt'
      WHEN contains(m, 'claude') THEN 'claude' WHEN contains(m, 'copilot') THEN 'copilot' ELSE m END AS family,
      count(*) AS n FROM (SELECT (['gpt-4o', 'claude-x', 'gemini-pro', 'copilot', 'grok'])[conv_id % 5 + 1] AS m
      FROM conversations) GROUP BY 1, 2""",
)
def text_model_names(spark, sf):
    names = F.array(*[F.lit(n) for n in ("gpt-4o", "claude-x", "gemini-pro", "copilot", "grok")])
    m = ad.table(spark, sf, "conversations").select(
        F.get(names, (F.col("conv_id") % 5).cast("int")).alias("model")
    )
    return m.groupBy("model", tx.normalize_model(F.col("model")).alias("family")).agg(
        F.count(F.lit(1)).alias("n")
    )


_LINES = f"string_split(regexp_replace(text, '([.!?]){o.SPACE}+', '\\1' || chr(10), 'g'), chr(10))"
_BARE = (
    f"regexp_replace(regexp_replace(s, '^(User|Assistant|Human|AI){o.SPACE}*:{o.SPACE}*', ''), "
    f"'^{o.SPACE}+|{o.SPACE}+$', '', 'g')"
)


@query(
    "text_split_document",
    f"""SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, {_BARE} AS line FROM
      (SELECT doc_id, unnest({_LINES}) AS s FROM documents)) WHERE length(line) > 8 GROUP BY 1, 2""",
)
def text_split_document(spark, sf):
    lines = _docs(spark, sf).select("doc_id", F.explode_outer(tx.split_document(F.col("text"))).alias("line")).where("line IS NOT NULL")
    return lines.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n"))


@query(
    "text_facts_from_struct",
    """SELECT doc_id, unnest(['lang: ' || lang, 'origin: source: ' || source, 'origin: size: ' || n_chars,
      'tags: ' || lang || ', ' || source]) AS fact FROM documents""",
)
def text_facts_from_struct(spark, sf):
    d = ad.table(spark, sf, "documents").select(
        "doc_id",
        F.struct(
            "lang",
            F.struct("source", F.col("n_chars").alias("size")).alias("origin"),
            F.array("lang", "source").alias("tags"),
        ).alias("s"),
    )
    return d.select(
        "doc_id", F.explode(tx.facts_from_struct(F.col("s"), d.schema["s"].dataType)).alias("fact")
    )


def _sessions(spark, sf):
    m = F.struct("turn", "role", F.col("text").alias("content"), F.array("text").alias("parts"))
    return ad.table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(m)).alias("messages")
    )


@query(
    "text_user_messages",
    """SELECT conv_id, count(*) FILTER (WHERE length(trim(text)) > 8 AND NOT contains(text, '?')) AS facts,
    md5(trim(string_agg(text, ' ' ORDER BY turn))) AS text_md5
    FROM conversations WHERE role = 'user' GROUP BY 1""",
)
def text_user_messages(spark, sf):
    s = _sessions(spark, sf)
    return s.where(F.exists("messages", lambda m: m["role"] == "user")).select(
        "conv_id",
        F.size(tx.user_facts(F.col("messages"))).cast("bigint").alias("facts"),
        F.md5(tx.user_text(F.col("messages"))).alias("text_md5"),
    )


def _you(s, words):
    return "(" + " OR ".join(f"contains(lower({s}), '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


@query(
    "text_assistant_facts",
    f"""WITH s AS (SELECT conv_id, turn, list_transform(string_split(regexp_replace(text, '([.!?]){o.SPACE}+', '\\1' || chr(1), 'g'), chr(1)),
      lambda s: trim(s)) AS ss FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn,
      array_to_string(list_filter(ss, lambda s: length(s) > 20 AND {_you('s', lx.YOU_KEYWORDS)})[1:3], '|') AS facts,
      array_to_string(list_filter(ss, lambda s: length(s) >= 20 AND {_you('s', lx.YOU_KEYWORDS)}
        AND NOT {_you('s', lx.ASSISTANT_SKIP)})[1:3], '|') AS clean_facts FROM s""",
)
def text_assistant_facts(spark, sf):
    a = ad.table(spark, sf, "conversations").where("role = 'assistant'")
    return a.select(
        "conv_id", "turn",
        F.array_join(tx.assistant_facts(F.col("text")), "|").alias("facts"),
        F.array_join(tx.assistant_facts(F.col("text"), True), "|").alias("clean_facts"),
    )


_MEAN = f"list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')), lambda t: t NOT IN ({o.quoted(lx.EVENT_STOP_WORDS)}))"
_STEM = """CASE WHEN length(t) > 5 AND t LIKE '%ing' THEN left(t, length(t) - 3)
  WHEN length(t) > 4 AND t LIKE '%eed' THEN left(t, length(t) - 3)
  WHEN length(t) > 4 AND t LIKE '%ed' THEN left(t, length(t) - 2)
  WHEN length(t) > 4 AND t LIKE '%er' THEN left(t, length(t) - 2)
  WHEN length(t) > 4 AND t LIKE '%ers' THEN left(t, length(t) - 3)
  WHEN length(t) > 3 AND t LIKE '%e' THEN left(t, length(t) - 1)
  WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END"""


@query(
    "text_event_stems",
    f"""SELECT t AS token, {_STEM} AS stem, count(*) AS docs FROM
      (SELECT unnest({_MEAN}) AS t FROM documents) GROUP BY 1, 2""",
)
def text_event_stems(spark, sf):
    t = _docs(spark, sf).select(F.explode_outer(tx.meaningful_tokens(F.col("text"))).alias("token")).where("token IS NOT NULL")
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("docs")).withColumn(
        "stem", tx.light_stem(F.col("token"))
    )


@query(
    "text_billing_subjects",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'owner:' || left(sha256(c_name), 16)
      ELSE 'key:' || left(sha256('k' || c_custkey), 16) END AS subject FROM customer""",
)
def text_billing_subjects(spark, sf):
    c = ad.table(spark, sf, "customer")
    email = F.when(F.col("c_custkey") % 3 != 0, F.col("c_name"))
    key = F.concat(F.lit("k"), F.col("c_custkey").cast("string"))
    return c.select("c_custkey", tx.billing_subject(email, key).alias("subject"))


@query(
    "text_hashed_identifiers",
    """SELECT page_id, sha256(url) AS site, 'key:' || left(sha256(url), 16) AS ident FROM pages""",
)
def text_hashed_identifiers(spark, sf):
    return ad.table(spark, sf, "pages").select(
        "page_id", tx.hash_site(F.col("url")).alias("site"), tx.hash_identifier(F.col("url")).alias("ident")
    )


@query(
    "text_drop_noise",
    f"""SELECT doc_id FROM documents WHERE NOT (length(trim(text)) < 6 OR {_you('text', lx.NOISE_FRAGMENTS)}
      OR ({_starts('lower(trim(text))', lx.QUESTION_ONLY_STARTS)} AND length(trim(text)) < 80))""",
)
def text_drop_noise(spark, sf):
    return _docs(spark, sf).where(~tx.is_noise(F.col("text"))).select("doc_id")


@query(
    "text_clip_events",
    """SELECT page_id, left(trim(url), 512) AS page, left(trim(html), 512) AS ref FROM pages WHERE trim(url) <> ''""",
)
def text_clip_events(spark, sf):
    p = ad.table(spark, sf, "pages").select(
        "page_id", tx.clip(F.col("url"), 512).alias("page"), tx.clip(F.col("html"), 512).alias("ref")
    )
    return p.where(F.col("page") != "")


@query(
    "text_personal_facts",
    o.sql("memories", """SELECT namespace, seq, text, rank FROM (SELECT namespace, seq, text,
      row_number() OVER (PARTITION BY namespace ORDER BY seq DESC) AS rank FROM memories
      WHERE length(text) BETWEEN 8 AND 300 AND text NOT LIKE '[%' AND text NOT LIKE '%?'
      AND text NOT LIKE 'Stop hook%' AND text NOT LIKE 'You said%') WHERE rank <= 20"""),
)
def text_personal_facts(spark, sf):
    from recallflow.operators.recall import personal_facts

    return personal_facts(ad.memories(spark, sf), 20).select("namespace", "seq", "text", "rank")
