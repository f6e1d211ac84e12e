"""Queries over temporal text, event threads, session topics and embedding spaces."""

from pyspark.sql import functions as F

from recallflow.functions import lexicon as lx
from recallflow.functions import temporal as tp
from recallflow.functions import text as tx
from recallflow.operators import corpus as cp
from recallflow.operators import embeddings as em
from recallflow.operators import sessions as ss
from recallflow.operators import threads as th
from recallflow.plans import oracle as o
from recallflow.plans.queries_entities import prompt_items
from recallflow.plans.registry import query
from recallflow.session import stored
from recallflow.sources import adapters as ad

# --- temporal text: phrases derived from orders and events ------------------


_WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_DAY, _MONTH = "'%-d %B %Y'", "'%B %Y'"


def _day(n):
    return f"strftime(d + to_days(CAST({n} AS INTEGER)), {_DAY})"


def _expressions():
    """(expression, word before the date, date as SQL over ``d``): all kinds, each once a form."""
    out = [
        ("the day before yesterday", "on", _day(-2)), ("the day after tomorrow", "on", _day(2)), ("yesterday", "on", _day(-1)), ("TODAY", "on", _day(0)),
        ("tomorrow", "on", _day(1)), ("tonight", "on", _day(0)), ("in a week", "on", _day(7)), ("in a  month", "on", _day(30)),
        ("last week", "the week of", _day(-7)), ("this week", "the week of", _day(0)), ("next week", "the week of", _day(7)),
        ("last year", "in", "(year(d) - 1)::VARCHAR"), ("this year", "in", "year(d)::VARCHAR"), ("next year", "in", "(year(d) + 1)::VARCHAR"),
        ("this month", "in", f"strftime(d, {_MONTH})"),
        ("next month", "in", f"CASE WHEN day(d + INTERVAL 1 MONTH) = day(d) THEN strftime(d + INTERVAL 1 MONTH, {_MONTH}) END"),
        ("last month", "in", f"CASE WHEN day(d - INTERVAL 1 MONTH) = day(d) THEN strftime(d - INTERVAL 1 MONTH, {_DAY}) END"),
        ("last weekend", "the week of", _day("-((isodow(d) + 1) % 7) - CASE WHEN isodow(d) = 6 THEN 7 ELSE 0 END")),
        ("this weekend", "the week of", _day("CASE WHEN isodow(d) = 6 THEN 7 ELSE (13 - isodow(d)) % 7 END")),
        ("next weekend", "the week of", _day("7 + CASE WHEN isodow(d) = 6 THEN 7 ELSE (13 - isodow(d)) % 7 END")),
    ]
    out += [(f"this {p}", "on", _day(0)) for p in ("morning", "afternoon", "evening")]
    for n in (1, 2, 13):
        out += [(f"{n} day{'s' * (n > 1)} ago", "on", _day(-n)), (f"{n} weeks ago", "on", _day(-7 * n)), (f"in {n} days", "on", _day(n)), (f"in {n} week", "on", _day(7 * n))]
        out += [(f"{n} months ago", "on", f"CASE WHEN day(d - INTERVAL {n} MONTH) = day(d) THEN strftime(d - INTERVAL {n} MONTH, {_DAY}) END")]
    for i, name in enumerate(_WEEKDAYS, 1):
        back, ahead = f"-coalesce(nullif((isodow(d) - {i} + 7) % 7, 0), 7)", f"coalesce(nullif(({i} - isodow(d) + 7) % 7, 0), 7)"
        out += [(f"last {name}", "on", _day(back)), (f"this {name}", "on", _day(ahead)), (f"next {name[:3]}", "on", _day(ahead))]
    for i, name in enumerate(_MONTHS, 1):
        title, after, before = name.capitalize(), f"year(d) + (month(d) >= {i})::INT", f"year(d) - (month(d) <= {i})::INT"
        out += [(f"in {name}", "in", f"'{title} ' || ({after})"), (f"in {name[:3]}", "in" if name == "may" else "on", f"'{title} ' || ({after})")]
        out += [(f"next {name}", "in" if i < 3 else "on", f"'{title} ' || ({after})"), (f"last {name}", "in" if i == 1 else "on", f"'{title} ' || ({before})")]
    return out


_FORMS = ["met {0}.", "{0}, or not", "no date, then {0} and more {1}", "it was not in {1} {0}"]


def _said(expr, word, date):
    """SQL for the replaced and the annotated expression; without a day both stay as said."""
    return f"coalesce('{word} ' || {date}, '{expr}')", f"coalesce('{expr} [' || {date} || ']', '{expr}')"


def _phrases(spark, sf):
    """One sentence per order, every expression in turn; the order date is the reference."""
    texts = [form.format(e, "2021") for form in _FORMS for e, _, _ in _expressions()]
    k = F.col("o_orderkey") % len(texts)
    return ad.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("ref"), F.get(F.array(*[F.lit(t) for t in texts]), k.cast("int")).alias("text")
    )


def _phrases_sql(which):
    forms = [form.format("' || x || '", "2021") for form in _FORMS]
    n = len(_expressions())
    cases = " ".join(f"WHEN {i} THEN {_said(*e)[which]}" for i, e in enumerate(_expressions()))
    whole = " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(forms))
    return f"""WITH o AS (SELECT o_orderkey, o_orderkey % {n * len(forms)} AS k, o_orderdate::DATE AS d FROM orders),
x AS (SELECT o_orderkey, k, CASE k % {n} {cases} END AS x FROM o)
SELECT o_orderkey, CASE k // {n} {whole} END AS text FROM x"""


@query("temporal_resolve_dates", _phrases_sql(0))
def temporal_resolve_dates(spark, sf):
    return _phrases(spark, sf).select("o_orderkey", tp.resolve_dates(F.col("text"), F.col("ref")).alias("text"))


@query("temporal_annotate_dates", _phrases_sql(1))
def temporal_annotate_dates(spark, sf):
    return _phrases(spark, sf).select("o_orderkey", tp.annotate_dates(F.col("text"), F.col("ref")).alias("text"))


@query("temporal_event_date", f"""SELECT o_orderkey, strftime(CASE o_orderkey % 4 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate WHEN 2 THEN date_trunc('month', o_orderdate) ELSE date_trunc('year', o_orderdate) END, '%Y-%m-%d') AS day FROM orders""")
def temporal_event_date(spark, sf):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    forms = F.array(
        F.concat(F.lit("on "), F.date_format(d, "d MMMM yyyy"), F.lit(" we met")), F.concat(F.lit("at "), F.date_format(d, "yyyy-MM-dd")),
        F.concat(F.lit("in "), F.date_format(d, "MMMM yyyy")), F.concat(F.lit("year "), F.date_format(d, "yyyy")),
    )
    t = ad.table(spark, sf, "orders").select("o_orderkey", F.get(forms, (k % 4).cast("int")).alias("text"))
    return t.select("o_orderkey", F.date_format(tp.event_date(F.col("text"), F.lit(None).cast("timestamp")), "yyyy-MM-dd").alias("day"))


@query("temporal_time_filter", """SELECT o_orderkey, strftime(CASE o_orderkey % 4 WHEN 0 THEN date_trunc('day', o_orderdate - to_days(CAST(o_orderkey % 50 AS INTEGER))) WHEN 1 THEN o_orderdate - to_days(7)
  WHEN 2 THEN o_orderdate - to_days(CAST(o_orderkey % 6 * 30 + 15 AS INTEGER)) END, '%Y-%m-%d') AS start, CASE o_orderkey % 4 WHEN 0 THEN greatest(o_orderkey % 50, 1) WHEN 1 THEN 7 WHEN 2 THEN o_orderkey % 6 * 30 ELSE 90 END::DOUBLE AS half_life,
  CASE o_orderkey % 4 WHEN 0 THEN 'range' WHEN 1 THEN 'recent' WHEN 2 THEN 'range' ELSE 'none' END AS signal, CASE o_orderkey % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.5 WHEN 2 THEN 0.35 ELSE 0.1 END::DOUBLE AS alpha FROM orders""")
def temporal_time_filter(spark, sf):
    k = F.col("o_orderkey")
    forms = F.array(F.format_string("what did I do %d days ago?", k % 50), F.lit("what happened LAST week"), F.format_string("meeting %d months ago", k % 6), F.lit("what are my hobbies"))
    t = ad.table(spark, sf, "orders").select("o_orderkey", tp.time_filter_of(F.get(forms, (k % 4).cast("int")), F.col("o_orderdate")).alias("f"))
    return t.select("o_orderkey", F.date_format("f.tf_start", "yyyy-MM-dd").alias("start"), F.col("f.tf_half_life").alias("half_life"), F.col("f.tf_signal").alias("signal"), F.col("f.tf_alpha").alias("alpha"))


@query("temporal_date_label", "SELECT o_orderkey, strftime(o_orderdate, '%-d %B %Y (%A)') AS label FROM orders")
def temporal_date_label(spark, sf):
    return ad.table(spark, sf, "orders").select("o_orderkey", tp.date_label(F.col("o_orderdate")).alias("label"))


def _events_text(spark, sf):
    """Part orders told as events: the part name is what happened."""
    li = ad.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    p = ad.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand")
    return li.join(p, "l_partkey").select(
        F.col("p_brand").alias("namespace"), F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("mem_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("I went to the "), F.element_at(F.split("p_name", " "), -1)).alias("text"), F.col("l_shipdate").alias("event_at"),
    )


_EV = """ev AS (SELECT p_brand AS namespace, l_orderkey * 10 + l_linenumber AS seq, string_split(p_name, ' ')[-1] AS noun, l_shipdate FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query("threads_events", o.sql("", """SELECT namespace, 'i went to the ' || noun AS event, count(DISTINCT CAST(l_shipdate AS DATE)) AS dates, min(CAST(l_shipdate AS DATE)) AS first_date FROM ev
  GROUP BY namespace, noun HAVING count(*) > 1 AND count(DISTINCT CAST(l_shipdate AS DATE)) >= 2""", _EV))
def threads_events(spark, sf):
    t = th.event_threads(_events_text(spark, sf))
    return t.select("namespace", "event", F.size("dates").cast("bigint").alias("dates"), F.col("dates")[0].alias("first_date"))


@query("threads_hits", o.sql("", """SELECT p_partkey AS query_id, p_brand AS namespace, '[Frequency] i went to the ' || noun || ': ' || len(ds) || ' times. Most recent: ' ||
  array_to_string(list_transform(ds[-3:], lambda x: strftime(x, '%-d %B %Y')), ', ') AS text, len(ds)::INT AS times FROM part JOIN
  (SELECT namespace, noun, list_sort(list(DISTINCT CAST(l_shipdate AS DATE))) AS ds FROM ev GROUP BY 1, 2) t ON t.namespace = p_brand AND noun = string_split(p_name, ' ')[-1] WHERE len(ds) >= 2""", _EV))
def threads_hits(spark, sf):
    e = _events_text(spark, sf)
    q = ad.table(spark, sf, "part").select(
        F.col("p_partkey").alias("query_id"), F.col("p_brand").alias("namespace"), F.concat(F.lit("how many times did I visit the "), F.col("p_name")).alias("text")
    )
    return th.thread_hits(q, stored(th.event_threads(e)), "2002-01-01 00:00:00").select("query_id", "namespace", "text", "times")


# --- sessions --------------------------------------------------------------


def _idf(spark, sf):
    p = ad.prompt_log(spark, sf).select("namespace", F.concat_ws("/", "session_id", "sequence_num").alias("mem_id"), F.col("content").alias("text"))
    return cp.token_weights(cp.token_df(cp.item_tokens(p)), cp.namespace_size(p))


_P = "p AS (SELECT namespace, session_id, sequence_num, created_at, role, content AS text, content AS head FROM prompt_log)"
_PT = o.tokens("tok", "p", "namespace, session_id, sequence_num")
_HT = o.tokens("ht", "p", "namespace, session_id, sequence_num", "head")
_IDF = """idf AS (SELECT namespace, token, ln(1 + n / (1.0::DOUBLE + df)) AS idf FROM (SELECT namespace, token, count(*) AS df FROM tok GROUP BY 1, 2) JOIN (SELECT namespace, count(*) AS n FROM p GROUP BY 1) USING (namespace))"""
_SPEC = """pk AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, sequence_num) AS k, count(*) OVER (PARTITION BY session_id) AS n FROM p),
sp AS (SELECT * FROM (SELECT namespace, session_id, token, sum(idf * exp(-(n - k + 1) / 10.0::DOUBLE)) AS weight FROM ht JOIN pk USING (namespace, session_id, sequence_num) JOIN idf USING (namespace, token) GROUP BY 1, 2, 3) WHERE weight >= 0.01)"""
_COUP = """sv AS (SELECT namespace, session_id, token, weight * ln(1 + n / (1.0::DOUBLE + sdf)) AS v FROM sp JOIN (SELECT namespace, token, count(*) AS sdf FROM sp GROUP BY 1, 2) USING (namespace, token)
  JOIN (SELECT namespace, count(DISTINCT session_id) AS n FROM sp GROUP BY 1) USING (namespace)), nm AS (SELECT namespace, session_id, sum(v * v) AS m FROM sv GROUP BY 1, 2),
co AS (SELECT a.namespace, a.session_id AS session_a, b.session_id AS session_b, sum(pow(least(a.v, b.v), 2)) / sqrt(max(x.m) * max(y.m)) AS coupling FROM sv a JOIN sv b ON a.namespace = b.namespace AND a.token = b.token AND a.session_id < b.session_id
  JOIN nm x ON x.namespace = a.namespace AND x.session_id = a.session_id JOIN nm y ON y.namespace = b.namespace AND y.session_id = b.session_id GROUP BY 1, 2, 3)"""


@query("sessions_spectrum", o.sql("prompt_log", "SELECT namespace, session_id, token, round(weight, 5) AS weight FROM sp", _P, _PT, _HT, _IDF, _SPEC))
def sessions_spectrum(spark, sf):
    return ss.topic_spectrum(ad.prompt_log(spark, sf), _idf(spark, sf)).withColumn("weight", F.round("weight", 5))


@query("sessions_df", o.sql("prompt_log", "SELECT namespace, token, count(*) AS sdf FROM sp GROUP BY 1, 2", _P, _PT, _HT, _IDF, _SPEC))
def sessions_df(spark, sf):
    return ss.session_df(ss.topic_spectrum(ad.prompt_log(spark, sf), _idf(spark, sf)))


@query("sessions_info", o.sql("prompt_log", """SELECT namespace, session_id, n AS prompt_count, round(coalesce(omega, 0), 5) AS omega FROM (SELECT namespace, session_id, count(*) AS n FROM p GROUP BY 1, 2) LEFT JOIN
  (SELECT session_id AS sid, -sum(weight / t * log2(weight / t)) AS omega FROM sp JOIN (SELECT session_id, sum(weight) AS t FROM sp GROUP BY 1) USING (session_id) GROUP BY 1) ON sid = session_id""", _P, _PT, _HT, _IDF, _SPEC))
def sessions_info(spark, sf):
    p = ad.prompt_log(spark, sf)
    i = ss.session_info(p, ss.topic_spectrum(p, _idf(spark, sf)))
    return i.select("namespace", "session_id", "prompt_count", F.round("omega", 5).alias("omega"))


def _spectrum(spark, sf):
    return stored(ss.topic_spectrum(ad.prompt_log(spark, sf), _idf(spark, sf)))


@query("sessions_coupling", o.sql("prompt_log", "SELECT namespace, session_a, session_b, round(coupling, 5) AS coupling FROM co", _P, _PT, _HT, _IDF, _SPEC, _COUP))
def sessions_coupling(spark, sf):
    return ss.session_coupling(_spectrum(spark, sf)).withColumn("coupling", F.round("coupling", 5))


def _recalled(spark, sf):
    p = ad.prompt_log(spark, sf)
    asks = p.where("role = 'user'").select(F.concat_ws("/", "session_id", "sequence_num").alias("query_id"), "namespace", "session_id", F.col("content").alias("text"))
    idf = stored(_idf(spark, sf))
    # Only sessions with fresh prompts are recalled, and only those coupled enough.
    now, enough = "2024-01-01 08:00:00", 0.01
    c = stored(ss.session_coupling(_spectrum(spark, sf), asks, enough, ss.fresh_prompts(p, now)))
    return ss.cross_session_recall(asks, p, idf, c, now, 10, k_critical=enough)


_RECALL = """ring AS (SELECT * FROM p WHERE role = 'user'
  AND date_diff('second', created_at, TIMESTAMP '2024-01-01 08:00:00') BETWEEN 0 AND 3600),
ask AS (SELECT session_id || '/' || sequence_num AS query_id, namespace, session_id, sequence_num FROM p WHERE role = 'user'),
cc AS (SELECT namespace, session_a, session_b, coupling FROM co UNION ALL SELECT namespace, session_b, session_a, coupling FROM co),
qt AS (SELECT query_id, a.namespace, a.session_id, token, count(*) OVER (PARTITION BY query_id) AS nq FROM ask a JOIN tok t ON t.session_id = a.session_id AND t.sequence_num = a.sequence_num),
rs AS (SELECT query_id, g.session_id, g.sequence_num, sum(idf) / sqrt(max(nq)) * max(coupling) / 0.01 * exp(-max(date_diff('second', g.created_at, TIMESTAMP '2024-01-01 08:00:00')) / 300.0::DOUBLE) AS score
  FROM qt q JOIN cc ON cc.namespace = q.namespace AND cc.session_a = q.session_id AND coupling >= 0.01 JOIN ring g ON g.namespace = q.namespace AND g.session_id = cc.session_b
  JOIN ht h ON h.session_id = g.session_id AND h.sequence_num = g.sequence_num AND h.token = q.token JOIN idf ON idf.namespace = q.namespace AND idf.token = q.token GROUP BY 1, 2, 3)"""


@query("sessions_cross_recall", o.sql("prompt_log", """SELECT query_id, session_id, sequence_num, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, session_id, sequence_num) AS r
  FROM rs WHERE score > 0.01) WHERE r <= 10""", _P, _PT, _HT, _IDF, _SPEC, _COUP, _RECALL))
def sessions_cross_recall(spark, sf):
    return _recalled(spark, sf).select("query_id", "session_id", "sequence_num", F.round("score", 5).alias("score"))


_LEAD = "cv0 AS (SELECT 'u' || conv_id % 10 AS namespace, conv_id * 1000 + turn AS seq, text FROM conversations), " + o.ordered_tokens("ot", "cv0", "namespace, seq").strip()


@query("sessions_reinforce", o.sql("prompt_log", """SELECT namespace, seq, count(*) AS hits FROM (SELECT t.query_id, t.namespace, t.r, l.seq, count(*) AS k, max(t.n) AS n FROM
  (SELECT q.*, h.token, count(*) OVER (PARTITION BY q.query_id, q.r) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, session_id, sequence_num) AS r FROM
    (SELECT rs.*, ask.namespace FROM rs JOIN ask USING (query_id) WHERE score > 0.01)) q JOIN ht h ON h.session_id = q.session_id AND h.sequence_num = q.sequence_num AND h.namespace = q.namespace WHERE q.r <= 5) t
  JOIN ot l ON l.namespace = t.namespace AND l.token = t.token AND l.r <= 10 GROUP BY 1, 2, 3, 4) WHERE k > 0.3::DOUBLE * n GROUP BY 1, 2""", _P, _PT, _HT, _IDF, _SPEC, _COUP, _RECALL, _LEAD))
def sessions_reinforce(spark, sf):
    return ss.reinforce_from_sessions(_recalled(spark, sf), prompt_items(spark, sf))


@query("sessions_active", o.sql("prompt_log", """SELECT session_id, sequence_num FROM prompt_log WHERE session_id IN (SELECT session_id FROM prompt_log GROUP BY 1
  HAVING max(created_at) >= TIMESTAMP '2024-01-01 09:00:00' - INTERVAL 7200 SECOND)"""))
def sessions_active(spark, sf):
    return ss.active_sessions(ad.prompt_log(spark, sf), "2024-01-01 09:00:00").select("session_id", "sequence_num")


@query("sessions_report", o.sql("prompt_log", """SELECT namespace, session_id, n AS prompt_count, t AS top_tokens FROM (SELECT namespace, session_id, count(*) AS n FROM p GROUP BY 1, 2) LEFT JOIN
  (SELECT namespace, session_id, string_agg(token, ' ' ORDER BY r) AS t FROM (SELECT *, row_number() OVER (PARTITION BY namespace, session_id ORDER BY round(weight, 6) DESC, token) AS r FROM sp) WHERE r <= 10 GROUP BY 1, 2) USING (namespace, session_id)""",
  _P, _PT, _HT, _IDF, _SPEC))
def sessions_report(spark, sf):
    p, s = ad.prompt_log(spark, sf), _spectrum(spark, sf)
    top, _ = ss.session_report(ss.session_info(p, s), s, ss.session_coupling(s))
    return top.select("namespace", "session_id", "prompt_count", F.array_join("top_tokens", " ").alias("top_tokens"))


@query("sessions_pairs", o.sql("prompt_log", f"SELECT namespace, session_a, session_b, round(coupling, 5) AS coupling, coupling >= {lx.K_CRITICAL} AS synchronized FROM co", _P, _PT, _HT, _IDF, _SPEC, _COUP))
def sessions_pairs(spark, sf):
    p, s = ad.prompt_log(spark, sf), _spectrum(spark, sf)
    _, pairs = ss.session_report(ss.session_info(p, s), s, ss.session_coupling(s))
    return pairs.select("namespace", "session_a", "session_b", F.round("coupling", 5).alias("coupling"), "synchronized")


@query("sessions_coupled", o.sql("prompt_log", f"SELECT namespace, session_a, session_b, round(coupling, 5) AS coupling FROM co WHERE coupling >= {lx.K_CRITICAL}", _P, _PT, _HT, _IDF, _SPEC, _COUP))
def sessions_coupled(spark, sf):
    return ss.coupled_sessions(_spectrum(spark, sf)).withColumn("coupling", F.round("coupling", 5))


@query("sessions_list", o.sql("prompt_log", """SELECT namespace, session_id, n AS message_count FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY last_at DESC, session_id) AS r FROM
  (SELECT namespace, session_id, max(created_at) AS last_at, count(*) AS n FROM prompt_log GROUP BY 1, 2)) WHERE r <= 5"""))
def sessions_list(spark, sf):
    return ss.sessions_list(ad.prompt_log(spark, sf), "namespace", 5).select("namespace", "session_id", "message_count")


@query("sessions_messages", o.sql("prompt_log", "SELECT sequence_num, role, md5(content) AS content_md5 FROM prompt_log WHERE session_id = 's1' ORDER BY sequence_num LIMIT 100"))
def sessions_messages(spark, sf):
    return ss.session_messages(ad.prompt_log(spark, sf), "s1").select("sequence_num", "role", F.md5("content").alias("content_md5"))


@query("sessions_timeline", o.sql("prompt_log", """SELECT session_id, sequence_num FROM prompt_log WHERE namespace = 'u3' AND created_at < TIMESTAMP '2024-01-01 06:00:00' ORDER BY created_at DESC, session_id, sequence_num DESC LIMIT 30"""))
def sessions_timeline(spark, sf):
    return ss.timeline(ad.prompt_log(spark, sf), "u3", "2024-01-01 06:00:00", 30).select("session_id", "sequence_num")


@query("sessions_context_log", o.sql("prompt_log", """SELECT namespace, md5(left(content, 500)) AS query_md5, 3 AS memory_count FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY created_at DESC, session_id, sequence_num) AS r FROM prompt_log) WHERE r <= 5"""))
def sessions_context_log(spark, sf):
    c = ad.prompt_log(spark, sf).select(
        "namespace", F.col("content").alias("query"), "session_id", "sequence_num", "created_at",
        F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("memories_sent"), F.array(F.lit("1"), F.lit("2"), F.lit("3")).alias("memory_ids"),
    )
    log = ss.context_log_rows(c).withColumn("created_at", F.struct("created_at", F.hash("session_id")).getField("created_at"))
    from recallflow.operators.scans import top_k

    read = top_k(log, ["namespace"], [F.desc("created_at"), F.asc("session_id"), F.asc("sequence_num")], 5)
    return read.select("namespace", F.md5("query").alias("query_md5"), "memory_count")


# --- embedding spaces ------------------------------------------------------


def _uv(spark, sf):
    """Newest vector per user and token."""
    return ad.user_vectors(spark, sf).groupBy("user_id", "token").agg(F.max_by("vec", "epoch").alias("vec"), F.max("doc_count").alias("doc_count"))


_UV = "u AS (SELECT user_id, token, arg_max(vec, epoch) AS vec FROM user_vectors GROUP BY 1, 2)"
_SUM = """ud AS (SELECT token, i, sum(v) AS s FROM (SELECT token, unnest(vec) AS v, generate_subscripts(vec, 1) AS i FROM u) GROUP BY 1, 2),
cv AS (SELECT token, i, s / sqrt(sum(s * s) OVER (PARTITION BY token)) AS v FROM ud)"""


def _whole(vec):
    """All elements of a vector, rounded, as one digest."""
    return F.md5(F.array_join(F.transform(vec, lambda x: F.format_string("%.4f", F.round(x, 4) + F.lit(0.0))), " "))


_ALL = "md5(string_agg(printf('%.4f', round(v, 4) + 0.0), ' ' ORDER BY i))"


@query("embeddings_collective", o.sql("user_vectors", f"SELECT token, (SELECT count(*) FROM u WHERE u.token = c.token) AS contributors, {_ALL} AS vec_md5 FROM cv c GROUP BY 1", _UV, _SUM))
def embeddings_collective(spark, sf):
    return em.collective_vectors(_uv(spark, sf), 64).select("token", "contributors", _whole("vec").alias("vec_md5"))


def _near_vectors(spark, sf):
    """Vectors pulled towards their label's first vector so that neighbourhoods exist."""
    v = ad.user_vectors(spark, sf).groupBy("user_id", "token").agg(F.max_by("vec", "epoch").alias("vec"))
    base = v.where("token = 't1'").select("user_id", F.col("vec").alias("_b"))
    mixed = F.zip_with("vec", "_b", lambda a, b: a + 1.5 * b)
    return v.join(base, "user_id").select("user_id", "token", mixed.alias("vec"))


_NV = """nv AS (SELECT a.user_id, a.token, list_transform(list_zip(a.vec, b.vec), lambda z: z[1] + 1.5 * z[2]) AS vec FROM u a JOIN u b ON a.user_id = b.user_id AND b.token = 't1'),
nb AS (SELECT a.user_id, a.token, b.token AS neighbor FROM nv a JOIN nv b ON a.user_id = b.user_id AND a.token <> b.token WHERE list_cosine_similarity(a.vec, b.vec) >= 0.65)"""


@query("embeddings_neighborhoods", o.sql("user_vectors", "SELECT user_id, token, neighbor FROM nb", _UV, _NV))
def embeddings_neighborhoods(spark, sf):
    return em.neighborhoods(_near_vectors(spark, sf))


_SYN = """sz AS (SELECT user_id, token, count(*) AS n FROM nb GROUP BY 1, 2), sh AS (SELECT a.user_id AS ua, b.user_id AS ub, a.token AS ta, b.token AS tb, count(*) AS k FROM nb a JOIN nb b ON a.neighbor = b.neighbor AND a.user_id < b.user_id AND a.token <> b.token GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2),
sy AS (SELECT least(ta, tb) AS token_a, greatest(ta, tb) AS token_b, avg(j) AS similarity, count(*) AS confirmations FROM (SELECT ta, tb, k / (x.n + y.n - k)::DOUBLE AS j FROM sh JOIN sz x ON x.user_id = ua AND x.token = ta JOIN sz y ON y.user_id = ub AND y.token = tb) WHERE j >= 0.3 GROUP BY 1, 2)"""


def _syn(spark, sf):
    return em.discover_synonyms(stored(em.neighborhoods(_near_vectors(spark, sf))), 1.0)


@query("embeddings_synonyms", o.sql("user_vectors", "SELECT token_a, token_b, round(similarity, 6) AS similarity, confirmations, round(least(confirmations / 3.0, 1.0), 6) AS confidence FROM sy", _UV, _NV, _SYN))
def embeddings_synonyms(spark, sf):
    return _syn(spark, sf).select("token_a", "token_b", F.round("similarity", 6).alias("similarity"), "confirmations", F.round("confidence", 6).alias("confidence"))


@query("embeddings_merge_synonyms", o.sql("user_vectors", "SELECT token_a, token_b, round(similarity, 6) AS similarity, confirmations * 2 AS confirmations FROM sy", _UV, _NV, _SYN))
def embeddings_merge_synonyms(spark, sf):
    s = stored(_syn(spark, sf))
    return em.merge_synonyms(s, s).select("token_a", "token_b", F.round("similarity", 6).alias("similarity"), "confirmations")


@query("embeddings_expand_query", o.sql("user_vectors", """SELECT user_id AS query_id, token FROM (SELECT DISTINCT user_id, token FROM user_vectors) UNION
  SELECT DISTINCT user_id, synonym FROM user_vectors JOIN (SELECT *, row_number() OVER (PARTITION BY token ORDER BY similarity DESC, synonym) AS r FROM
  (SELECT token_a AS token, token_b AS synonym, similarity FROM sy WHERE confirmations >= 3 UNION ALL SELECT token_b, token_a, similarity FROM sy WHERE confirmations >= 3)) USING (token) WHERE r <= 8""", _UV, _NV, _SYN))
def embeddings_expand_query(spark, sf):
    q = ad.user_vectors(spark, sf).select(F.col("user_id").alias("query_id"), "token").distinct()
    return em.expand_query(q, stored(_syn(spark, sf)))


_BLEND = """bl AS (SELECT user_id, token, i, b / sqrt(sum(b * b) OVER (PARTITION BY user_id, token)) AS v FROM
  (SELECT user_id, token, i, 0.8 * x + 0.2 * cv.v AS b FROM (SELECT user_id, token, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM u) JOIN cv USING (token, i)))"""


@query("embeddings_blend", o.sql("user_vectors", f"SELECT user_id, token, {_ALL} AS vec_md5 FROM bl GROUP BY 1, 2", _UV, _SUM, _BLEND))
def embeddings_blend(spark, sf):
    uv = _uv(spark, sf)
    c = em.collective_vectors(uv, 64)
    grown = em.blend_vectors(uv, uv.select("user_id", "token").join(c, "token"), ["user_id", "token"], 64)
    return grown.select("user_id", "token", _whole("vec").alias("vec_md5"))


@query("embeddings_broadcast", o.sql("user_vectors", f"""SELECT user_id, token, {_ALL} AS vec_md5 FROM (SELECT user_id, token, i, v FROM bl UNION ALL
  SELECT w.user_id, cv.token, cv.i, cv.v FROM (SELECT DISTINCT user_id FROM u) w, cv WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.user_id = w.user_id AND u.token = cv.token)) GROUP BY 1, 2""", _UV, _SUM, _BLEND))
def embeddings_broadcast(spark, sf):
    uv = _uv(spark, sf)
    return em.broadcast_vectors(uv, em.collective_vectors(uv, 64), 64).select("user_id", "token", _whole("vec").alias("vec_md5"))


_DR = """dr AS (SELECT user_id, token, epoch, 1 - list_cosine_similarity(lag(vec) OVER w, vec) AS drift, lag(doc_count) OVER w AS from_count, doc_count AS to_count FROM user_vectors WINDOW w AS (PARTITION BY user_id, token ORDER BY epoch))"""


@query("embeddings_drift_events", o.sql("user_vectors", "SELECT user_id, token, epoch, round(drift, 6) AS drift, from_count, to_count FROM dr WHERE drift >= 0.3", _DR))
def embeddings_drift_events(spark, sf):
    return em.drift_events(ad.user_vectors(spark, sf)).withColumn("drift", F.round("drift", 6))


@query("embeddings_drift_trajectory", o.sql("user_vectors", "SELECT user_id, token, epoch, round(sum(coalesce(drift, 0)) OVER (PARTITION BY user_id, token ORDER BY epoch), 6) AS cumulative FROM dr", _DR))
def embeddings_drift_trajectory(spark, sf):
    return em.drift_trajectory(ad.user_vectors(spark, sf)).withColumn("cumulative", F.round("cumulative", 6))


@query("embeddings_most_drifted", o.sql("user_vectors", """SELECT user_id, token, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, token) AS r FROM
  (SELECT user_id, token, sum(drift) AS total FROM dr WHERE drift IS NOT NULL GROUP BY 1, 2)) WHERE r <= 5""", _DR))
def embeddings_most_drifted(spark, sf):
    return em.most_drifted(ad.user_vectors(spark, sf), 5).select("user_id", "token", F.round("total", 6).alias("total"))


@query("embeddings_recent_drift", o.sql("user_vectors", "SELECT user_id, token, epoch FROM dr WHERE drift >= 0.3 ORDER BY epoch DESC, user_id, token LIMIT 20", _DR))
def embeddings_recent_drift(spark, sf):
    return em.recent_drift(em.drift_events(ad.user_vectors(spark, sf))).select("user_id", "token", "epoch")


def _generations(spark, sf):
    c = ad.user_vectors(spark, sf).withColumn("epoch", F.col("epoch") * em.YEAR_SECONDS / 10)
    return em.generational_fold(c, 64)


@query("embeddings_generations", o.sql("user_vectors", """SELECT token, count(*) AS contributors, round(min(epoch) / 10, 4) AS first_year, round(max(epoch) / 10, 4) AS last_year FROM user_vectors GROUP BY 1"""))
def embeddings_generations(spark, sf):
    g = _generations(spark, sf)
    return g.select("token", "contributors", F.round(F.col("first_epoch") / em.YEAR_SECONDS, 4).alias("first_year"), F.round(F.col("last_epoch") / em.YEAR_SECONDS, 4).alias("last_year"))


@query("embeddings_bump_generation", o.sql("user_vectors", "SELECT token, unnest(CASE WHEN token IN (SELECT token FROM dr WHERE drift >= 1.0) THEN [0, 1] ELSE [0] END) AS generation FROM (SELECT DISTINCT token FROM user_vectors)", _DR))
def embeddings_bump_generation(spark, sf):
    g = stored(_generations(spark, sf))
    moved = em.drift_events(ad.user_vectors(spark, sf)).where("drift >= 1.0")
    return em.generation_history(*em.bump_generation(g, moved)).select("token", "generation")


@query("embeddings_prune_bootstrap", o.sql("user_vectors", "SELECT token, count(*) AS n FROM user_vectors GROUP BY 1 HAVING count(*) >= 5"))
def embeddings_prune_bootstrap(spark, sf):
    g = em.prune_generations(stored(_generations(spark, sf)), 60 * em.YEAR_SECONDS)
    return em.bootstrap_vectors(g).join(g.select("token", F.col("contributors").alias("n")), "token").select("token", "n")


def _sync(spark, sf):
    from recallflow.plans.jobs import embedding_sync

    old = ad.user_vectors(spark, sf)
    return embedding_sync(_uv(spark, sf), old, stored(_syn(spark, sf)), old, 1e6, 64)


_SYNC_ROWS = f"""(SELECT token, epoch FROM user_vectors UNION ALL SELECT token, 1000000 FROM (SELECT DISTINCT user_id FROM u), (SELECT DISTINCT token FROM u))"""


@query("jobs_embedding_sync", o.sql("user_vectors", f"""SELECT token, count(*) AS contributors, round(sum(pow(2.0, -((1000000 - epoch) / {em.YEAR_SECONDS}) / {em.HALF_LIFE_YEARS})), 6) AS total_weight
  FROM {_SYNC_ROWS} GROUP BY 1""", _UV))
def jobs_embedding_sync(spark, sf):
    """Generational knowledge after one sync; the other outputs have queries of their own."""
    return _sync(spark, sf)["generations"].select("token", "contributors", F.round("total_weight", 6).alias("total_weight"))


@query("jobs_sync_collective", o.sql("user_vectors", f"SELECT token, {_ALL} AS vec_md5 FROM cv GROUP BY 1", _UV, _SUM))
def jobs_sync_collective(spark, sf):
    return _sync(spark, sf)["collective"].select("token", _whole("vec").alias("vec_md5"))


@query("jobs_sync_snapshots", o.sql("user_vectors", """SELECT user_id, token, epoch FROM user_vectors
  UNION ALL SELECT user_id, token, 1000000 FROM (SELECT DISTINCT user_id FROM u), (SELECT DISTINCT token FROM u)""", _UV))
def jobs_sync_snapshots(spark, sf):
    return _sync(spark, sf)["snapshots"].select("user_id", "token", "epoch")


@query("jobs_sync_drift", o.sql("user_vectors", """SELECT user_id, token, round(d, 6) AS drift FROM (SELECT user_id, token, 1 - list_cosine_similarity(u.vec, b.vec) AS d FROM u
  JOIN (SELECT user_id, token, list(v ORDER BY i) AS vec FROM bl GROUP BY 1, 2) b USING (user_id, token)) WHERE d >= 0.3""", _UV, _SUM, _BLEND))
def jobs_sync_drift(spark, sf):
    return _sync(spark, sf)["drift"].select("user_id", "token", F.round("drift", 6).alias("drift"))


@query("jobs_sync_vectors", o.sql("user_vectors", f"""SELECT user_id, token, {_ALL} AS vec_md5 FROM (SELECT user_id, token, i, v FROM bl UNION ALL
  SELECT w.user_id, cv.token, cv.i, cv.v FROM (SELECT DISTINCT user_id FROM u) w, cv WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.user_id = w.user_id AND u.token = cv.token)) GROUP BY 1, 2""", _UV, _SUM, _BLEND))
def jobs_sync_vectors(spark, sf):
    return _sync(spark, sf)["vectors"].select("user_id", "token", _whole("vec").alias("vec_md5"))


@query("jobs_sync_synonyms", o.sql("user_vectors", f"""SELECT token_a, token_b, CAST(sum(confirmations) AS BIGINT) AS confirmations, round(sum(similarity * confirmations) / sum(confirmations), 6) AS similarity
  FROM (SELECT token_a, token_b, similarity, confirmations FROM sy UNION ALL SELECT token_a, token_b, similarity, confirmations FROM sy2) GROUP BY 1, 2""", _UV, _NV, _SYN,
  """nb2 AS (SELECT a.user_id, a.token, b.token AS neighbor FROM u a JOIN u b ON a.user_id = b.user_id AND a.token <> b.token WHERE list_cosine_similarity(a.vec, b.vec) >= 0.65)""",
  _SYN.replace("FROM nb GROUP", "FROM nb2 GROUP").replace("FROM nb a JOIN nb b", "FROM nb2 a JOIN nb2 b").replace("sz AS", "sz2 AS").replace("sh AS", "sh2 AS").replace("sy AS", "sy2 AS").replace("FROM sh JOIN sz x", "FROM sh2 JOIN sz2 x").replace("JOIN sz y", "JOIN sz2 y")))
def jobs_sync_synonyms(spark, sf):
    s = _sync(spark, sf)["synonyms"]
    return s.select("token_a", "token_b", F.col("confirmations").cast("bigint").alias("confirmations"), F.round("similarity", 6).alias("similarity"))


def _cycle(spark, sf, whole=False):
    """Schemas of the prompts, of ``whole`` groups or their first members; half are in L2
    already and a third in L3."""
    from recallflow.operators import schemas as sc
    from recallflow.plans.jobs import sleep_cycle
    from recallflow.plans.queries_entities import _deltas, whole_schemas

    if whole:
        items, schemas = whole_schemas(spark, sf)
    else:
        items, _, _, d = _deltas(spark, sf)
        schemas = stored(sc.build_schemas(d))
    schemas = schemas.withColumn("strength", F.when(F.col("formed") % 5 == 0, 0.02).when(F.col("formed") % 5 == 1, 0.5).otherwise(1.0))
    rows = schemas.select(
        "mem_id", "namespace", F.lit(0).cast("bigint").alias("seq"), F.lit("old").alias("text"), F.lit(0.25).alias("confidence"), F.lit(0.0).alias("salience"),
        F.lit(3).alias("usage_count"), F.lit(2).alias("version"), F.lit(0.5).alias("edge_weight"), "formed",
    )
    return sleep_cycle(items, schemas, rows.where("formed % 2 = 0").drop("formed"), rows.where("formed % 3 = 0").drop("formed"))


def _cycle_parts(whole=False):
    from recallflow.plans import queries_entities as qe

    return [*(qe._WHOLE_DELTAS if whole else qe._DELTAS), qe._BUILT, """cy AS (SELECT *, CASE formed % 5 WHEN 0 THEN 0.02 WHEN 1 THEN 0.5 ELSE 1.0 END AS strength FROM sch),
      ex AS (SELECT * FROM cy WHERE strength >= 0.05), l3n AS (SELECT * FROM ex WHERE strength >= 0.85 AND formed % 3 <> 0)"""]


@query("jobs_sleep_cycle", o.sql("", """SELECT namespace, least(count(*), 50)::BIGINT AS rehearsed, coalesce((SELECT count(*) FROM ex WHERE ex.namespace = f.namespace), 0) AS schemas_exported,
  coalesce((SELECT count(*) FROM l3n WHERE l3n.namespace = f.namespace), 0) AS archived_to_l3 FROM f GROUP BY namespace""", *_cycle_parts(whole=True)))
def jobs_sleep_cycle(spark, sf):
    r = _cycle(spark, sf, whole=True)["report"]
    return r.select("namespace", *[F.col(c).cast("long").alias(c) for c in ("rehearsed", "schemas_exported", "archived_to_l3")])


@query("jobs_sleep_cycle_l2", o.sql("", """SELECT schema_id AS mem_id, namespace, CASE WHEN strength < 0.05 THEN md5('old') ELSE md5('[Schema: ' || subject || '] ' || value) END AS text_md5,
  CAST(CASE WHEN strength < 0.05 THEN 0.25 ELSE strength END AS DOUBLE) AS confidence, CASE WHEN strength < 0.05 THEN 2 WHEN formed % 2 = 0 THEN 3 ELSE 1 END AS version,
  round(CASE WHEN strength < 0.05 THEN 0.5 WHEN formed % 2 = 0 THEN 0.505 ELSE 1.0 END::DOUBLE, 6) AS edge_weight FROM cy WHERE strength >= 0.05 OR formed % 2 = 0""", *_cycle_parts(whole=True)))
def jobs_sleep_cycle_l2(spark, sf):
    out = _cycle(spark, sf, whole=True)["l2"]
    return out.select("mem_id", "namespace", F.md5("text").alias("text_md5"), F.col("confidence").cast("double").alias("confidence"), "version", F.round("edge_weight", 6).alias("edge_weight"))


@query("jobs_sleep_cycle_l3", o.sql("", "SELECT schema_id AS mem_id, namespace, md5('[Schema: ' || subject || '] ' || value) AS text_md5 FROM l3n", *_cycle_parts()))
def jobs_sleep_cycle_l3(spark, sf):
    return _cycle(spark, sf)["l3_new"].select("mem_id", "namespace", F.md5("text").alias("text_md5"))


@query("jobs_sleep_cycle_state", o.sql("", "SELECT namespace, mem_id, CASE WHEN r <= 50 THEN 1 ELSE 0 END AS retrieval_count FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY seq) AS r FROM f)", *_cycle_parts()))
def jobs_sleep_cycle_state(spark, sf):
    return _cycle(spark, sf)["state"].select("namespace", "mem_id", "retrieval_count")


@query("jobs_recall")
def jobs_recall(spark, sf):
    from recallflow.plans.jobs import recall
    from recallflow.plans.queries_recall import _state_items

    m = ad.memories(spark, sf).select("namespace", "mem_id", "event_at", "superseded")
    items = stored(_state_items(spark, sf).join(m, ["namespace", "mem_id"]).withColumn("is_schema", F.col("seq") % 10 == 3))
    v = ad.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    iv = items.select("namespace", "mem_id", (F.col("seq") % 500).alias("vec_id")).join(v, "vec_id").drop("vec_id")
    q = ad.queries(spark, sf)
    qv = q.select("query_id", "namespace", (F.col("query_id") % 500).alias("vec_id")).join(v, "vec_id").drop("vec_id")
    l2 = iv.join(items.where("is_schema").select("namespace", "mem_id"), ["namespace", "mem_id"], "left_semi").withColumn("confidence", F.lit(1.0))
    return recall(q, items, qv, iv, l2, "2024-03-01 00:00:00", 10).select("query_id", "mem_id", "part", "rank")
