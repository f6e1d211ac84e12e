"""License scan by diagonal voting, in DataFrame operations only.

Every rolling pair of words of a text is hashed and joined to the places where the pair
stands in a template; the next pair confirms it for whole license texts. A match votes for
its diagonal, the place in the text less the place in the template. Votes on neighbouring
diagonals (a word more or less) are merged into a span, and a span counts if enough of the
template stands in it closely enough. A phrase needs every vote on one diagonal, which is
its exact presence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallflow.llm.common import ascii_lower

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Texts of public licenses and notices, and labels of our own.
TEXTS = {
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
    "apache-notice": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at"
    ),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-text": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLACK = 4  # words by which merged diagonals may differ, step by step
COVERED = 0.6  # share of a template's places that must be voted for
DENSE = 0.5  # share of a span's places that must hold a vote


def words(text: Column) -> Column:
    """A-Z in lower case, then runs of digits, a-z and everything beyond ASCII."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def _pairs(tokens: str) -> Column:
    """Hash of each word with the word behind it."""
    return F.transform(tokens, lambda w, i: F.xxhash64(w, F.get(F.col(tokens), i + 1)))


def templates(spark: SparkSession) -> DataFrame:
    """(template, label, phrase, places, at, pair, later): one row per place of a template."""
    rows = [(p, label, True) for p, label in PHRASES.items()] + [(t, label, False) for label, t in TEXTS.items()]
    listed = F.array(*[
        F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(phrase).alias("phrase"), words(F.lit(text)).alias("w"))
        for i, (text, label, phrase) in enumerate(rows)
    ])
    each = spark.range(1).select(F.explode(listed).alias("t")).select("t.*").withColumn("g", _pairs("w"))
    places = F.size("w") - F.when(F.col("phrase"), 1).otherwise(3)
    return (
        each.withColumn("places", places).select("template", "label", "phrase", "places", F.col("g"), F.posexplode("g").alias("at", "pair"))
        .where("at < places")
        .withColumn("later", F.when(~F.col("phrase"), F.get("g", F.col("at") + 2))).drop("g")
    )


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row.

    n_base counts the places of all phrases, first_word and last_word are the least and
    greatest start (null if none). Labels are distinct, sorted and comma-joined; an empty
    string if none. score is the largest share of a template that a counted span covers. A
    null or empty text has no words. Matching, voting and counting are one pass over the
    text; all that is shuffled is one row per document and voted diagonal.
    """
    marks = templates(docs.sparkSession)
    tokens = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
    pairs = tokens.select("doc_id", "row", F.size("w").cast("long").alias("n_words"), _pairs("w").alias("g"))
    rolling = pairs.select(
        "doc_id", "row", "n_words",
        F.posexplode_outer(F.transform("g", lambda h, i: F.struct(h.alias("h"), F.get(F.col("g"), i + 2).alias("h2")))).alias("pos", "p"),
    ).select("doc_id", "row", "n_words", "pos", "p.h", "p.h2")
    # the templates are fixed: some hundred rows
    met = rolling.join(
        F.broadcast(marks), (F.col("h") == F.col("pair")) & (F.col("later").isNull() | (F.col("later") == F.col("h2"))), "left"
    )
    votes = met.groupBy("row", "doc_id", "n_words", "template", "label", "phrase", "places", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.count("at").alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high")
    )
    along = W.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(along) > SLACK)
    spans = (
        votes.withColumn("_new", F.when(apart, 1).otherwise(0))
        .withColumn("span", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("row", "doc_id", "n_words", "template", "label", "phrase", "places", "span")
        .agg(F.sum("votes").alias("votes"), F.min("low").alias("low"), F.max("high").alias("high"))
    )
    share = F.least(F.lit(1.0), F.col("votes") / F.col("places"))
    close = F.col("votes") / (F.col("high") - F.col("low") + 1)
    holds = F.when(F.col("phrase"), F.col("votes") == F.col("places")).otherwise((share >= COVERED) & (close >= DENSE))
    base = F.col("phrase") & holds
    found = spans.groupBy("row", "doc_id", "n_words").agg(
        F.coalesce(F.sum(F.when(base, 1)), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("low"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("low"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(holds, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(holds, share)), F.lit(0.0)).alias("score"),
    )
    return found.drop("row")


def oracle() -> str:
    """The same votes in DuckDB SQL, with the words themselves in place of hashes."""
    rows = [(p, label, True) for p, label in PHRASES.items()] + [(t, label, False) for label, t in TEXTS.items()]
    values = ", ".join(f"({i}, '{label}', {phrase}, '{text.lower()}')" for i, (text, label, phrase) in enumerate(rows))
    split = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = split.format(f"translate(coalesce(text, ''), '{upper}', '{lower}')")
    return f"""
WITH t AS (SELECT template, label, phrase, {split.format('body')} AS w FROM (VALUES {values}) v(template, label, phrase, body)),
tp AS (SELECT *, len(w) - CASE WHEN phrase THEN 1 ELSE 3 END AS places, unnest(range(len(w))) AS spot FROM t),
mark AS (SELECT template, label, phrase, places, spot, w[spot + 1] AS a, w[spot + 2] AS b, w[spot + 3] AS c, w[spot + 4] AS d FROM tp WHERE spot < places),
doc AS (SELECT doc_id, row_number() OVER () AS row, {text} AS w FROM documents),
roll AS (SELECT row, w, unnest(range(len(w))) AS pos FROM doc),
met AS (SELECT row, pos, m.* FROM roll JOIN mark m ON w[pos + 1] = a AND w[pos + 2] = b AND (phrase OR (w[pos + 3] = c AND w[pos + 4] = d))),
vote AS (SELECT row, template, label, phrase, places, pos - spot AS diagonal, count(*) AS votes, min(pos) AS low, max(pos) AS high FROM met GROUP BY ALL),
mk AS (SELECT *, CASE WHEN phrase OR diagonal - lag(diagonal) OVER w > {SLACK} THEN 1 ELSE 0 END AS new FROM vote WINDOW w AS (PARTITION BY row, template ORDER BY diagonal)),
sp AS (SELECT *, sum(new) OVER (PARTITION BY row, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM mk),
spans AS (SELECT row, template, label, phrase, places, span, sum(votes) AS votes, min(low) AS low, max(high) AS high FROM sp GROUP BY ALL),
held AS (SELECT *, least(1.0, votes / places) AS share FROM spans
  WHERE CASE WHEN phrase THEN votes = places ELSE least(1.0, votes / places) >= {COVERED} AND votes / (high - low + 1) >= {DENSE} END)
SELECT doc_id, len(w)::BIGINT AS n_words, count(*) FILTER (phrase) AS n_base, (min(low) FILTER (phrase))::BIGINT AS first_word,
  (max(low) FILTER (phrase))::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0)::DOUBLE AS score
FROM doc LEFT JOIN held USING (row) GROUP BY doc.row, doc_id, w"""
