"""Temperature mixing of sources and its realisation as budgeted block permutations.

Weights are token shares to a power: one keeps the natural mix, zero weighs all sources
alike. The exponent is bisected; the weights, times a token budget, say how much of each
source is read. A source is read in epochs. In an epoch its blocks (hash buckets of about
``block_tokens``) come in an order drawn for that epoch, and so do the documents of a block;
the last epoch stops where the budget is used up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallflow.llm.common import unused
from recallflow.operators.scans import running_sum
from recallflow.session import cut

WORD = r"[^\x20\x09-\x0D]+"
DEPTH, PASSES = 5, 8  # bisection steps answered by one aggregation; aggregations


@dataclass(frozen=True)
class Target:
    """``entropy``: least share of the entropy of equal weights. ``repetition``: the most
    often any source may be read; where both cannot be met this one holds (a budget above
    that many times all tokens cannot meet it and reads the natural mix). ``budget``: tokens
    to emit; None is the least budget that reads every source whole once."""

    entropy: float | None = 0.999
    repetition: float | None = 2.0
    budget: int | None = None
    block_tokens: int = 1 << 17
    seed: str = "mix"


def drawn(*parts: Column | str) -> Column:
    """A number below 2^60 drawn from text parts; SQL engines with md5 draw the same."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def exponent(sources: DataFrame, target: Target) -> float:
    """Largest exponent whose entropy meets the target, or, if more, the least that keeps
    the repetition limit. ``sources`` has ``tokens`` > 0 per source; each pass answers
    several bisection steps with sums over it, rounded to nine places at the end."""
    total, n, least, most = sources.agg(F.sum("tokens"), F.count(F.lit(1)), F.min("tokens"), F.max("tokens")).first()
    if not total or n < 2:
        return 1.0
    p = F.col("tokens") / F.lit(float(total))

    def flatter(a: float, z: float, plogp: float) -> bool:
        """Whether ``a`` may still grow."""
        spread = target.entropy is not None and math.log(z) - a * plogp / z >= target.entropy * math.log(n)
        if target.repetition is None:
            return spread
        if target.budget is None:
            read = (most / least) ** (1 - a)
        else:
            read = (least / total) ** (a - 1) / z * target.budget / total
        return spread or read > target.repetition

    low, high = 0.0, 1.0
    for _ in range(PASSES):
        steps = 1 << DEPTH
        at = [low + (high - low) * k / steps for k in range(1, steps)]
        sums = sources.agg(*[
            e for k, a in enumerate(at)
            for e in (F.sum(F.pow(p, F.lit(a))).alias(f"z{k}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"h{k}"))
        ]).first()
        a, b = 0, steps
        while b - a > 1:
            m = (a + b) // 2
            a, b = (m, b) if flatter(at[m - 1], sums[f"z{m - 1}"], sums[f"h{m - 1}"]) else (a, m)
        low, high = (at[a - 1] if a else low), (at[b - 1] if b < steps else high)
    return round(low, 9)


def plan(sources: DataFrame, target: Target) -> DataFrame:
    """(source, tokens, weight, amount, epochs, rest, blocks) per source.

    ``amount`` tokens are read: ``epochs`` whole epochs and ``rest`` tokens of one more. A
    source without tokens has no weight; its documents are read once.
    """
    some = sources.where("tokens > 0")
    a = exponent(some, target)
    tokens = F.col("tokens").cast("double")
    most, z = some.agg(F.max(tokens), F.sum(F.pow(tokens, F.lit(a)))).first()
    weight = F.when(F.col("tokens") > 0, F.pow(tokens, F.lit(a)) / F.lit(z or 1.0)).otherwise(0.0)
    if target.budget is None:
        amount = F.round(tokens * F.pow(F.lit(most or 1.0) / tokens, F.lit(1 - a)))
    else:
        amount = F.round(F.pow(tokens, F.lit(a)) / F.lit(z or 1.0) * target.budget)
    out = sources.select(
        "source", "tokens", weight.alias("weight"), F.when(F.col("tokens") > 0, amount).otherwise(0).cast("long").alias("amount")
    )
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("amount") / F.col("tokens"))).otherwise(1)
    return out.withColumn("epochs", epochs.cast("long")).withColumns({
        "rest": F.when(F.col("tokens") > 0, F.col("amount") - F.col("epochs") * F.col("tokens")).otherwise(0),
        "blocks": F.greatest(F.lit(1), F.ceil(F.col("tokens") / target.block_tokens)).cast("long"),
    })


def mixed(docs: DataFrame, target: Target | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, weight, repetition, epoch, block, block_key, doc_key):
    one row per reading of a document, in the order (source, epoch, block_key, doc_key).

    Tokens are runs other than ASCII white space; a null text has none. Rows of one doc_id
    and source are one document. A null source is a source of its own. Sums over the blocks
    of a large source run in two levels; only the block at the budget's end is cut, in the
    order of its documents, so the budget is never exceeded.
    """
    target = target or Target()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    units = cut(
        docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"))
        .groupBy("doc_id", "source").agg(F.sum("n_tokens").alias("n_tokens"))
    )
    sources = cut(plan(cut(units.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))), target))
    named = sources.withColumnRenamed("source", "_s")
    unit = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    name = F.coalesce("source", F.lit(""))
    dealt = units.join(named, F.col("source").eqNullSafe(F.col("_s"))).withColumn("block", drawn(target.seed, unit) % F.col("blocks"))

    def keys(epoch: Column) -> dict[str, Column]:
        e = epoch.cast("string")
        return {
            "block_key": drawn(target.seed, "block", name, e, F.col("block").cast("string")),
            "doc_key": drawn(target.seed, "doc", unit, e),
        }

    whole = dealt.where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    whole = whole.withColumns(keys(F.col("epoch")))
    part = dealt.where("rest > 0").withColumn("epoch", F.col("epochs")).withColumns(keys(F.col("epoch")))
    blocks = cut(part.groupBy("source", "block", "block_key", "rest").agg(F.sum("n_tokens").alias("size")))
    placed = cut(running_sum(
        blocks, ["source"], ["block_key", "block"], F.shiftright("block_key", 52), {"before": F.col("size")}, inclusive=False
    ).where("before < rest"))
    placed = placed.select(F.col("source").alias("_p"), F.col("block").alias("_b"), "before", "size")
    reached = part.join(placed, F.col("source").eqNullSafe(F.col("_p")) & (F.col("block") == F.col("_b")))
    full = reached.where("before + size <= rest")
    edge = running_sum(
        reached.where("before + size > rest"), ["source"], ["doc_key", "doc_id"], F.shiftright("doc_key", 52), {"upto": F.col("n_tokens")}
    ).where("before + upto <= rest")
    columns = [
        "doc_id", "source", "n_tokens", "weight", F.when(F.col("tokens") > 0, F.col("amount") / F.col("tokens")).otherwise(1.0).alias("repetition"), "epoch", "block", "block_key", "doc_key",
    ]
    return whole.select(*columns).unionByName(full.select(*columns)).unionByName(edge.select(*columns))


def realised(docs: DataFrame, target: Target | None = None) -> DataFrame:
    """The rows of ``docs`` as often as the mix reads them."""
    readings = mixed(docs, target).groupBy("doc_id", "source").agg(F.count(F.lit(1)).cast("int").alias("n"))
    i, s, n = (unused(docs, c) for c in ("_id", "_source", "_n"))
    times = cut(readings.select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("n").alias(n)))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & F.col("source").eqNullSafe(F.col(s))
    return docs.join(times, same).withColumn(n, F.explode(F.array_repeat(F.lit(0), F.col(n)))).select(*docs.columns)


def oracle(target: Target) -> str:
    """The same in DuckDB SQL, for the default budget."""
    md5 = "('0x' || substr(md5({}), 1, 15))::BIGINT"
    seed = target.seed
    block = md5.format(f"'{seed}|' || coalesce(doc_id::VARCHAR, '')")
    block_key = md5.format(f"'{seed}|block|' || coalesce(source, '') || '|' || epoch || '|' || block")
    doc_key = md5.format(f"'{seed}|doc|' || coalesce(doc_id::VARCHAR, '') || '|' || epoch")
    return rf"""
WITH RECURSIVE units AS (
  SELECT doc_id, source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS n_tokens
  FROM documents GROUP BY ALL),
src AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM units GROUP BY ALL),
tot AS (SELECT sum(tokens)::DOUBLE AS t, count(*) AS n, max(tokens)::DOUBLE AS most, min(tokens)::DOUBLE AS least FROM src WHERE tokens > 0),
shares AS (SELECT list(tokens / t) AS ps, any_value(n) AS n, any_value(most) AS most, any_value(least) AS least FROM src, tot WHERE tokens > 0),
bis(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN m ELSE low END, CASE WHEN ok THEN high ELSE m END FROM (
    SELECT step, low, high, m,
      ln(list_sum(list_transform(ps, lambda p: pow(p, m)))) - m * list_sum(list_transform(ps, lambda p: pow(p, m) * ln(p)))
        / list_sum(list_transform(ps, lambda p: pow(p, m))) >= {target.entropy} * ln(n)
      OR pow(most / least, 1 - m) > {target.repetition} AS ok
    FROM (SELECT step, low, high, (low + high) / 2 AS m FROM bis WHERE step < {DEPTH * PASSES}), shares)),
expo AS (SELECT CASE WHEN (SELECT n FROM tot) < 2 THEN 1.0 ELSE round(low, 9) END AS a FROM bis WHERE step = {DEPTH * PASSES}),
z AS (SELECT sum(pow(tokens::DOUBLE, a)) AS z FROM src, expo WHERE tokens > 0),
p1 AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(tokens::DOUBLE, a) / z ELSE 0.0 END AS weight,
  CASE WHEN tokens > 0 THEN round(tokens * pow(most / tokens, 1 - a))::BIGINT ELSE 0 END AS amount FROM src, expo, z, tot),
p2 AS (SELECT *, CASE WHEN tokens > 0 THEN amount // tokens ELSE 1 END AS epochs FROM p1),
plan AS (SELECT *, CASE WHEN tokens > 0 THEN amount - epochs * tokens ELSE 0 END AS rest,
  greatest(1, ceil(tokens / {target.block_tokens}.0))::BIGINT AS blocks FROM p2),
dealt AS (SELECT u.doc_id, u.source, n_tokens, tokens, weight, amount, epochs, rest, {block.replace('doc_id', 'u.doc_id')} % blocks AS block
  FROM units u JOIN plan p ON u.source IS NOT DISTINCT FROM p.source),
turns AS (SELECT *, unnest(range(epochs)) AS epoch, true AS whole FROM dealt
  UNION ALL SELECT *, epochs, false FROM dealt WHERE rest > 0),
keyed AS (SELECT *, {block_key} AS block_key, {doc_key} AS doc_key FROM turns),
sized AS (SELECT source, block, block_key, rest, sum(n_tokens) AS size FROM keyed WHERE NOT whole GROUP BY ALL),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY block_key, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized),
ends AS (SELECT k.*, before, size, sum(n_tokens) OVER (PARTITION BY k.source, k.block ORDER BY doc_key, doc_id) AS upto
  FROM keyed k JOIN placed p ON k.source IS NOT DISTINCT FROM p.source AND k.block = p.block WHERE NOT whole AND before < k.rest)
SELECT doc_id, source, n_tokens, round(weight, 6) AS weight, round(CASE WHEN tokens > 0 THEN amount / tokens ELSE 1 END, 6) AS repetition, epoch, block, block_key, doc_key FROM keyed WHERE whole
UNION ALL
SELECT doc_id, source, n_tokens, round(weight, 6), round(CASE WHEN tokens > 0 THEN amount / tokens ELSE 1 END, 6), epoch, block, block_key, doc_key FROM ends
WHERE before + size <= rest OR before + upto <= rest"""
