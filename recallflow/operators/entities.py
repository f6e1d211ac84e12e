"""Entity mentions, spectra, coupling edges and clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallflow.functions import lexicon as lx
from recallflow.functions import text as tx
from recallflow.operators.scans import entropy_of, top_k
from recallflow.session import stored

CODE_PARTS = 64
LEADS = 1 << 19  # tokens of the smaller spectra that one task holds


def resolve_alias(names: DataFrame, aliases: DataFrame | None, col: str = "entity") -> DataFrame:
    """Map names by the explicit alias table only; unknown names stay."""
    if aliases is None:
        return names
    a = aliases.select(F.lower("alias").alias(col), F.lower("canonical").alias("_canonical"))
    return names.join(a, col, "left").withColumn(col, F.coalesce("_canonical", col)).drop("_canonical")


def item_entities() -> Column:
    """Capitalised runs of the text plus the fact subject."""
    subject = F.when(F.length("subject") > 1, F.array("subject")).otherwise(F.array().cast("array<string>"))
    return F.array_union(tx.extract_entities(F.col("text")), subject)


def entity_mentions(items: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(namespace, mem_id, seq, entity), one row per distinct entity of an item."""
    m = items.select("namespace", "mem_id", "seq", F.explode_outer(item_entities()).alias("entity")).where("entity IS NOT NULL")
    return m if aliases is None else resolve_alias(m, aliases).distinct()


def _free_tokens(items: DataFrame) -> DataFrame:
    """Tokens of an item that neither name an entity of it nor are part of such a name."""
    names = item_entities()
    parts = F.flatten(F.transform(names, lambda e: F.split(e, " ")))
    return items.select(
        "namespace", "mem_id", F.explode_outer(F.array_except("tokens", F.array_union(names, parts))).alias("token")
    ).where("token IS NOT NULL")


def entity_spectrum(items: DataFrame, mentions: DataFrame, idf: DataFrame) -> DataFrame:
    """(namespace, entity, token, weight): idf summed over the items of an entity.

    Items travel with their tokens in one array; an entity of a single item takes that
    item's tokens as they are, only the others are added up.
    """
    key = ["namespace", "mem_id"]
    weighted = (
        _free_tokens(items).join(idf.select("namespace", "token", F.col("idf").alias("weight")), ["namespace", "token"])
        .groupBy(*key).agg(F.collect_list(F.struct("token", "weight")).alias("ts"))
    )
    n = mentions.groupBy("namespace", "entity").agg(F.count(F.lit(1)).alias("n"))
    own = mentions.select(*key, "entity").join(n, ["namespace", "entity"]).join(weighted, key)

    def rows(some: DataFrame) -> DataFrame:
        return some.select("namespace", "entity", F.explode("ts").alias("t")).select("namespace", "entity", "t.token", "t.weight")

    many = rows(own.where("n > 1")).groupBy("namespace", "entity", "token").agg(F.sum("weight").alias("weight"))
    return rows(own.where("n = 1")).unionByName(many)


def entity_nodes(mentions: DataFrame, spectrum: DataFrame) -> DataFrame:
    """Mention counts, first appearance and spectrum entropy per entity."""
    base = mentions.groupBy("namespace", "entity").agg(
        F.count(F.lit(1)).alias("total_mentions"), F.min("seq").alias("birth_seq")
    )
    omega = entropy_of(spectrum, ["namespace", "entity"], "weight")
    return base.join(omega, ["namespace", "entity"], "left").fillna(0.0, ["omega"])


def related_entities(items: DataFrame, mentions: DataFrame, idf: DataFrame, k: int = 5) -> DataFrame:
    """Per item the ``k`` foreign entities that share most information with its tokens.

    Items are dealt into blocks of about ``LEADS`` tokens, and the token set of every entity
    travels once to each block of its namespace. A task holds its block and reads the
    entities one after another, so pairs of an item and an entity are rows only when best.
    """
    key = ["namespace", "mem_id"]
    names = mentions.select("namespace", F.col("entity").alias("token")).distinct()
    coded = stored(token_codes(idf))
    rows = items.select(*key, F.explode("tokens").alias("token")).join(names, ["namespace", "token"], "left_anti")
    tokens = stored(rows.join(coded.select("namespace", "token", "idf", "code"), ["namespace", "token"]).select(*key, "code", "idf"))
    index = (
        mentions.select(*key, "entity").distinct().join(tokens.select(*key, "code"), key).select("namespace", "entity", "code").distinct()
        .groupBy("namespace", "entity").agg(F.collect_list("code").alias("codes"))
    )
    asks = tokens.groupBy(*key).agg(F.collect_list("code").alias("codes"), F.collect_list("idf").alias("weights"))
    own = mentions.select(*key, "entity").groupBy(*key).agg(F.collect_set("entity").alias("names"))
    asks = stored(asks.join(own, key, "left"))
    blocks = stored(asks.groupBy("namespace").agg(F.ceil(F.sum(F.size("codes")) / LEADS).cast("int").alias("blocks")))
    mine = asks.join(blocks, "namespace").select(
        "namespace", F.pmod(F.xxhash64("mem_id"), "blocks").cast("int").alias("block"), F.lit(0).alias("turn"), F.lit("").alias("entity"),
        "mem_id", "codes", "weights", "names",
    )
    kind = dict(items.dtypes)["mem_id"]
    theirs = index.join(blocks, "namespace").select(
        "namespace", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("turn"), "entity",
        F.lit(None).cast(kind).alias("mem_id"), "codes", F.lit(None).cast("array<double>").alias("weights"), F.lit(None).cast("array<string>").alias("names"),
    )
    both = mine.unionByName(theirs).repartition("namespace", "block").sortWithinPartitions("namespace", "block", "turn", "entity")
    found = both.mapInArrow(_best_entities(k), f"namespace string, mem_id {kind}, entity string, shared_information double")
    return top_k(found, key, [F.desc(F.round("shared_information", 6)), F.asc("entity")], k)


class _Items:
    """Items of a block and the entities that share most with each so far."""

    def __init__(self, namespace: str, k: int):
        self.namespace, self.k = namespace, k
        self.ids, self.codes, self.weights, self.names = [], [], [], {}
        self.found, self.entities, self.n = [], [], 0

    def add(self, mem_id: object, codes: np.ndarray, weights: np.ndarray, names: list[str] | None) -> None:
        for name in names or []:
            self.names.setdefault(name, []).append(len(self.ids))
        self.ids.append(mem_id)
        self.codes.append(codes)
        self.weights.append(weights)

    def close(self) -> None:
        """Postings by token, once all items are there."""
        owner = np.repeat(np.arange(len(self.ids)), [len(c) for c in self.codes])
        codes, weights = np.concatenate(self.codes), np.concatenate(self.weights)
        order = np.argsort(codes, kind="stable")
        self.owner, self.w = owner[order], weights[order]
        self.first = np.searchsorted(codes[order], np.arange(int(codes.max()) + 2))
        self.least = np.zeros(len(self.ids))

    def meet(self, entity: str, codes: np.ndarray) -> None:
        codes = codes[codes < len(self.first) - 1]
        start, n = self.first[codes], self.first[codes + 1] - self.first[codes]
        at = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(codes) else np.zeros(0, dtype=np.int64)
        if not len(at):
            return
        who = self.owner[at]
        score = np.bincount(who, self.w[at], len(self.ids))
        told = np.zeros(len(self.ids), dtype=bool)
        told[who] = True
        told[self.names.get(entity, [])] = False
        near = np.flatnonzero(told & (np.round(score, 6) >= self.least))
        if len(near):
            self.found.append((near, score[near], np.full(len(near), len(self.entities))))
            self.entities.append(entity)
            self.n += len(near)
            if self.n > 1 << 20:
                self.compact()

    def compact(self) -> None:
        """Keep the best of each item; of equals those that came first, in order of name."""
        who, score, name = (np.concatenate(x) for x in zip(*self.found, strict=True))
        # Sums of the same weights in another order are ties.
        order = np.lexsort((name, -np.round(score, 6), who))
        who, score, name = who[order], score[order], name[order]
        new = np.append(True, np.diff(who) != 0)
        place = np.arange(len(who)) - np.maximum.accumulate(np.where(new, np.arange(len(who)), 0))
        last = place == self.k - 1
        # Later names of an equal sum stand behind the last one.
        self.least[who[last]] = np.nextafter(np.round(score[last], 6), np.inf)
        some = place < self.k
        kept, name = np.unique(name[some], return_inverse=True)
        self.entities = [self.entities[i] for i in kept]
        self.found, self.n = [(who[some], score[some], name)], int(some.sum())

    def rows(self) -> pa.RecordBatch | None:
        if not self.found:
            return None
        self.compact()
        who, score, name = self.found[0]
        names, ids = pa.array(self.entities, pa.string()), pa.array(self.ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.namespace] * len(who), pa.string()), ids.take(pa.array(who)), names.take(pa.array(name)), pa.array(score)],
            names=["namespace", "mem_id", "entity", "shared_information"],
        )


def _best_entities(k: int):
    """Best entities of every item of a block; the items come first, then entities by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, open_ = None, None, True
        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in ("namespace", "block", "turn", "entity", "mem_id")), strict=True)
            for i, (namespace, block, turn, entity, mem_id) in enumerate(places):
                if here != (namespace, block):
                    if held is not None and (rows := held.rows()):
                        yield rows
                    here, held, open_ = (namespace, block), _Items(namespace, k), True
                codes = batch.column("codes")[i].values.to_numpy().copy()
                if turn == 0:
                    held.add(mem_id, codes, batch.column("weights")[i].values.to_numpy().copy(), batch.column("names")[i].as_py())
                    continue
                if not held.ids:
                    continue
                if open_:
                    held.close()
                    open_ = False
                held.meet(entity, codes)
        if held is not None and (rows := held.rows()):
            yield rows

    return run


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.where(F.col(x) != F.col(y)).select(
        "namespace", F.least(x, y).alias("entity_a"), F.greatest(x, y).alias("entity_b"), "mem_id", "seq", "together"
    )


def candidate_edges(mentions: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """Entity pairs whose edge is kept: mentioned together, or related by :func:`related_entities`.

    Returns (namespace, entity_a, entity_b, last_seq, shared_items).
    """
    m = mentions.groupBy("namespace", "mem_id", "seq").agg(F.sort_array(F.collect_set("entity")).alias("es"))
    head = m.select("namespace", "mem_id", "seq", "es", F.posexplode("es").alias("i", "x"))
    both = head.select(
        "namespace", "mem_id", "seq", "x",
        F.explode(F.slice("es", F.col("i") + 2, F.size("es"))).alias("y"), F.lit(1).alias("together"),
    )
    pairs = _ordered(both, "x", "y")
    if related is not None:
        r = related.select("namespace", "mem_id", F.col("entity").alias("y"))
        one = mentions.withColumnRenamed("entity", "x").join(r, ["namespace", "mem_id"]).withColumn("together", F.lit(0))
        pairs = pairs.unionByName(_ordered(one, "x", "y"))
    return pairs.groupBy("namespace", "entity_a", "entity_b").agg(
        F.max("seq").alias("last_seq"), F.sum("together").alias("shared_items")
    )


def _smaller_first(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs with ``lead``, the entity of the smaller spectrum, and ``other``."""
    na = sizes.select("namespace", F.col("entity").alias("entity_a"), F.col("n").alias("na"))
    nb = sizes.select("namespace", F.col("entity").alias("entity_b"), F.col("n").alias("nb"))
    both = pairs.join(na, ["namespace", "entity_a"]).join(nb, ["namespace", "entity_b"])
    first = F.col("na") <= F.col("nb")
    return both.select(
        *pairs.columns, F.when(first, F.col("entity_a")).otherwise(F.col("entity_b")).alias("lead"),
        F.when(first, F.col("entity_b")).otherwise(F.col("entity_a")).alias("other"),
    )


def _shared_tokens(pairs: DataFrame, free: DataFrame) -> DataFrame:
    """(pair, token, wa, wb) for the tokens both entities carry.

    A pair unrolls its smaller spectrum and asks the larger one by (entity, token), so a hub
    is never copied per pair and its spectrum lies spread over its tokens.
    """
    sizes = free.groupBy("namespace", "entity").agg(F.count(F.lit(1)).alias("n"))
    asked = _smaller_first(pairs.select("namespace", "entity_a", "entity_b"), sizes)
    lead = free.select("namespace", F.col("entity").alias("lead"), "token", F.col("weight").alias("wa"))
    other = free.select("namespace", F.col("entity").alias("other"), "token", F.col("weight").alias("wb"))
    return asked.join(lead, ["namespace", "lead"]).join(other, ["namespace", "other", "token"]).select("namespace", "entity_a", "entity_b", "token", "wa", "wb")


def token_codes(idf: DataFrame) -> DataFrame:
    """(namespace, token, idf, code): a small whole number per token of a namespace."""
    part = F.pmod(F.xxhash64("token"), F.lit(CODE_PARTS)).cast("int")
    dealt = idf.select("namespace", "token", "idf", part.alias("_p"))
    place = F.row_number().over(W.partitionBy("namespace", "_p").orderBy("idf", "token"))
    return dealt.withColumn("code", place * CODE_PARTS + F.col("_p")).drop("_p")


def _shared_mass(pairs: DataFrame, free: DataFrame) -> DataFrame:
    """(pair, sic, shared_tokens): number of tokens both entities carry and their squared idf.

    The smaller spectra are dealt into blocks of about ``LEADS`` tokens, and the larger one
    of a pair travels once to each block it has a partner in. A task holds its block and
    reads the larger spectra one after another, so shared tokens are never rows.
    """
    coded = stored(token_codes(free.select("namespace", "token", "idf").distinct()))
    held = free.select("namespace", "entity", "token").join(coded, ["namespace", "token"])
    lists = stored(held.groupBy("namespace", "entity").agg(F.collect_list("code").alias("codes"), F.collect_list(F.col("idf") * F.col("idf")).alias("squares")))
    sizes = lists.select("namespace", "entity", F.size("codes").alias("n"))
    asked = stored(_smaller_first(pairs.select("namespace", "entity_a", "entity_b"), sizes).select("namespace", "lead", "other"))
    leads = stored(asked.select("namespace", F.col("lead").alias("entity")).distinct().join(lists, ["namespace", "entity"]))
    blocks = leads.groupBy("namespace").agg(F.ceil(F.sum(F.size("codes")) / LEADS).alias("blocks"))
    block = F.pmod(F.xxhash64("entity"), "blocks").alias("block")
    mine = leads.join(blocks, "namespace").select(
        "namespace", block, F.lit(0).alias("turn"), "entity", "codes", "squares", F.lit(None).cast("array<string>").alias("leads"),
    )
    met = asked.withColumnRenamed("lead", "entity").join(blocks, "namespace").groupBy("namespace", block, "other").agg(F.collect_list("entity").alias("leads"))
    theirs = met.withColumnRenamed("other", "entity").join(lists.select("namespace", "entity", "codes"), ["namespace", "entity"]).select(
        "namespace", "block", F.lit(1).alias("turn"), "entity", "codes", F.lit(None).cast("array<double>").alias("squares"), "leads",
    )
    both = mine.unionByName(theirs).repartition("namespace", "block").sortWithinPartitions("namespace", "block", "turn")
    found = both.mapInArrow(_meeting, "namespace string, lead string, other string, sic double, shared_tokens bigint")
    return found.select("namespace", F.least("lead", "other").alias("entity_a"), F.greatest("lead", "other").alias("entity_b"), "sic", "shared_tokens")


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the tokens a larger spectrum shares with those of its block; the block's
    own spectra come first."""
    here, held, times = None, {}, np.zeros(0, dtype=np.int32)
    for batch in batches:
        places = zip(*(batch.column(c).to_pylist() for c in ("namespace", "block", "turn", "entity")), strict=True)
        found = []
        for i, (namespace, block, turn, entity) in enumerate(places):
            if here != (namespace, block):
                here, held = (namespace, block), {}
            codes = batch.column("codes")[i].values.to_numpy()
            if len(codes) and codes.max() >= len(times):
                times = np.zeros(2 * int(codes.max()) + 1, dtype=np.int32)
            if turn == 0:
                held[entity] = codes.copy(), batch.column("squares")[i].values.to_numpy().copy()
                continue
            names = batch.column("leads")[i].as_py()
            np.add.at(times, codes, 1)
            lists, squares = zip(*(held[x] for x in names), strict=True)
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists[:-1]])]).astype(np.int64)
            own = np.concatenate(lists)
            if own.max() >= len(times):
                times = np.concatenate([times, np.zeros(int(own.max()) + 1, dtype=np.int32)])
            both = times[own]
            times[codes] = 0
            n, mass = np.add.reduceat(both, at, dtype=np.int64), np.add.reduceat(np.concatenate(squares) * both, at)
            found += [(namespace, x, entity, m, k) for x, m, k in zip(names, mass.tolist(), n.tolist(), strict=True) if k]
        if found:
            columns = [pa.array(list(c)) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["namespace", "lead", "other", "sic", "shared_tokens"])


def coupling(pairs: DataFrame, spectrum: DataFrame, idf: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """Coupling strength K per candidate pair and whether it synchronises.

    Spectra meet along the candidate pairs, never token against token. With the
    ``mentions`` the spectrum was made of, a pair is settled without its tokens where one
    entity stands in no item without the other: then its whole spectrum is shared.
    """
    names = spectrum.select("namespace", F.col("entity").alias("token")).distinct()
    known = idf.select("namespace", "token", "idf")
    free = spectrum.join(names, ["namespace", "token"], "left_anti").join(known, ["namespace", "token"])
    size = free.groupBy("namespace", "entity").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("idf") * F.col("idf")).alias("mass"))
    key = ["namespace", "entity_a", "entity_b"]
    if mentions is None:
        size = size.withColumn("items", F.lit(None).cast("bigint"))
    else:
        size = mentions.groupBy("namespace", "entity").agg(F.count(F.lit(1)).alias("items")).join(size, ["namespace", "entity"], "left")
    size = stored(size)

    def side(x: str) -> DataFrame:
        return size.select("namespace", F.col("entity").alias(f"entity_{x}"), F.col("n").alias(f"n{x}"), F.col("mass").alias(f"m{x}"), F.col("items").alias(f"i{x}"))

    both = stored(pairs.join(side("a"), ["namespace", "entity_a"], "left").join(side("b"), ["namespace", "entity_b"], "left"))
    in_a, in_b = F.coalesce(F.col("shared_items") == F.col("ia"), F.lit(False)), F.coalesce(F.col("shared_items") == F.col("ib"), F.lit(False))
    rest = both.where(~in_a & ~in_b).select(*key)
    asked = rest.select("namespace", F.explode(F.array("entity_a", "entity_b")).alias("entity")).distinct()
    shared = _shared_mass(rest, stored(free.join(asked, ["namespace", "entity"], "left_semi")))
    out = both.join(shared, key, "left")
    sic = F.when(in_a, F.col("ma")).when(in_b, F.col("mb")).otherwise(F.col("sic"))
    n_shared = F.when(in_a, F.col("na")).when(in_b, F.col("nb")).otherwise(F.col("shared_tokens"))
    k = F.coalesce(sic, F.lit(0.0)) / F.sqrt(F.coalesce("na", F.lit(1)) * F.coalesce("nb", F.lit(1)))
    return out.select(
        *key, "last_seq", "shared_items", F.coalesce(n_shared, F.lit(0)).alias("shared_tokens"),
        k.alias("coupling"), (k > lx.K_CRITICAL).alias("synchronized"),
    )


def shared_spectrum(pairs: DataFrame, spectrum: DataFrame) -> DataFrame:
    """(pair, token, weight): tokens both entities of a pair carry, entity names excluded."""
    names = spectrum.select("namespace", F.col("entity").alias("token")).distinct()
    free = spectrum.join(names, ["namespace", "token"], "left_anti")
    return _shared_tokens(pairs, free).select("namespace", "entity_a", "entity_b", "token", F.least("wa", "wb").alias("weight"))


def components(edges: DataFrame, a: str, b: str, scope: str = "namespace", max_rounds: int = 60) -> DataFrame:
    """Connected components as (scope, node, component): component = least node name.

    Minimum labels flow along edges, then every label is replaced by the label of the node
    it names, so long chains halve each round. Labels are combined map-side; each round is
    written out.
    """
    both = stored(
        edges.select(scope, F.col(a).alias("x"), F.col(b).alias("y"))
        .unionByName(edges.select(scope, F.col(b).alias("x"), F.col(a).alias("y"))).distinct()
    )
    labels = both.select(scope, F.col("x").alias("node")).distinct().withColumn("component", F.col("node"))
    for _ in range(max_rounds):
        near = both.join(labels.select(scope, F.col("node").alias("y"), "component"), [scope, "y"]).select(
            scope, F.col("x").alias("node"), "component"
        )
        low = labels.unionByName(near).groupBy(scope, "node").agg(F.min("component").alias("component"))
        hop = low.select(scope, F.col("node").alias("component"), F.col("component").alias("_next"))
        fresh = stored(
            low.join(hop, [scope, "component"]).select(scope, "node", F.col("_next").alias("component"))
        )
        old = labels.withColumnRenamed("component", "_was")
        moved = fresh.join(old, [scope, "node"]).where(F.col("component") != F.col("_was"))
        labels = fresh
        if moved.isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def clusters(edges: DataFrame, spectrum: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, coherence, spectrum) of groups of synchronised entities."""
    members = components(edges.where("synchronized"), "entity_a", "entity_b").select(
        "namespace", F.col("node").alias("entity"), F.col("component").alias("cluster")
    )
    size = members.groupBy("namespace", "cluster").agg(F.count(F.lit(1)).alias("size"))
    ca = members.select("namespace", F.col("entity").alias("entity_a"), F.col("cluster").alias("ca"))
    cb = members.select("namespace", F.col("entity").alias("entity_b"), F.col("cluster").alias("cb"))
    inner = edges.join(ca, ["namespace", "entity_a"]).join(cb, ["namespace", "entity_b"]).where("ca = cb")
    coherence = inner.groupBy("namespace", F.col("ca").alias("cluster")).agg(F.avg("coupling").alias("coherence"))
    joint = (
        spectrum.join(members, ["namespace", "entity"]).groupBy("namespace", "cluster", "token")
        .agg(F.count(F.lit(1)).alias("_k"), F.min("weight").alias("weight"))
        .join(size, ["namespace", "cluster"]).where("_k = size").select("namespace", "cluster", "token", "weight")
    )
    return members, size.join(coherence, ["namespace", "cluster"], "left"), joint


def decay_prune_edges(edges: DataFrame, now_seq: int) -> DataFrame:
    """Fade edges untouched for more than 100 steps; drop what is nearly gone."""
    age = F.lit(now_seq) - F.col("last_seq")
    k = F.when(age > 100, F.col("coupling") * F.pow(F.lit(0.99), age / 100)).otherwise(F.col("coupling"))
    return edges.withColumn("coupling", k).withColumn("synchronized", F.col("coupling") > lx.K_CRITICAL).where(
        F.col("coupling") >= 0.01
    )


def forget_entities(mentions: DataFrame, edges: DataFrame, dead: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop mentions of dead items, and edges of entities left without any item."""
    left = mentions.join(dead.select("namespace", "mem_id").distinct(), ["namespace", "mem_id"], "left_anti")
    alive = left.select("namespace", "entity").distinct()
    kept = edges
    for col in ("entity_a", "entity_b"):
        kept = kept.join(alive.withColumnRenamed("entity", col), ["namespace", col], "left_semi")
    return left, kept


def dominant_entity(members: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entity mentioned by most members of a group."""
    n = (
        members.select("namespace", "group_id", "mem_id").join(mentions, ["namespace", "mem_id"])
        .groupBy("namespace", "group_id", "entity").agg(F.count(F.lit(1)).alias("n"))
    )
    first = top_k(n, ["namespace", "group_id"], [F.desc("n"), F.asc("entity")], 1)
    return first.select("namespace", "group_id", F.col("entity").alias("dominant"))
