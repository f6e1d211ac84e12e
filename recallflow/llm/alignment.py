"""Alignment of two tokenizations of the same bytes by merge-path partitioning.

The ends of both token sequences are merged. Diagonals of the merge matrix, equally far
apart, are binary-searched all at once; between two of them lies a piece of the same number
of steps, whatever the lengths. All pieces advance together, a step of every piece a vector
operation, and each step emits one overlap of an A token and a B token. A place where both
end closes a group; a group that runs over several pieces is stitched by the running count
of closed ones.

But for a few characters found in the vocabulary, neither tokenizer joins white space to
what stands before it, so a text falls into stretches (white space and what follows up to the next)
that are encoded independently, each different one once while a worker remembers it, and
aligned once a batch. Overlaps of one id pair are counted over the whole corpus. The counts,
bounded by the two vocabularies, are looked up in slices of a fixed number of pairs, one
pass over the written tokens each, so no broadcast grows with the corpus and no text or
token is shuffled.
"""

from __future__ import annotations

import gc
import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from recallflow.llm.bpe import byte_symbols
from recallflow.llm.common import bound_batches, without, written

STEPS = 256  # of the merge in one piece
SLICE = 4_000_000  # id pairs looked up at once: 68 MB
HELD, HELD_CHARS = 200_000, 8_000_000  # stretches a worker remembers, and their length
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
# The splitting pattern of byte-level vocabularies; a fixed value of their file format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Beyond U+052F the libraries' Unicode tables may differ: such texts take the slower one.
_LATER = re.compile(r"[^\x00-ԯ]")
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_JOINED = re.compile(f"[^{_SPACES}]([{_SPACES}])")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class Pair:
    """The two tokenizers, the bytes of their tokens and the decimal texts of their ids."""

    def __init__(self, a_json: str, b_model: bytes):
        self.a_json, self.slow = a_json, None
        spec = json.loads(a_json)
        special = {t["id"] for t in spec["added_tokens"]}
        value = {s: b for b, s in enumerate(byte_symbols())}
        vocab = {i: bytes(value[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in special}
        self.a_bytes = [vocab.get(i, b"") for i in range(max(vocab) + 1)]
        self.fast = self._ranked(spec, vocab)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            byte = _BYTE.fullmatch(piece) if self.b.is_byte(i) else None
            self.b_bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
        self.a_size, self.b_size = (np.array([len(t) for t in ts], dtype=np.int64) for ts in (self.a_bytes, self.b_bytes))
        pieces = [t.decode("utf-8", "replace") for i, t in enumerate(self.b_bytes) if not self.b.is_byte(i)]
        # B may join these to what stands before them, so no stretch begins there
        tied = "".join(re.escape(c) for c in sorted({c for t in pieces for c in _JOINED.findall(t)}))
        more = f"(?:[{tied}][{_SPACES}]*[^{_SPACES}]+)*(?:[{tied}][{_SPACES}]*\\Z)?" if tied else ""
        self.stretch = re.compile(f"[{_SPACES}]*[^{_SPACES}]+{more}|[{_SPACES}]+")
        self.parted = self.fast is not None and not any("\n" in t for t in pieces)
        self.parted &= self.b.encode("\n  a\n") == [self.b.piece_to_id(t) for t in ("▁", "<0x0A>", "▁", "▁a", "<0x0A>")]
        self.a_flat, self.b_flat = (np.frombuffer(b"".join(t), dtype=np.uint8) for t in (self.a_bytes, self.b_bytes))
        self.names = [np.array([f"{i}{end}" for i in range(max(len(self.a_bytes), len(self.b_bytes)))], dtype=object) for end in (",", "|", ";")]

    @staticmethod
    def _ranked(spec: dict, vocab: dict[int, bytes]) -> tiktoken.Encoding | None:
        """The same vocabulary by ranks, where its merges are in the order of its ids."""
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][x + y] for x, y in merges]
        plain = spec["pre_tokenizer"] == {**spec["pre_tokenizer"], "type": "ByteLevel", "add_prefix_space": False, "use_regex": True} and not spec["normalizer"]
        if not plain or made != sorted(made) or len(merges) + 256 != len(vocab):
            return None
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks={t: i for i, t in vocab.items()}, special_tokens={})

    def stretches(self, text: str) -> list[str]:
        """Parts of space+text whose tokens do not depend on the others."""
        if not text:
            return []
        return self.stretch.findall(" " + text) if self.parted else [" " + text]

    def _encode_slow(self, part: str) -> list[int]:
        if self.slow is None:
            self.slow = Tokenizer.from_str(self.a_json)
            self.slow.encode_special_tokens = True
        return self.slow.encode(part, add_special_tokens=False).ids

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids by A and where those of each stretch begin, the same by B; a stretch that one
        of them does not give back byte by byte has none."""
        ascii_, fast, later = str.isascii, self.fast and self.fast.encode_ordinary, _LATER.search
        a = _flat([fast(p) if fast and (ascii_(p) or not later(p)) else self._encode_slow(p) for p in parts])
        if self.parted:
            # B puts a space before all; a line break is a token of its own and shields it
            ids, at = _flat(self.b.encode(["\n" + p for p in parts], num_threads=1))
            shield = np.zeros(len(ids), dtype=bool)
            shield[at[:-1]] = shield[at[:-1] + 1] = True
            b = ids[~shield], at - 2 * np.arange(len(at))
        else:
            b = _flat(self.b.encode([p[1:] for p in parts], num_threads=1))
        raw = "".join(parts).encode("utf-8", "surrogatepass")
        sizes = np.array([len(p) if ascii_(p) else len(p.encode("utf-8", "surrogatepass")) for p in parts], dtype=np.int64)
        buffer = np.frombuffer(raw, dtype=np.uint8)
        same = _spelled(*a, buffer, sizes, self.a_flat, self.a_size) & _spelled(*b, buffer, sizes, self.b_flat, self.b_size)
        if same.all():
            return *a, *b
        out = []
        for ids, at in (a, b):
            size = np.where(same, np.diff(at), 0)
            out += [ids[np.repeat(same, np.diff(at))], np.concatenate([[0], np.cumsum(size)])]
        return tuple(out)


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., then those of start[1], and so on."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _spelled(ids: np.ndarray, at: np.ndarray, buffer: np.ndarray, want: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes of each row of ids are those of its part of the buffer."""
    out = _per_row(size[ids], at) == want
    ids = ids[np.repeat(out, np.diff(at))]
    expected = buffer if out.all() else buffer[np.repeat(out, want)]
    differs = flat[_spans((np.cumsum(size) - size)[ids], size[ids])] != expected
    out[out] = _per_row(differs, np.concatenate([[0], np.cumsum(want[out])])) == 0
    return out


_loaded: dict[tuple[str, bytes], Pair] = {}


def _pair(shared: Broadcast) -> Pair:
    """The two tokenizers, read once a worker."""
    if shared.value not in _loaded:
        _loaded.clear()
        _loaded[shared.value] = Pair(*shared.value)
        gc.freeze()  # the vocabularies stay: no need to look through them again and again
    return _loaded[shared.value]


_encoders: list[Encoder] = []


def _encoder(pair: Pair) -> Encoder:
    """The worker's memory, which a partition leaves empty."""
    if not _encoders or _encoders[0].pair is not pair:
        _encoders[:] = [Encoder(pair)]
    return _encoders[0]


def _read(spark: SparkSession, a_path: str, b_path: str) -> Broadcast:
    """Both files for all executors: their size is that of the two vocabularies."""
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        return spark.sparkContext.broadcast((f.read(), g.read()))


def diagonals(a: np.ndarray, b: np.ndarray, steps: int) -> np.ndarray:
    """Where the merge of two rising sequences stands, in ``a``, every ``steps`` steps: a
    binary search on all diagonals at once. Of equal ends the one of ``a`` goes first."""
    at = np.arange(0, len(a) + len(b), steps)
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        x, y = a[np.minimum(mid, len(a) - 1)], b[np.clip(at - 1 - mid, 0, len(b) - 1)]
        first = x <= y  # a[mid] is merged before this diagonal
        low = np.where(open_ & first, mid + 1, low)
        high = np.where(open_ & ~first, mid, high)
    return low


@dataclass
class Overlaps:
    """Overlapping tokens (places in A and in B) in the order of their bytes, and which of
    them close a group."""

    a: np.ndarray
    b: np.ndarray
    closes: np.ndarray


def overlaps(a: np.ndarray, b: np.ndarray, steps: int = STEPS) -> Overlaps:
    """All overlaps of the tokens that end at ``a`` and at ``b`` (rising, the last equal)."""
    if not len(a):
        none = np.zeros(0, dtype=np.int64)
        return Overlaps(none, none, none.astype(bool))
    total = len(a) + len(b)
    i = diagonals(a, b, steps)
    begin = np.arange(0, total, steps)
    j = begin - i
    far = np.int64(1) << 62
    a_, b_ = np.append(a, far), np.append(b, far)
    pieces = len(begin)
    out_a, out_b = np.empty((steps, pieces), dtype=np.int64), np.empty((steps, pieces), dtype=np.int64)
    emits, closes = np.zeros((steps, pieces), dtype=bool), np.zeros((steps, pieces), dtype=bool)
    # A piece that begins with the B end of a pair of equal ones must not emit it again.
    behind = np.where(i > 0, a_[np.maximum(i - 1, 0)], -1)
    for k in range(steps):
        x, y = a_[i], b_[j]
        left = x <= y
        out_a[k], out_b[k] = i, j
        closes[k] = x == y
        emits[k] = left | (behind != y)
        behind = np.where(left, x, behind)
        i, j = i + left, j + ~left
        np.minimum(i, len(a), out=i)
        np.minimum(j, len(b), out=j)
    live = begin[:, None] + np.arange(steps) < total
    held = (emits.T & live).ravel()
    return Overlaps(out_a.T.ravel()[held], out_b.T.ravel()[held], closes.T.ravel()[held])


class Encoder:
    """Tokens of the stretches a worker remembers."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        none = np.zeros(0, dtype=np.int32)
        self.ids = [none, none]  # by A and by B
        self.at = [np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)]

    def batch(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        """One batch of texts: its different stretches with their tokens, one after the
        other, and the stretches of each text by their place among them."""
        if len(self.number) > HELD or self.chars > HELD_CHARS:
            self.clear()
        rows = [self.pair.stretches(t or "") for t in texts]
        at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        each = list(chain.from_iterable(rows))
        known = self.number
        new = [p for p in dict.fromkeys(each) if p not in known]
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            found = self.pair.encode(new)
            self.chars += sum(map(len, new))
            for k in (0, 1):
                ids, begin = found[2 * k], found[2 * k + 1]
                self.at[k] = np.concatenate([self.at[k], self.at[k][-1] + begin[1:]])
                self.ids[k] = np.concatenate([self.ids[k], ids.astype(np.int32)])
        numbers, local = np.unique(np.array(list(map(known.__getitem__, each)), dtype=np.int64), return_inverse=True)
        out = {"at": at, "each": local}
        for k, name in enumerate("ab"):
            size = self.at[k][numbers + 1] - self.at[k][numbers]
            out[name] = self.ids[k][_spans(self.at[k][numbers], size)].astype(np.int64)
            out[f"{name}_at"] = np.concatenate([[0], np.cumsum(size)])
        return out


PACKED = ["at", "each", "a", "a_at", "b", "b_at"]


class Aligned:
    """One batch as it was written, merged: links of its different stretches."""

    def __init__(self, pair: Pair, packed: dict[str, np.ndarray]):
        self.at, self.each, a, self.a_at, b, self.b_at = (packed[k] for k in PACKED)
        self.a, self.b, self.pair = a, b, pair
        # Both sequences of a stretch have the same bytes, so they can follow one another.
        self.links = overlaps(np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b]))
        self.count = len(self.a_at) - 1
        owner = np.repeat(np.arange(self.count), np.diff(self.a_at))[self.links.a]
        self.link_at = np.searchsorted(owner, np.arange(self.count + 1))
        self.keys = a[self.links.a] * len(pair.b_size) + b[self.links.b]
        # A text is whole if every stretch of it is given back byte by byte.
        self.whole = _per_row(np.diff(self.a_at)[self.each] == 0, self.at) == 0

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums per text of a number per stretch, zero for texts that are not whole."""
        return np.where(self.whole, _per_row(values[self.each], self.at), 0)

    def per_stretch(self, values: np.ndarray) -> np.ndarray:
        return _per_row(values, self.link_at)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(pair keys, links) of the whole texts."""
        times = np.bincount(self.each[np.repeat(self.whole, np.diff(self.at))], minlength=self.count)
        times = np.repeat(times, np.diff(self.link_at))
        key, place = np.unique(self.keys[times > 0], return_inverse=True)
        order = np.argsort(place, kind="stable")
        starts = np.searchsorted(place[order], np.arange(len(key)))
        return key, np.add.reduceat(times[times > 0][order], starts) if len(key) else key

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        own = group_texts(self.pair, (self.a, self.a_at), (self.b, self.b_at), self.links)
        each, at = self.each.tolist(), self.at.tolist()
        return [";".join(map(own.__getitem__, each[x:y])) if ok else "" for x, y, ok in zip(at[:-1], at[1:], self.whole.tolist(), strict=True)]


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, rows), dtype=np.int64, count=len(rows)))])
    return np.array(list(chain.from_iterable(rows)), dtype=np.int64), at


def _per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values.astype(np.int64))])[at])


def group_texts(pair: Pair, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], links: Overlaps) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` for each stretch of (ids, where the stretches begin)."""
    (a, a_at), (b, b_at), (comma, bar, semi) = a, b, pair.names
    ends = np.flatnonzero(links.closes)
    a_last, b_last = links.a[ends], links.b[ends]
    a_text, b_text = comma[a], comma[b]
    a_text[a_last], b_text[b_last] = bar[a[a_last]], semi[b[b_last]]
    # An A token stands behind the B tokens of earlier groups, a B token behind its group's A.
    group_a = np.searchsorted(a_last, np.arange(len(a)))
    group_b = np.searchsorted(b_last, np.arange(len(b)))
    whole = np.empty(len(a) + len(b), dtype=object)
    whole[np.arange(len(a)) + np.concatenate([[0], b_last + 1])[group_a]] = a_text
    whole[np.arange(len(b)) + np.append(a_last + 1, 0)[group_b]] = b_text
    at, parts = (a_at + b_at).tolist(), whole.tolist()
    return ["".join(parts[x:y])[:-1] for x, y in zip(at[:-1], at[1:], strict=True)]


def _pack(packed: dict[str, np.ndarray]) -> bytes:
    """The arrays, each in the narrowest whole numbers that hold it, bounds as sizes."""
    parts = []
    for k in PACKED:
        v = np.diff(packed[k]) if k.endswith("at") else packed[k]
        v = v.astype(np.min_scalar_type(int(v.max()) if len(v) else 0))
        parts.append(struct.pack("<qB", len(v), v.itemsize) + v.tobytes())
    data = b"".join(parts)
    return struct.pack("<q", len(data)) + pa.compress(data, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    data = pa.decompress(blob[8:], struct.unpack_from("<q", blob)[0], codec="zstd", asbytes=True)
    out, at = {}, 0
    for k in PACKED:
        n, width = struct.unpack_from("<qB", data, at)
        v = np.frombuffer(data, f"<u{width}", n, at + 9).astype(np.int64)
        out[k] = np.concatenate([[0], np.cumsum(v)]) if k.endswith("at") else v
        at += 9 + n * width
    return out


def encoded(docs: DataFrame, shared: Broadcast, text_col: str, names: list[str]) -> DataFrame:
    """One row per batch of texts, written: the rows' other columns, and the packed tokens."""
    row = F.struct(*[F.col(f"`{c}`") for c in names], F.lit(0).alias("_")).alias("row")
    rows = docs.select(row, F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(shared)
        for batch in batches:
            packed = _pack(_encoder(pair).batch(batch.column(1).to_pylist()))
            held = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            zero = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), pa.array(np.zeros(batch.num_rows, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([held, pa.array([packed], pa.binary()), zero, zero], names=["rows", "packed", "n_best", "count_sum"])
        _encoder(pair).clear()

    each = T.StructType([T.StructField("rows", T.ArrayType(rows.schema["row"].dataType))])
    more = T._parse_datatype_string("packed binary, n_best array<bigint>, count_sum array<bigint>")
    return written(rows.mapInArrow(run, T.StructType([*each.fields, *more.fields])))


def _unpacked(pair: Pair, batch: pa.RecordBatch) -> Iterator[tuple[int, Aligned]]:
    for r in range(batch.num_rows):
        yield r, Aligned(pair, _unpack(batch.column("packed")[r].as_py()))


def marked_counts(found: DataFrame, shared: Broadcast, width: int) -> DataFrame:
    """(key, n, best) of every linked id pair, written: its links over the corpus, added up
    by batch and partition before they move, and whether its B id has no pair with more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, m in _unpacked(_pair(shared), batch):
                key, n = m.counts()
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    counted = found.select("packed").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    counted = written(counted.withColumn("b", F.col("key") % width))
    top = counted.groupBy("b").agg(F.max("n").alias("top"))
    return written(counted.join(top, "b").select("key", "n", (F.col("n") == F.col("top")).alias("best")))


def _looked_up(found: DataFrame, shared: Broadcast, table: Broadcast, last: bool) -> DataFrame:
    """The batches with the links added up whose pairs are in the table; at last row by row,
    with sizes and groups."""
    row, columns = found.schema["rows"].dataType.elementType, found.columns
    done = T.StructType([T.StructField("row", row), *T._parse_datatype_string(", ".join(f"{c} {'string' if c == 'groups' else 'bigint'}" for c in COLUMNS)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(shared)
        keys, counts, best = table.value
        for batch in batches:
            sums: list[list] = [[], []]
            for r, m in _unpacked(pair, batch):
                place = np.minimum(np.searchsorted(keys, m.keys), max(0, len(keys) - 1))
                here = keys[place] == m.keys if len(keys) else np.zeros(len(m.keys), dtype=bool)
                two = [m.per_text(m.per_stretch(np.where(here, v[place], 0) if len(keys) else m.keys * 0)) for v in (best, counts)]
                two = [v + batch.column(c)[r].values.to_numpy() for v, c in zip(two, ("n_best", "count_sum"), strict=True)]
                if last:
                    links, closes = np.diff(m.link_at), m.per_stretch(m.links.closes)
                    sizes = [m.per_text(v) for v in (np.diff(m.a_at), np.diff(m.b_at), closes, links)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("rows")[r].values, *[pa.array(v) for v in (*sizes, *two)], pa.array(m.groups(), pa.string())], names=done.names
                    )
                else:
                    for held, v in zip(sums, two, strict=True):
                        held.append(v)
            if not last:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *[pa.array(v, pa.list_(pa.int64())) for v in sums]], names=columns)

    return found.mapInArrow(run, done if last else found.schema)


def aligned(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", keep: list[str] | None = None, slice_pairs: int = SLICE) -> DataFrame:
    """``docs`` with the groups of both tokenizations and the counts of their links.

    ``n_best`` counts the links whose id pair is linked as often, over all rows, as any of
    its B id; ``count_sum`` adds up the pairs' counts. A text that is null or empty, or that
    one of the tokenizers does not give back byte by byte, has no tokens: zeros and an
    empty ``groups``. Null and repeated ids are not read. ``keep`` names the columns that
    stay, all by default; those named like ``COLUMNS`` are replaced.
    """
    spark = docs.sparkSession
    bound_batches(spark, rows=1000, size="2m")
    shared = _read(spark, a_path, b_path)
    names = without(docs.select(*[F.col(f"`{c}`") for c in docs.columns if keep is None or c in keep]), COLUMNS).columns
    found = encoded(docs, shared, text_col, names)
    counts = marked_counts(found, shared, sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size())
    passes = max(1, -(-counts.count() // slice_pairs))
    for k in range(passes):
        own = counts.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == k).toArrow().sort_by("key")
        table = spark.sparkContext.broadcast(tuple(own[c].to_numpy() for c in ("key", "n", "best")))
        found = _looked_up(found, shared, table, k == passes - 1)
        found = found if k == passes - 1 else written(found)
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in names], *COLUMNS)
