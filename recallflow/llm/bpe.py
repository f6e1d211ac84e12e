"""Byte-pair encoding by speculation: propose, verify, repair.

Greedy longest match proposes the tokens of a word. A proposal is the exact encoding if and
only if every adjacent pair of its tokens is compatible, that is, if merging the two
tokens' characters alone gives those two tokens back. All pairs of a batch are tested at
once against a table of known pairs; only the words with an incompatible pair are merged
exactly, all of them side by side (``merges.py``).
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Regex, Tokenizer, pre_tokenizers

from recallflow.llm.common import appended, bound_batches
from recallflow.llm.merges import Merges

CACHE = 150_000  # words and pairs a worker remembers; beyond it the memory starts anew
# Up to here letter classes, lower case and composition are the same in every Unicode
# version in use; other texts are split by the tokenizer library's own two first steps.
_LATER = re.compile(r"[^\x00-\u052F]")
_SPACE = r"\x09-\x0D\x20\x85\xA0"


def _kind(letter: str) -> str:
    """Regular-expression ranges of the letters (L) or numbers (N) up to U+052F."""
    held = [unicodedata.category(chr(c))[0] == letter for c in range(0x530)] + [False]
    edges = [c for c in range(0x531) if held[c] != (c > 0 and held[c - 1])]
    return "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in zip(edges[::2], edges[1::2], strict=True))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte value."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, extra = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + extra)
            extra += 1
    return [table[b] for b in range(256)]


class Vocabulary:
    """A vocabulary file with word ends, and what has been learnt about its words."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, special = spec["model"], {a["content"]: a["id"] for a in spec["added_tokens"]}
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.names = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for t, i in [*vocab.items(), *special.items()]:
            self.names[i] = t
        self.special = special
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in special) + ")") if special else None
        value = {s: b for b, s in enumerate(byte_symbols())}
        spelled, ends = [b""] * len(self.names), [False] * len(self.names)
        for t, i in vocab.items():
            if t not in special:
                ends[i] = t.endswith(suffix)
                spelled[i] = bytes(value[c] for c in t.removesuffix(suffix))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = Merges(spelled, ends, [(vocab[x], vocab[y], vocab[x + y]) for x, y in pairs])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        self.word = re.compile(pattern.replace(r"[\p{L}]", f"[{_kind('L')}]").replace(r"[\p{N}]", f"[{_kind('N')}]").replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACE}{_kind('L')}{_kind('N')}]"))
        self.normalizer = Tokenizer.from_str(text).normalizer
        self.splitter = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.words: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.pairs: dict[int, bool] = {}

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """Whether each distinct pair (left * 2^20 + right) survives exact merging."""
        if len(self.pairs) > CACHE:
            self.pairs.clear()
        known = list(map(self.pairs.get, keys.tolist()))
        new = np.array([k is None for k in known], dtype=bool)
        out = np.array([bool(k) for k in known], dtype=bool)
        out[new] = self.merges.stable(keys[new] >> 20, keys[new] & 0xFFFFF)
        self.pairs.update(zip(keys[new].tolist(), out[new].tolist(), strict=True))
        return out

    def learn(self, words: list[str]) -> None:
        """Encode words not seen before: propose all, test all pairs, merge the failures."""
        if not words:
            return
        forms = [w.encode("utf-8", "replace") for w in words]
        tokens, size = self.merges.propose(*self.merges.spell(forms))
        owner = np.repeat(np.arange(len(words)), size)
        inside = owner[1:] == owner[:-1]
        wide = tokens.astype(np.int64)
        keys, place = np.unique((wide[:-1] << 20 | wide[1:])[inside], return_inverse=True)
        bad = ~self.compatible(keys)[place]
        failed = np.zeros(len(words), dtype=bool)
        failed[owner[1:][inside][bad]] = True
        self._keep([w for w, f in zip(words, failed.tolist(), strict=True) if not f], tokens[~failed[owner]], size[~failed])
        again = [forms[k] for k in np.flatnonzero(failed).tolist()]
        if again:
            self._keep([w for w, f in zip(words, failed.tolist(), strict=True) if f], *self.merges.exact(*self.merges.spell(again)))

    def _keep(self, words: list[str], tokens: np.ndarray, size: np.ndarray) -> None:
        data, ends = tokens.astype(np.int32).tobytes(), (4 * np.cumsum(size)).tolist()
        self.words.update(zip(words, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def split(self, text: str) -> list[str | int]:
        """Words of a text; a special token stands as its id."""
        out: list[str | int] = []
        for k, part in enumerate(self.cut.split(text) if self.cut and "<" in text else [text]):
            if k % 2:
                out.append(self.special[part])
                continue
            # composed first: marks may join into letters beyond the range
            whole = part if part.isascii() else unicodedata.normalize("NFC", part)
            if _LATER.search(part) or _LATER.search(whole):
                out.extend(w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part)))
                continue
            part = whole
            # letter by letter where a final sigma would depend on its neighbours
            part = "".join(c.lower() for c in part) if "Σ" in part else part.lower()
            out.extend(self.word.findall(part))
        return out

    def forget(self) -> None:
        self.words, self.pairs = {}, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > CACHE:
            self.words.clear()
        pieces = [self.split(t) for t in texts]
        fresh = {w for ws in pieces for w in ws if w.__class__ is str}
        self.learn([w for w in fresh if w not in self.words])
        get, own = self.words.__getitem__, {i: array("i", [i]).tobytes() for i in self.special.values()}
        return [
            np.frombuffer(b"".join([get(w) if w.__class__ is str else own[w] for w in ws]), dtype=np.int32) for ws in pieces
        ]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(text: str) -> Vocabulary:
    """The vocabulary of a file's text, read once per worker."""
    if text not in _loaded:
        _loaded.clear()
        _loaded[text] = Vocabulary(text)
    return _loaded[text]


_names: dict[str, pa.Array] = {}


def _name_array(text: str) -> pa.Array:
    """Name of every token id of a vocabulary file."""
    spec = json.loads(text)
    held = {**{i: t for t, i in spec["model"]["vocab"].items()}, **{t["id"]: t["content"] for t in spec["added_tokens"]}}
    return pa.array([held.get(i, "") for i in range(max(held) + 1)], pa.string())


def _read(spark: SparkSession, path: str):
    """The file's text for all executors: its size is that of one vocabulary."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, path: str, name: str = "ids") -> DataFrame:
    """``docs`` with the token ids of the whole text; null text: none."""
    bound_batches(docs.sparkSession, rows=500, size="2m")
    shared = _read(docs.sparkSession, path)

    def run(column: pa.Array) -> list[pa.Array]:
        rows = vocabulary(shared.value).encode([t or "" for t in column.to_pylist()])
        at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int32()))]

    return appended(docs, "text", run, [(name, "array<int>")], lambda: vocabulary(shared.value).forget())


def decoded(rows: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``rows`` with the text of the ids: token names with a space between. Null ids: null."""
    shared = _read(rows.sparkSession, path)

    def run(column: pa.Array) -> list[pa.Array]:
        if shared.value not in _names:
            _names[shared.value] = _name_array(shared.value)
        names = _names[shared.value].take(column.flatten())
        size = column.value_lengths().fill_null(0).to_numpy()
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), names)
        return [pc.if_else(column.is_valid(), pc.binary_join(lists, " "), pa.scalar(None, pa.string()))]

    return appended(rows, ids, run, [(name, "string")])
