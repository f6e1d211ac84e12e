"""Byte-pair merging and greedy matching of many words at once.

Words are sequences of symbols 0 to 511: a byte, or 256 more for the byte that ends a word.
All words advance together; a step is a handful of vector operations.
"""

from __future__ import annotations

import heapq

import numpy as np

SYMBOLS = 512
NONE = np.int32(2**31 - 1)
WIDTHS = (4, 8, 16, 32, 64, 128)  # longer words are merged one by one with a heap


class Lookup:
    """Open addressing from distinct non-negative numbers to numbers; -1 for strangers."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.mask, self.shift = np.int64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = first[free[first]]
            self.keys[slot[put]], self.values[slot[put]] = keys[left[put]], values[left[put]]
            stay = np.ones(len(left), dtype=bool)
            stay[put] = False
            left, slot = left[stay], (slot[stay] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held, out = self.keys[slot], self.values[slot]
        left = np.flatnonzero((held != keys) & (held >= 0))
        out[held < 0] = -1
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            held = self.keys[slot]
            out[left] = np.where(held == keys[left], self.values[slot], -1)
            more = (held != keys[left]) & (held >= 0)
            left, slot = left[more], slot[more]
        return out


class Merges:
    """``spelled`` are the symbols of each token id (empty: not a token), ``pairs`` the
    merges (left id, right id, made id) in their order."""

    def __init__(self, spelled: list[bytes], ends: list[bool], pairs: list[tuple[int, int, int]]):
        words = [np.frombuffer(t, dtype=np.uint8).astype(np.int64) for t in spelled]
        for w, end in zip(words, ends, strict=True):
            if end and len(w):
                w[-1] += 256
        self.at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        self.symbols = np.concatenate(words)
        self.base = np.full(SYMBOLS, -1, dtype=np.int32)
        states, keys, token = {}, [], [-1]  # a state is a prefix of a token
        for i, w in enumerate(words):
            state = 0
            for c in w.tolist():
                key = state * SYMBOLS + c
                if key not in states:
                    states[key] = len(token)
                    keys.append(key)
                    token.append(-1)
                state = states[key]
            if len(w):
                token[state] = i
            if len(w) == 1:
                self.base[w[0]] = i
        self.token = np.array(token, dtype=np.int32)
        self.trie = Lookup(np.array(keys, dtype=np.int64), np.arange(1, len(token), dtype=np.int32))
        self.made = np.array([m for _, _, m in pairs], dtype=np.int32)
        self.rank = {x << 20 | y: r for r, (x, y, _) in enumerate(pairs)}
        self.ranks = Lookup(np.fromiter(self.rank, dtype=np.int64), np.fromiter(self.rank.values(), dtype=np.int32))

    @staticmethod
    def spell(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of non-empty words, one after the other, and their places."""
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))])
        flat = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        flat[at[1:] - 1] += 256
        return flat, at

    def propose(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match: (tokens, their number per word)."""
        out, taken = np.zeros(len(flat), dtype=np.int32), np.zeros(len(flat), dtype=bool)
        begin, stop = at[:-1].copy(), at[1:].copy()
        pos, end = begin.copy(), begin.copy()
        state, best = np.zeros(len(begin), dtype=np.int64), np.full(len(begin), -1, dtype=np.int32)
        while len(begin):
            inside = pos < stop
            after = self.trie(state * SYMBOLS + flat[np.where(inside, pos, 0)])
            go = inside & (after >= 0)
            found = np.where(go, self.token[after], -1)
            best = np.where(found >= 0, found, best)
            end = np.where(found >= 0, pos + 1, end)
            out[begin[~go]] = best[~go]
            taken[begin[~go]] = True
            state = np.where(go, after, 0)
            pos, begin = np.where(go, pos + 1, end), np.where(go, begin, end)
            if (done := begin == stop).any():
                begin, stop, pos, end, state, best = (v[~done] for v in (begin, stop, pos, end, state, best))
        return out[taken], np.add.reduceat(taken.astype(np.int64), at[:-1]) if len(at) > 1 else np.zeros(0, dtype=np.int64)

    def exact(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact encoding, the pair of least rank, leftmost first: (tokens, number per word)."""
        size = np.diff(at)
        out, count = np.empty(len(flat), dtype=np.int32), np.zeros(len(size), dtype=np.int64)
        low = 0
        for width in WIDTHS:
            own = np.flatnonzero((size > low) & (size <= width))
            low = width
            for k in range(0, len(own), max(1, (1 << 19) // width)):
                self._matrix(flat, at, own[k : k + max(1, (1 << 19) // width)], width, out, count)
        for w in np.flatnonzero(size > low).tolist():
            found = self._long(self.base[flat[at[w] : at[w + 1]]].tolist())
            out[at[w] : at[w] + len(found)], count[w] = found, len(found)
        keep = np.arange(len(flat)) - np.repeat(at[:-1], size) < np.repeat(count, size)
        return out[keep], count

    def _pair(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        found = self.ranks(np.where((x >= 0) & (y >= 0), x.astype(np.int64) << 20 | y, 1 << 50))
        return np.where(found >= 0, found, NONE)

    def _matrix(self, flat: np.ndarray, at: np.ndarray, own: np.ndarray, width: int, out: np.ndarray, count: np.ndarray) -> None:
        """Words of up to ``width`` symbols, a row each."""
        size = at[own + 1] - at[own]
        cols = np.arange(width)
        part = np.where(cols < size[:, None], self.base[flat[np.minimum(at[own, None] + cols, len(flat) - 1)]], -1)
        rank = self._pair(part[:, :-1].ravel(), part[:, 1:].ravel()).reshape(len(own), width - 1)
        while len(own):
            place = rank.argmin(axis=1)
            least = rank[np.arange(len(own)), place]
            if (done := least == NONE).any():
                held = part[done] >= 0
                number = held.sum(axis=1)
                where = np.repeat(at[own[done]], number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                out[where], count[own[done]] = part[done][held], number
                own, part, rank, place, least = (v[~done] for v in (own, part, rank, place, least))
                if not len(own):
                    return
            rows = np.arange(len(own))
            part[rows, place] = self.made[least]
            behind = cols[:-1] > place[:, None]
            part[:, :-1] = np.where(behind, part[:, 1:], part[:, :-1])
            part[:, -1] = -1
            rank[:, :-1] = np.where(behind[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            rank[rows, np.minimum(place, width - 2)] = self._pair(part[rows, place], part[rows, np.minimum(place + 1, width - 1)])
            first = np.flatnonzero(place > 0)
            rank[first, place[first] - 1] = self._pair(part[first, place[first] - 1], part[first, place[first]])

    def _long(self, part: list[int]) -> list[int]:
        n, get = len(part), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(part[i] << 20 | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if part[i] < 0 or j >= n or get(part[i] << 20 | part[j]) != r:
                continue
            part[i], part[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := get(part[x] << 20 | part[y])) is not None:
                    heapq.heappush(heap, (r, x))
        return [p for p in part if p >= 0]

    def stable(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether exact merging of the symbols of tokens x and y gives those two back."""
        sizes = np.stack([self.at[x + 1] - self.at[x], self.at[y + 1] - self.at[y]], axis=1).ravel()
        start = np.stack([self.at[x], self.at[y]], axis=1).ravel()
        at = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.symbols[np.repeat(start - at[:-1], sizes) + np.arange(at[-1])]
        tokens, count = self.exact(flat, at[::2])
        first = np.cumsum(count) - count
        second = np.minimum(first + 1, max(0, len(tokens) - 1))
        return (count == 2) & (tokens[first] == x) & (tokens[second] == y) if len(x) else np.zeros(0, dtype=bool)
