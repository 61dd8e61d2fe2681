"""Token ids of words by the merges of a word-level byte-pair vocabulary, many words at once.

Merging happens as the vocabulary says: the pair of lowest rank, leftmost first, until none is
left. Numpy does one merge in every word of a batch per step.
"""

from __future__ import annotations

import json

import numpy as np

SLOTS = 1 << 18
LONGEST = 48  # bytes; longer words are left to the tokenizer itself


class WordPieces:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        others = iter(range(256, 512))
        sign = {b: chr(b) if b in shown else chr(next(others)) for b in range(256)}
        self.first = np.array([vocab[sign[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[sign[b] + suffix] for b in range(256)], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.keys = np.full(SLOTS, -1, dtype=np.int64)
        self.rank = np.full(SLOTS + 1, len(pairs), dtype=np.int32)
        self.merged = np.zeros(SLOTS, dtype=np.int64)
        for rank, (a, b) in enumerate(pairs):
            key = vocab[a] << 16 | vocab[b]
            slot = (key * 0x9E3779B1 >> 7) % SLOTS
            while self.keys[slot] >= 0:
                slot = (slot + 1) % SLOTS
            self.keys[slot], self.rank[slot], self.merged[slot] = key, rank, vocab[a + b]
        self.none = len(pairs)

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The table's slot of each pair; SLOTS where the pair has no merge."""
        key = a << 16 | b
        slot = (key * 0x9E3779B1 >> 7) % SLOTS
        found = self.keys[slot]
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % SLOTS
            found[open_] = self.keys[slot[open_]]
            open_ = open_[(found[open_] != key[open_]) & (found[open_] >= 0)]
        slot[(found != key) | (b < 0)] = SLOTS
        return slot

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n, size = len(words), np.array([len(w) for w in words])
        width = int(size.max())
        symbols = np.full((n, width + 1), -1, dtype=np.int64)
        inside = np.arange(width + 1) < size[:, None]
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols[inside] = self.first[data]
        symbols[np.arange(n), size - 1] = self.last[data[np.cumsum(size) - 1]]
        slots = self._slots(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, width)
        out = symbols.copy()
        at = np.arange(n)  # the words that are still being merged
        columns = np.arange(width)
        while True:
            rank = self.rank[slots]
            best = rank.argmin(axis=1)
            row = np.arange(len(at))
            go = rank[row, best] < self.none
            if not go.all():
                done = ~go
                out[at[done]] = symbols[done]
                at, symbols, slots, best = at[go], symbols[go], slots[go], best[go]
                row = np.arange(len(at))
            if not len(at):
                return out, (out >= 0).sum(axis=1)
            symbols[row, best] = self.merged[slots[row, best]]
            after = columns[None] > best[:, None]
            symbols[:, :-1] = np.where(after, np.roll(symbols, -1, axis=1)[:, :-1], symbols[:, :-1])
            symbols[:, -1] = -1
            slots = np.where(after, np.roll(slots, -1, axis=1), slots)
            slots[:, -1] = SLOTS
            slots[row, best] = self._slots(symbols[row, best], symbols[row, best + 1])
            left = np.flatnonzero(best > 0)
            slots[left, best[left] - 1] = self._slots(symbols[left, best[left] - 1], symbols[left, best[left]])

    def encode(self, words: list[str]) -> dict[str, bytes]:
        """Ids of lower-case words of letters, as little-endian 32-bit numbers; without the longest words."""
        raw = sorted(((w, w.encode()) for w in words), key=lambda p: len(p[1]))
        raw = [p for p in raw if len(p[1]) <= LONGEST]
        known: dict[str, bytes] = {}
        for first in range(0, len(raw), 4096):
            part = raw[first: first + 4096]
            symbols, count = self._merge([b for _, b in part])
            flat = symbols[np.arange(symbols.shape[1]) < count[:, None]].astype("<u4").tobytes()
            end = np.cumsum(count) * 4
            known.update(
                (word, flat[a:b]) for (word, _), a, b in zip(part, (end - 4 * count).tolist(), end.tolist())
            )
        return known
