"""Best-fit packing of documents into sequences of a fixed number of tokens, by linear grouping.

Only how many pieces there are of each length decides the packing, and that is a table of at most
``capacity`` rows whatever the number of documents. From it the driver makes a plan:

1. Pieces of more than an eighth of the capacity, sorted by length, fall into groups of equally
   many, and count as long as the longest of their group.
2. For these few sizes the best mix of configurations (how many pieces of each size go into one
   sequence) is a small linear programme, solved by column generation; multiples are rounded down.
3. Actual pieces take the places of their groups, which leaves them room.
4. All other pieces, longest first, go where the least room is left; new sequences are opened when
   there is none.

The plan is kept as ranges: sequences from-to hold so many pieces of each length. Its size depends
on the capacity, not on the data. Pieces are numbered within their length by task and position, and
each finds its range by a binary search. Texts are tokenised once, each distinct word once per
worker as long as it is remembered; nothing but the counts comes to the driver.

Null texts count as empty and take one place, for the end token. Repeated rows are packed one by
one, an empty table gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from unicodedata import normalize
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeshare.llm.common import stored
from placeshare.llm.wordpieces import WordPieces

CAPACITY, END = 4096, 1
GROUPS, UNIT = 24, 8
#: words of lower-case Latin letters, for which lower case and normal form are what they are
LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
REMEMBERED = 400_000
#: signs that form a token run of their own after a letter
AFTER = ".,;:!?*#$%&"


class Tokeniser:
    """Token ids of texts as bytes, word by word.

    The vocabulary drops white space and never joins across it, so a text's ids are those of its
    words. Signs after a word are a run of their own and split off. What is left is merged here if
    it is a lower-case word of Latin letters, and by the tokenizer otherwise.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model, self.pieces = Tokenizer.from_file(path), WordPieces(path)
        self.stems: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    @staticmethod
    def split(word: str) -> tuple[str, str]:
        stem = word.rstrip(AFTER)
        low = stem.lower()
        if low.isascii() or LATIN(low):
            return (word, "") if stem and not low[-1].isalpha() else (low, word[len(stem):])
        # lower case and normal form can end in a mark where the letter was, and marks join the signs after them
        return (stem, word[len(stem):]) if normalize("NFC", stem).lower()[-1].isalpha() else (word, "")

    def batch(self, texts: list[str | None]) -> Iterator[bytes]:
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if len(self.stems) > REMEMBERED:
            self.stems.clear()
        known, stems = self.words, self.stems
        lists = [(t or "").replace("\n", " ").split(" ") for t in texts]
        new = {w: self.split(w) for w in {w for words in lists for w in words if w not in known}}
        parts = {p for pair in new.values() for p in pair if p not in stems}
        stems.update(self.pieces.encode([p for p in parts if LATIN(p)]))
        parts = [p for p in parts if p not in stems]
        for part, e in zip(parts, self.model.encode_batch_fast(parts, add_special_tokens=False)):
            stems[part] = np.array(e.ids, dtype="<u4").tobytes()
        for word, (stem, after) in new.items():
            known[word] = stems[stem] + stems[after] if after else stems[stem]
        for words in lists:
            yield b"".join([known[w] for w in words])


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    tokeniser, end = Tokeniser(path), np.array([END], dtype="<u4").tobytes()
    part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
    step = 4 * capacity
    for batch in batches:
        ids, texts = batch["doc_id"].to_pylist(), batch["text"]
        for first in range(0, batch.num_rows, 1024):
            rows = []
            for i, data in enumerate(tokeniser.batch(texts.slice(first, 1024).to_pylist()), first):
                data += end
                for piece, at in enumerate(range(0, len(data), step)):
                    length = min(step, len(data) - at) // 4
                    rows.append((ids[i], piece, at // 4, length, crc32(data[at: at + step]), part, int(seen[length])))
                    seen[length] += 1
            columns = list(zip(*rows))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations of ``sizes`` and how often to use each (rounded down), by column generation.

    The number of rounds is bounded; a plan that ends there is as valid, but may take more sequences.
    """
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(40 * k):
        price = np.linalg.solve(basis.T, np.ones(k))
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(1, capacity + 1):
            fits = np.flatnonzero(sizes <= c)
            best[c] = best[c - 1]
            if len(fits):
                value = best[c - sizes[fits]] + price[fits]
                top = int(value.argmax())
                if value[top] > best[c]:
                    best[c], last[c] = value[top], fits[top]
        if best[capacity] <= 1 + 1e-9:
            break
        pattern, c = np.zeros(k), capacity
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                pattern[last[c]] += 1
                c -= sizes[last[c]]
        amount, turn = np.linalg.solve(basis, demand), np.linalg.solve(basis, pattern)
        ratio = np.where(turn > 1e-12, amount / np.where(turn > 1e-12, turn, 1), np.inf)
        basis[:, int(ratio.argmin())] = pattern
    amount = np.linalg.solve(basis, demand)
    return [(basis[:, j].astype(int), int(amount[j] + 1e-6)) for j in range(k) if amount[j] >= 1 - 1e-6]


class Runs:
    """Sorted pieces as (length, count) runs, taken from the front."""

    def __init__(self, runs: list[tuple[int, int]]):
        self.runs = runs[::-1]

    def take(self, n: int) -> list[tuple[int, int]]:
        out = []
        while n and self.runs:
            length, count = self.runs.pop()
            used = min(n, count)
            out.append((length, used))
            n -= used
            if used < count:
                self.runs.append((length, count - used))
        return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> np.ndarray:
    """Rows (length, first number, pieces, first sequence, pieces per sequence, offset), by length and number."""
    room: list[list[tuple[int, int, tuple]]] = [[] for _ in range(capacity + 1)]
    used = 0

    def add(low: int, high: int, held: tuple) -> None:
        room[capacity - sum(n * k for n, k in held)].append((low, high, held))

    large = sorted(((n, c) for n, c in counts.items() if capacity // 8 < n < capacity), reverse=True)
    rest = {n: c for n, c in counts.items() if n <= capacity // 8}
    if counts.get(capacity):
        used = counts[capacity]
        add(0, used, ((capacity, 1),))
    if large:
        total = sum(c for _, c in large)
        source = Runs(large)
        shares = [total * (g + 1) // groups - total * g // groups for g in range(groups)]
        members = [m for m in (source.take(s) for s in shares) if m]
        sizes = np.array([-(-m[0][0] // UNIT) for m in members])
        demand = np.array([float(sum(c for _, c in m)) for m in members])
        pools = [Runs(m) for m in members]
        for pattern, times in configurations(sizes, demand, capacity // UNIT):
            times = min([times, *(sum(c for _, c in pools[g].runs) // n for g, n in enumerate(pattern) if n)])
            if times < 1:
                continue
            slots = []
            for g, n in enumerate(pattern):
                for s in range(n):
                    taken = pools[g].take(times)
                    slots.append(taken[::-1] if s % 2 else taken)
            at, heads = 0, [list(s)[::-1] for s in slots]
            while at < times:
                step = min(h[-1][1] for h in heads)
                held: dict[int, int] = {}
                for h in heads:
                    length, count = h.pop()
                    held[length] = held.get(length, 0) + 1
                    if count > step:
                        h.append((length, count - step))
                add(used + at, used + at + step, tuple(held.items()))
                at += step
            used += times
        for pool in pools:
            for length, count in pool.runs:
                rest[length] = rest.get(length, 0) + count
    open_room = np.array([len(r) for r in room])
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            fits = np.flatnonzero(open_room[length:])
            if not len(fits):
                each = min(n, capacity // length)
                bins = n // each
                used += bins
                room[capacity - each * length].append((used - bins, used, ((length, each),)))
                open_room[capacity - each * length] += 1
                n -= bins * each
                continue
            gap = length + int(fits[0])
            low, high, held = room[gap].pop()
            open_room[gap] -= 1
            each = min(n, gap // length)
            bins = min(high - low, n // each)
            if low + bins < high:
                room[gap].append((low + bins, high, held))
                open_room[gap] += 1
            room[gap - each * length].append((low, low + bins, (*held, (length, each))))
            open_room[gap - each * length] += 1
            n -= bins * each
    number = {n: 0 for n in counts}
    rows = []
    for low, high, held in sorted(s for r in room for s in r):
        offset = 0
        for length, each in held:
            rows.append((length, number[length], each * (high - low), low, each, offset))
            number[length] += each * (high - low)
            offset += each * length
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def _placed(batches: Iterator[pa.RecordBatch], chosen) -> Iterator[pa.RecordBatch]:
    rows = chosen.value
    keys = rows[:, 0] * (1 << 48) + rows[:, 1]
    for batch in batches:
        length, number = batch["length"].to_numpy(), batch["number"].to_numpy()
        row = rows[np.searchsorted(keys, length * (1 << 48) + number, "right") - 1] if len(rows) else rows
        inner = number - row[:, 1]
        columns = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(row[:, 3] + inner // row[:, 4]), pa.array(row[:, 5] + inner % row[:, 4] * length)],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of every document: where its tokens go. ``tokenizer``: path of a vocabulary file."""
    spark = docs.sparkSession
    pieces = stored(
        docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
            partial(_pieces, path=tokenizer, capacity=capacity),
            "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long",
        ), "pieces",
    )
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    chosen = spark.sparkContext.broadcast(plan(counts, capacity))
    return pieces.join(offsets, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("number"),
    ).mapInArrow(
        partial(_placed, chosen=chosen),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
