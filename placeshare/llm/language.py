"""Language identification by cross-parsing: how few pieces of known text make up a new one.

Per language, a suffix automaton is built over a sample of its labelled text. A text is parsed
from left to right into the longest phrases that occur in that sample; a sign that does not occur
is a phrase of its own. The language with the fewest phrases, times the logarithm of its sample's
length (the bits it takes to point at a phrase), wins; ties go to the smaller name.

Letters are lower-cased and all else is one separator. Long texts are parsed in segments of
``SEGMENT`` signs side by side, so every sign counts and one more phrase may arise at each cut.
Numpy follows the automata of all languages for many segments at once.

Samples are bounded: ``documents`` texts per language, picked by hash (of one with more than ``clip``
characters, pieces from all over it), of at most ``sample`` signs
together. Null texts and texts without letters are ``und`` with score 0. Without any sample all
texts are. Labels that are null or whose sample has no letters do not count. The score is the
runner-up's phrases over the sum of both (1.0 with one language). Repeated rows get the same
answer, extra columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeshare.llm.common import hash_order, labelled_sample

SEGMENT = 1024
LANES = 1 << 14
SYMBOLS = 96
UNKNOWN = "und"


def suffix_automaton(signs: list[int], symbols: int) -> np.ndarray:
    """Transitions (state, sign) -> state, -1 where there is none, of all substrings of ``signs``."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in signs:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    table = np.full((len(moves), symbols), -1, dtype=np.int32)
    for state, out in enumerate(moves):
        for c, to in out.items():
            table[state, c] = to
    return table


def sparse(table: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """A table of transitions by those that exist: a fraction of its size to send around."""
    at = np.flatnonzero(table.ravel() >= 0).astype(np.int32)
    return table.size, at, table.ravel()[at]


def dense(size: int, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    table = np.full(size, -1, dtype=np.int32)
    table[at] = to
    return table.reshape(-1, SYMBOLS)


def letter_classes(samples: list[str], symbols: int = SYMBOLS) -> np.ndarray:
    """For each code point up to 65,535 its class: 0 for all but letters, rare letters share classes."""
    common = [c for c, _ in Counter(c for s in samples for c in s.lower() if c.isalpha()).most_common(symbols - 17)]
    number = {c: i + 1 for i, c in enumerate(common)}
    classes = np.zeros(65536, dtype=np.uint8)
    for code in range(65536):
        c = chr(code)
        if c.isalpha():
            low = c.lower()[:1]
            classes[code] = number.get(low, symbols - 16 + ord(low) % 16)
    return classes


def signs_of(text: str, classes: np.ndarray) -> np.ndarray:
    """Classes of a text's signs, one separator for each run of others; empty if it has no letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = classes[np.minimum(codes, 65535)]
    high = np.flatnonzero(codes > 65535)
    if len(high):
        out[high] = [SYMBOLS - 16 + int(c) % 16 if chr(c).isalpha() else 0 for c in codes[high]]
    if not out.any():
        return out[:0]
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


class Parser:
    """Follows several automata over many segments at once."""

    def __init__(self, tables: list[np.ndarray]):
        symbols = tables[0].shape[1]
        offset = np.cumsum([0, *(t.size for t in tables)])
        flat = []
        for t, o in zip(tables, offset):  # states become places in the joint table
            flat.append(np.where(t >= 0, t.astype(np.int64) * symbols + o, -1).astype(np.int32).ravel())
        self.moves = np.concatenate(flat)
        self.root = offset[:-1].astype(np.int32)
        first = np.stack([t[0] for t in tables]).astype(np.int64)
        self.first = np.where(first >= 0, first * symbols + self.root[:, None], self.root[:, None]).astype(np.int32)

    def phrases(self, signs: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Phrases of each segment (column) by each automaton (row)."""
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        state = np.repeat(self.root[:, None], len(start), axis=1)
        count = np.zeros(state.shape, dtype=np.int32)
        active = len(start)
        for j in range(int(length[0]) if len(length) else 0):
            while length[active - 1] <= j:
                active -= 1
            sign = signs[start[:active] + j]
            to = self.moves[state[:, :active] + sign]
            miss = to < 0
            count[:, :active] += miss
            np.copyto(to, self.first[:, sign], where=miss)
            state[:, :active] = to
        count += state != self.root[:, None]
        out = np.empty_like(count)
        out[:, order] = count
        return out


def fit(docs: DataFrame, train: Column, documents: int = 64, sample: int = 40_000, clip: int = 4000) -> dict:
    """Automata from the texts for which ``train`` (of ``doc_id``) holds and ``lang`` is known."""
    usable = docs.where(train & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*hash_order()))
    ids = usable.select("doc_id", "lang").withColumn("rank", rank).where(F.col("rank") <= documents)
    rows = sorted(labelled_sample(docs, ids.select("doc_id", "lang").distinct(), clip), key=lambda r: (r.lang, r.doc_id))
    texts: dict[str, str] = {}
    for r in rows:
        texts[r.lang] = texts.get(r.lang, "") + r.text + "\n"
    classes = letter_classes(list(texts.values()))
    signs = {lang: signs_of(t, classes)[:sample] for lang, t in texts.items()}
    langs = sorted(lang for lang, s in signs.items() if len(s))
    return {
        "langs": langs, "classes": classes,
        "tables": [sparse(suffix_automaton(signs[lang].tolist(), SYMBOLS)) for lang in langs],
        "bits": np.array([np.log2(len(signs[lang]) + 1) for lang in langs]),
    }


def _identified(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    model = model.value
    langs, bits = model["langs"], model["bits"]
    parser = Parser([dense(*t) for t in model["tables"]]) if langs else None
    for batch in batches:
        n = batch.num_rows
        total = np.zeros((max(1, len(langs)), n))
        held: list[np.ndarray] = []
        owner: list[int] = []

        def parse():
            if not held:
                return
            sizes = np.array([len(s) for s in held])
            begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            pieces = -(-sizes // SEGMENT)
            which = np.repeat(np.arange(len(held)), pieces)
            inner = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = begins[which] + inner * SEGMENT
            length = np.minimum(SEGMENT, sizes[which] - inner * SEGMENT)
            found = parser.phrases(np.concatenate(held), start, length)
            for k in range(len(langs)):
                total[k] += np.bincount(np.array(owner)[which], weights=found[k], minlength=n)
            held.clear()
            owner.clear()

        lanes = 0
        for i, text in enumerate(batch["text"]):
            signs = signs_of(text.as_py() or "", model["classes"])
            if len(signs) and parser:
                held.append(signs)
                owner.append(i)
                lanes += -(-len(signs) // SEGMENT)
                if lanes >= LANES:
                    parse()
                    lanes = 0
        parse()
        cost = total * bits[:, None] if langs else total
        best = cost.argmin(axis=0)
        some = total.any(axis=0)
        ordered = np.sort(cost, axis=0)
        score = np.where(some, 1.0, 0.0)
        if len(langs) > 1:
            score[some] = (ordered[1] / (ordered[0] + ordered[1]).clip(1e-9))[some]
        names = [langs[b] if s else UNKNOWN for b, s in zip(best, some)]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["held_out"], pa.array(names, pa.string()), pa.array(score)],
            names=["doc_id", "held_out", "lang_pred", "score"],
        )


def with_language(docs: DataFrame, model: dict, held_out: Column) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 64 documents per language
    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text").mapInArrow(
        partial(_identified, model=shared), "doc_id long, held_out boolean, lang_pred string, score double"
    )
