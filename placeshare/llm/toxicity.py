"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the words of a text (which words occur, and their first letters) is
trained on confirmed toxic documents and on text without labels. Its risk is that of a classifier
with known class prior p: p * (loss of the positives as positive) plus max(0, loss of the
unlabelled as negative - p * (loss of the positives as negative)). Where the second term turns
negative, that is, where unlabelled positives are being learned as negatives, the step goes the
other way. Losses are logistic, steps are Adam's, all in numpy.

The prior is the share of toxic labels among the training labels. Fitting uses a bounded sample:
``positives`` and ``unlabelled`` documents picked by hash (of one with more than ``clip``
characters, pieces from all over it) and the ``vocabulary`` features that tell them apart best. Scoring reads every text whole.

Null texts count as empty; an empty text gets the score of a text without known words. Without
confirmed examples every score is 0. Repeated rows get the same score, extra columns are ignored,
and an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeshare.llm.common import hash_order, labelled_sample

PREFIX = 4
REMEMBERED = 300_000


def features(word: str) -> list[str]:
    """A word without case and without signs around it, and its first letters."""
    start, end = 0, len(word)
    while start < end and not word[start].isalpha():
        start += 1
    while start < end and not word[end - 1].isalpha():
        end -= 1
    word = word[start:end].lower()
    return [word, f"{word[:PREFIX]}*"] if word else []


class Reader:
    """Numbers of the known features of texts; remembers a bounded number of words."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.known = vocabulary, {}

    def __call__(self, text: str | None) -> set[int]:
        found: set[int] = set()
        known = self.known
        for word in set((text or "").split()):
            ids = known.get(word)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = known[word] = tuple(self.vocabulary[f] for f in features(word) if f in self.vocabulary)
            if ids:
                found.update(ids)
        return found


def _matrix(rows: list[set[int]]) -> tuple[np.ndarray, np.ndarray, int]:
    column = np.array([i for r in rows for i in sorted(r)], dtype=np.int64)
    return column, np.repeat(np.arange(len(rows)), [len(r) for r in rows]), len(rows)


def nnpu(positive, unlabelled, size: int, prior: float, steps: int = 300, rate: float = 0.05, ridge: float = 3e-5):
    """Weights (the last is the constant) that minimise the non-negative risk."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    value = lambda m, w: np.bincount(m[0] * 0 + m[1], weights=w[m[0]], minlength=m[2]) + w[-1]
    slope = lambda m, g: np.append(np.bincount(m[0], weights=g[m[1]], minlength=size), g.sum())
    w, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        p, u = value(positive, w), value(unlabelled, w)
        as_negative = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        negative = slope(unlabelled, sigmoid(u) / len(u)) - slope(positive, prior * sigmoid(p) / len(p))
        if as_negative >= 0:
            g = slope(positive, -prior * sigmoid(-p) / len(p)) + negative
        else:
            g = -negative
        g = g + ridge * np.append(w[:-1], 0.0)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w


def fit(
    docs: DataFrame, labels: DataFrame, train: Column, positives: int = 3000, unlabelled: int = 6000,
    clip: int = 20_000, vocabulary: int = 8192,
) -> dict:
    """A classifier from the labels and texts for which ``train`` (of ``doc_id``) holds."""
    known = labels.where(train & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    counts = {bool(r[0]): r[1] for r in known.groupBy(F.col("toxic") == 1).count().collect()}
    if not counts.get(True):
        return {"vocabulary": {}, "weights": None}
    prior = min(0.95, counts[True] / sum(counts.values()))
    toxic = known.where("toxic = 1").select("doc_id").distinct().orderBy(*hash_order()).limit(positives)
    open_ids = docs.where(train & F.col("doc_id").isNotNull()).select("doc_id").orderBy(*hash_order()).limit(unlabelled).distinct()
    ids = toxic.withColumn("toxic", F.lit(True)).unionByName(open_ids.withColumn("toxic", F.lit(False)))
    rows = sorted(labelled_sample(docs, ids, clip), key=lambda r: (r.toxic, r.doc_id))
    n, m = (sum(r.toxic == t for r in rows) for t in (True, False))
    if not n or not m:
        return {"vocabulary": {}, "weights": None}
    of = lambda r: {f for w in set(r.text.split()) for f in features(w)}
    p = Counter(f for r in rows if r.toxic for f in of(r))
    p = {f: c for f, c in p.items() if c >= 3}
    u = Counter(f for r in rows if not r.toxic for f in of(r) if f in p)
    apart = {f: abs(np.log((c + 0.5) / n) - np.log((u[f] + 0.5) / m)) * c**0.75 for f, c in p.items()}
    best = sorted(apart, key=lambda f: (-apart[f], f))[: min(vocabulary, 32 + 4 * n)]
    numbers = {f: i for i, f in enumerate(best)}
    read = Reader(numbers)
    rows_of = lambda t: _matrix([read(r.text) for r in rows if r.toxic == t])
    return {"vocabulary": numbers, "weights": nnpu(rows_of(True), rows_of(False), len(best), prior)}


def _scored(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    read, weights = Reader(model["vocabulary"]), model["weights"]
    for batch in batches:
        if weights is None:
            score = np.zeros(batch.num_rows)
        else:
            m = _matrix([read(t.as_py()) for t in batch["text"]])
            z = np.bincount(m[1], weights=weights[m[0]], minlength=m[2]) + weights[-1]
            score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score)], names=["doc_id", "held_out", "score"])


def with_toxicity(docs: DataFrame, model: dict, held_out: Column) -> DataFrame:
    """``doc_id``, ``held_out`` and ``score``: the probability that the text is toxic."""
    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text").mapInArrow(
        partial(_scored, model=model), "doc_id long, held_out boolean, score double"
    )
