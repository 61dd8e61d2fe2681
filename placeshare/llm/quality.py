"""Text quality by compression: zstandard dictionaries of good and of bad text, compared.

Two dictionaries are trained, one on labelled good text and one on bad. A text is compressed with
each of them, whole and in windows; the difference of the two sizes over their sum is low for text
that the good dictionary describes better. A logistic curve over these differences (of the whole
text, mean and largest over its windows) and over the text's own compressed ratio, fitted on
labelled texts that the dictionaries have not seen, turns them into a probability of being good.

Fitting uses a bounded sample: at most ``sample`` labelled documents per class and part, picked by hash; of
one with more than ``clip`` characters, pieces from all over it. Scoring reads every text whole. Null texts count as empty. If one
class has no labelled documents, every score is the share of good labels (1.0 without any labels).
Several labels for one document count on their own. Repeated rows get the same score, extra columns
are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from placeshare.llm.common import hash_order, labelled_sample

WINDOW = 512
DICTIONARY_BYTES = 112 * 1024
LEVEL = 3


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.good, self.bad = (
            zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **plain) for d in (good, bad)
        )
        self.plain = zstandard.ZstdCompressor(**plain)

    def difference(self, data: bytes) -> float:
        a, b = len(self.good.compress(data)), len(self.bad.compress(data))
        return (a - b) / (a + b)

    def features(self, text: str | None) -> np.ndarray:
        data = (text or "").encode("utf-8", "surrogatepass")
        parts = [self.difference(w) for w in windows(data)]
        own = len(self.plain.compress(data)) / (len(data) + 16)
        x = np.array([np.mean(parts), max(parts), self.difference(data), own])
        return np.concatenate([x, x * x, [1.0]])


def windows(data: bytes) -> list[bytes]:
    return [data[i: i + WINDOW] for i in range(0, len(data), WINDOW)] or [b""]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 60):
    """Weights of a ridge logistic regression on standardised columns, by damped Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-1], scale[-1] = 0.0, 1.0
    z = (x - mean) / np.where(scale > 0, scale, 1.0)
    w = np.zeros(z.shape[1])
    loss = lambda v: (weight * np.logaddexp(0, np.where(y, -1, 1) * (z @ v))).mean() + ridge * v @ v / 2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        slope = z.T @ (weight * (p - y)) / len(y) + ridge * w
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        move, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-4 and loss(w - size * move) > loss(w):
            size /= 2
        w = w - size * move
    scaled = w / np.where(scale > 0, scale, 1.0)
    scaled[-1] = w[-1] - (scaled[:-1] * mean[:-1]).sum()
    return scaled


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample: int = 1500, clip: int = 20_000) -> dict:
    """Dictionaries and curve from the labels for which ``train`` (of ``doc_id``) holds."""
    known = labels.where(train & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    counts = {bool(r[0]): r[1] for r in known.groupBy(F.col("quality") == 1).count().collect()}
    model = {"share": counts.get(True, 0) / sum(counts.values()) if counts else 1.0}
    if len(counts) < 2:
        return model
    ids = None
    for good in (0, 1):
        for part in (0, 1):  # one part for the dictionaries, the other for the curve
            mine = (
                known.where((F.col("quality") == 1) == bool(good))
                .where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == part).select("doc_id").distinct()
                .orderBy(*hash_order()).limit(sample)
                .select("doc_id", F.lit(bool(good)).alias("good"), F.lit(part).alias("part"))
            )
            ids = mine if ids is None else ids.unionByName(mine)
    rows = sorted(labelled_sample(docs, ids, clip), key=lambda r: (r.doc_id, r.good))
    dictionaries = []
    for good in (True, False):
        pieces = [w for r in rows if r.good == good and r.part == 0 for w in windows(r.text.encode()) if len(w) >= 8]
        dictionaries.append(dictionary(pieces))
    held = [r for r in rows if r.part == 1]
    y = np.array([r.good for r in held])
    if not len(y) or y.all() or not y.any():
        return model
    compressors = Compressors(*dictionaries)
    x = np.array([compressors.features(r.text) for r in held])
    prior = np.where(y, model["share"] / y.mean(), (1 - model["share"]) / (1 - y.mean()))
    return model | {"good": dictionaries[0], "bad": dictionaries[1], "weights": logistic(x, y, prior)}


def dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary; the text itself where there is too little to train on."""
    total = sum(map(len, pieces))
    order = np.random.default_rng(5).permutation(len(pieces))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 4)), [pieces[i] for i in order]).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:DICTIONARY_BYTES]


def _scored(batches: Iterator[pa.RecordBatch], model: dict, name: str) -> Iterator[pa.RecordBatch]:
    compressors = Compressors(model["good"], model["bad"]) if "weights" in model else None
    for batch in batches:
        if compressors:
            z = np.array([compressors.features(t.as_py()) @ model["weights"] for t in batch["text"]], dtype=float)
            score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        else:
            score = np.full(batch.num_rows, model["share"])
        columns = [batch[c] for c in batch.schema.names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], names=[*batch.schema.names, name])


def with_score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the probability that the text is good."""
    schema = StructType([*docs.schema.fields]).add(name, DoubleType())
    return docs.mapInArrow(partial(_scored, model=model, name=name), schema)
