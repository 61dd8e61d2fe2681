"""Passages that repeat across a corpus, by sparse suffix arrays.

A suffix array sorts all suffixes of all texts; suffixes that share a beginning become neighbours.
Here only suffixes at minimisers are kept: of every ``window`` consecutive runs of ``GRAM`` words
the one with the smallest hash. The choice depends on the words alone, so equal passages keep equal
suffixes, and a repeated passage of ``words`` words has one within its first ``window`` places.

Suffixes whose first words occur once only are dropped by counting. The others are sorted, with up
to ``words`` words to the right and ``window`` - 1 to the left; neighbours are compared to the
right, and again for each extension to the left. A passage is repeated where some extension gives
``words`` words that a neighbour has, too. Overlapping finds of one text are merged. This finds
every word that lies in a run of ``words`` words occurring twice or more, and no other (words are
compared by 32-bit hashes, first words and the runs at hot suffixes by 64-bit ones).

Equal suffixes with equal surroundings are one row with a count, so large groups of copies do not
gather in one task, and what is sorted is split by content. First words that more than ``HOT``
suffixes share are not sorted: the runs of ``words`` words for which such a suffix is the minimiser
of the first ``window`` places are counted by their hash, before and after the shuffle, and those
found twice or more are joined back. So each run is at one suffix, and no task gathers a group. Null and short texts have no repeats.
Rows that are equal in doc_id and text are reported once (and do repeat each other); null ids are
kept. Other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeshare.llm.common import U64, WordHasher, mixed, runs, stored

GRAM, WINDOW = 8, 30
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
SORTED_ROWS = 8192
HOT = 4096
BROADCAST_TEXTS = 2_000_000  # 16 MB of hashes


class Ranges:
    """Hashes of any run of the words of a text."""

    def __init__(self, words: np.ndarray):
        with np.errstate(over="ignore"):
            n = len(words)
            up = np.cumprod(np.concatenate([[U64(1)], np.full(n, BASE, dtype=U64)]))
            self.down = np.cumprod(np.concatenate([[U64(1)], np.full(n, INVERSE, dtype=U64)]))
            self.sums = np.concatenate([[U64(0)], np.cumsum(words * up[:n], dtype=U64)])

    def __call__(self, first: np.ndarray, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[first + length] - self.sums[first]) * self.down[first])


def minimisers(words: np.ndarray, ranges: Ranges, window: int) -> np.ndarray:
    grams = ranges(np.arange(len(words) - GRAM + 1), GRAM)
    if len(grams) < window:
        return np.zeros(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(view.argmin(axis=1) + np.arange(len(view)))


def _starts(batches: Iterator[pa.RecordBatch], words: int, window: int) -> Iterator[pa.RecordBatch]:
    """Kept suffixes: the text's hash, the place, and the hash of the words every match must share."""
    hasher, sure = WordHasher(lower=False), words - window + 1
    for batch in batches:
        texts, places, heads = [], [], []
        key = batch["text_hash"].to_numpy()
        for i, hashes, _, _ in hasher.texts(batch["text"]):
            if len(hashes) < words:
                continue
            ranges = Ranges(hashes)
            at = minimisers(hashes, ranges, window)
            at = at[at + sure <= len(hashes)]
            texts.append(np.full(len(at), key[i]))
            places.append(at)
            heads.append(ranges(at, sure).astype(np.int64))
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(join(texts)), pa.array(join(places).astype(np.int32)), pa.array(join(heads))],
            names=["text_hash", "place", "head"],
        )


SUFFIX = (
    "doc_id long, text_hash long, place int, head long, context long, right binary, left binary, most int, runs array<long>"
)


def _suffixes(batches: Iterator[pa.RecordBatch], words: int, window: int) -> Iterator[pa.RecordBatch]:
    """The kept suffixes with the words around them, once per task for equal surroundings.

    For hot suffixes, instead of words, the hashes of their own runs, the one furthest to the left
    (by ``most`` words) first; those without such runs are left out.
    """
    hasher, sure = WordHasher(lower=False), words - window + 1
    seen: set[int] = set()
    for batch in batches:
        key, wanted, many = batch["text_hash"].to_numpy(), batch["places"], batch["hot"]
        ids = batch["doc_id"].to_pylist()
        rows: list[tuple] = []
        for i, hashes, _, _ in hasher.texts(batch["text"]):
            ranges, n = Ranges(hashes), len(hashes)
            codes = (hashes >> U64(32)).astype(">u4")
            at = np.sort(np.array(wanted[i].as_py(), dtype=np.int64))
            heads = ranges(at, sure).astype(np.int64)
            low, high = np.maximum(at - window + 1, 0), np.minimum(at + words, n)
            with np.errstate(over="ignore"):
                around = (ranges.sums[high] - ranges.sums[low]) * ranges.down[low]
                around = mixed(mixed(around) + ((at - low) << 8 | (high - at)).astype(U64)).astype(np.int64)
            hot = set(many[i].as_py())
            if hot:
                grams = ranges(np.arange(n - GRAM + 1), GRAM)
                own = np.lib.stride_tricks.sliding_window_view(grams, window)[: n - words + 1].argmin(axis=1)
                own += np.arange(len(own))  # the minimiser of each run; it never goes back
                first, last = np.searchsorted(own, at), np.searchsorted(own, at, "right")
            for k, (p, a, b, head, context) in enumerate(zip(*(x.tolist() for x in (at, low, high, heads, around)))):
                right = left = most = found = None
                if p in hot:
                    if first[k] == last[k]:
                        continue
                    most = p - int(first[k])
                if context not in seen:
                    seen.add(context)
                    if most is None:
                        right, left = codes[p:b].tobytes(), codes[a:p][::-1].tobytes()
                    else:
                        found = ranges(np.arange(first[k], last[k]), words).astype(np.int64)
                rows.append((ids[i], int(key[i]), p, head, context, right, left, most, found))
        columns = list(zip(*rows)) if rows else [()] * 9
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=["doc_id", "text_hash", "place", "head", "context", "right", "left", "most", "runs"],
        )


def _matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    raw = column.to_pylist()
    size = np.array([len(r) // 4 for r in raw])
    flat = np.frombuffer(b"".join(raw), dtype=">u4")
    out = np.zeros((len(raw), width), dtype=np.uint32)
    out[np.arange(width) < size[:, None]] = flat
    return out, size


def _classes(before: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Numbers of the distinct pairs of a class so far and one more word."""
    return np.unique((before.astype(U64) << U64(32)) | column.astype(U64), return_inverse=True)[1]


def _compared(batches: Iterator[pa.RecordBatch], words: int, window: int) -> Iterator[pa.RecordBatch]:
    """For sorted suffixes: the longest and shortest extension to the left that has a match.

    Rows come in the order of their words to the right. For each extension, those that share the
    words to the left keep that order among themselves, and then no suffix shares more words to
    the right with one than its neighbours do: only neighbours are compared.
    """
    for part in _whole_runs(runs(batches, ["head"])):
        right, right_size = _matrix(part["right"], words)
        left, left_size = _matrix(part["left"], window - 1)
        count, low, high = (part[c].to_numpy() for c in ("n", "low", "high"))
        n = len(right)
        most, least = np.full(n, -1), np.full(n, window)
        near_low, near_high = low.copy(), high.copy()
        classes = np.unique(part["head"].to_numpy(), return_inverse=True)[1]
        for a in range(window):
            if a:
                classes = _classes(classes, left[:, a - 1])
            able = np.flatnonzero((left_size >= a) & (right_size >= words - a))
            order = able[np.argsort(classes[able], kind="stable")]
            x, y = order[:-1], order[1:]
            together = classes[x] == classes[y]
            x, y = x[together], y[together]
            same = (right[x, : words - a] == right[y, : words - a]).all(axis=1)
            x, y = x[same], y[same]
            found = np.zeros(n, dtype=bool)
            found[able] = count[able] > 1
            found[x] = found[y] = True
            # ids travel along a run of neighbours that match
            follows = np.zeros(n, dtype=bool)
            follows[y] = True
            first = ~follows[order]
            group = np.cumsum(first) - 1
            starts = np.flatnonzero(first)
            if len(order):
                lowest, highest = np.minimum.reduceat(low[order], starts), np.maximum.reduceat(high[order], starts)
                near_low[order] = np.minimum(near_low[order], lowest[group])
                near_high[order] = np.maximum(near_high[order], highest[group])
            hit = np.flatnonzero(found)
            most[hit], least[hit] = np.maximum(most[hit], a), np.minimum(least[hit], a)
        own = np.flatnonzero(most >= 0)
        yield pa.RecordBatch.from_arrays(
            [part["context"].combine_chunks().take(pa.array(own)), *(pa.array(a[own]) for a in (most, words - least, near_low, near_high))],
            names=["context", "left", "right", "low", "high"],
        )


def _whole_runs(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for t in tables:
        held.append(t)
        rows += t.num_rows
        if rows >= SORTED_ROWS:
            yield pa.concat_tables(held)
            held, rows = [], 0
    if held:
        yield pa.concat_tables(held)


def repeated_passages(docs: DataFrame, words: int = 50, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """``doc_id``, ``start_word``, ``end_word``, ``n_words``, ``other_doc`` of every repeated passage.

    Words are counted from 0, the end is one past the last; ``other_doc`` has (part of) it, too.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    long_enough = texts.where(F.length("text") >= 2 * words - 1)
    starts = stored(
        long_enough.select("text", "text_hash").mapInArrow(
            partial(_starts, words=words, window=window), "text_hash long, place int, head long"), "starts",
    )
    # as a table of its own, so that the join can split a head that very many suffixes share
    twice = stored(starts.groupBy("head").agg(F.count("*").alias("n")).where("n > 1"), "twice")
    places = stored(
        starts.join(twice, "head").groupBy("text_hash").agg(
            F.collect_set("place").alias("places"), F.collect_set(F.when(F.col("n") > hot, F.col("place"))).alias("hot"),
        ), "places",
    )
    if places.count() <= BROADCAST_TEXTS:  # else the join itself drops the texts without places
        long_enough = long_enough.join(F.broadcast(places.select("text_hash")), "text_hash", "left_semi")
    rows = stored(
        long_enough.join(places, "text_hash").select("doc_id", "text_hash", "text", "places", "hot")
        .mapInArrow(partial(_suffixes, words=words, window=window), SUFFIX), "suffixes",
    )
    counted = [
        F.count("*").alias("n"), F.min(F.coalesce("doc_id", F.lit(-1))).alias("low"), F.max(F.coalesce("doc_id", F.lit(-1))).alias("high"),
    ]
    held = rows.where("most is null").groupBy("context").agg(
        F.first("head").alias("head"), *counted, F.max("right").alias("right"), F.max("left").alias("left"),
    )
    sorted_matches = (
        held.repartition("head").sortWithinPartitions("head", "right", "left")
        .mapInArrow(partial(_compared, words=words, window=window), "context long, left long, right long, low long, high long")
    )
    around = stored(
        rows.where("most is not null").groupBy("context").agg(*counted, F.max("most").alias("most"), F.max("runs").alias("runs")), "around",
    )
    each = around.select("context", "n", "low", "high", "most", F.posexplode("runs").alias("at", "run"))
    # a table of its own, as above: a run that very many suffixes have can be split in the join
    repeated = stored(
        each.groupBy("run").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        .where("n > 1").select("run", "low", "high"), "repeated",
    )
    left = F.col("most") - F.col("at")
    matches = sorted_matches.unionByName(
        each.select("context", "run", left.cast("long").alias("left")).join(repeated, "run").groupBy("context").agg(
            F.max("left").alias("left"), (words - F.min("left")).alias("right"), F.min("low").alias("low"), F.max("high").alias("high"))
    )
    spans = rows.select("doc_id", "text_hash", "place", "context").join(matches, "context").select(
        "doc_id", "text_hash", (F.col("place") - F.col("left")).alias("start"), (F.col("place") + F.col("right")).alias("end"),
        F.when(F.col("low") != F.coalesce("doc_id", F.lit(-1)), F.col("low")).otherwise(F.col("high")).alias("other"),
    )
    text = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end")
    before = F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1))
    return (
        spans.withColumn("new", (F.coalesce(before, F.lit(-1)) < F.col("start")).cast("int"))
        .withColumn("passage", F.sum("new").over(text))
        .groupBy("doc_id", "text_hash", "passage")
        .agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("other").alias("other_doc"))
        .select(
            "doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"),
            F.nullif("other_doc", F.lit(-1)).alias("other_doc"),
        )
    )
