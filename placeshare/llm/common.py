"""What several operators share: tables, word hashes, runs of a sorted stream, forests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeshare.sources.storage import new_path

U64 = np.uint64
#: A-Z to a-z, every other byte as it is
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: the white space that separates words: \x20 and \x09 to \x0D
SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 18
PIECES = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all others."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class WordHasher:
    """64-bit hashes of all words of many texts at once, by polynomials modulo 2**64.

    Prefix sums of byte * base**position give the hash of any word as a difference, shifted back
    to position 0 by the inverse power.
    """

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, lower: bool = True):
        self.fold = np.frombuffer(LOWER if lower else bytes(range(256)), dtype=np.uint8)
        self.up = self.down = np.ones(1, dtype=U64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up, self.down = (
                    np.cumprod(np.concatenate([[U64(1)], np.full(n, base, dtype=U64)]))
                    for base in (self.BASE, self.INVERSE)
                )

    def words(self, data: np.ndarray, bounds: np.ndarray):
        """Hash, start byte and end byte of each word, and each text's first word (one more at the end)."""
        n = len(data)
        self._powers(n + 1)
        gap = np.ones(n + 2, dtype=bool)
        gap[1:-1] = SPACE[data]
        inside = ~gap[1:-1]
        edge = np.zeros(n + 1, dtype=bool)
        edge[bounds] = True
        starts = np.flatnonzero(inside & (gap[:-2] | edge[:-1]))
        ends = np.flatnonzero(inside & (gap[2:] | edge[1:])) + 1
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum((self.fold[data].astype(U64) + U64(1)) * self.up[:n], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * self.down[starts])
        return hashes, starts, ends, np.searchsorted(starts, bounds)

    def texts(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each text in turn: its index, and its words' hashes, start bytes and end bytes."""
        column = column.fill_null("").cast(pa.large_string())
        raw = column.buffers()
        offsets = np.frombuffer(raw[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
        data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
            bounds = offsets[first: last + 1] - offsets[first]
            with np.errstate(over="ignore"):
                hashes, starts, ends, at = self.words(data[offsets[first]: offsets[last]], bounds)
            for i in range(last - first):
                part = slice(at[i], at[i + 1])
                yield first + i, hashes[part], starts[part] - bounds[i], ends[part] - bounds[i]
            first = last


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in a stream that is sorted by them."""
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        columns = [part[k].to_numpy() for k in keys]
        change = np.zeros(part.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), part.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != held_key:
                yield pa.concat_tables(held)
                held = []
            held.append(part.slice(a, b - a))
            held_key = key
    if held:
        yield pa.concat_tables(held)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each of n items reaches by the links left[i]-right[i]."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, root):
            return root
        root = new


def excerpt(text: Column, clip: int) -> Column:
    """A text of at most ``clip`` characters as it is; of a longer one, ``PIECES`` pieces spread over all of it."""
    size, piece = F.length(text), max(1, clip // PIECES)
    place = lambda i: (i * (size - piece) / (PIECES - 1)).cast("int") + 1
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda i: F.substring(text, place(i), F.lit(piece)))
    return F.when(size <= clip, text).otherwise(F.concat_ws(" ", pieces))


def labelled_sample(docs: DataFrame, ids: DataFrame, clip: int) -> list:
    """Excerpts of ``clip`` characters for a bounded list of (``doc_id``, more columns); one per id.

    ``ids`` must be bounded by its caller: it is broadcast, and as many rows come to the driver.
    """
    more = [c for c in ids.columns if c != "doc_id"]
    picked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return picked.groupBy("doc_id", *more).agg(F.min(excerpt(F.col("text"), clip)).alias("text")).collect()


def hash_order(doc_id: str = "doc_id") -> list[Column]:
    """An order without meaning that is the same in every run."""
    return [F.xxhash64(doc_id, F.lit(101)), F.col(doc_id)]
