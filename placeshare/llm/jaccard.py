"""Set similarity join of documents on word shingles, as a blocked sparse matrix product.

Documents are rows and hashed shingles are columns of a 0/1 matrix A; two documents link when the
Jaccard similarity, taken from their entry of A * A' and their sizes, reaches the threshold.

1. Equal sets become one node, named by a 64-bit fingerprint of the whole set.
2. Columns are put in one order for all documents: a quarter of them, picked by hash, from rare to
   common; then the others by hash. Two sets of similarity t share a column among their first
   size - ceil(t * size) + 1, so only those entries are multiplied. Frequencies count all documents.
3. Nodes that share such a column are compared in tiles by a bound on their overlap: sizes m and n
   and parity bitmaps x and y give overlap <= (m + n - popcount(x xor y)) / 2. Only a spanning
   forest of the pairs that pass leaves a tile; its components are the blocks.
4. Within each block, tile by tile, the full rows are multiplied, block of columns by block of
   columns, and pairs below the size-derived bound are discarded. A spanning forest of the links
   leaves a tile, and its components, with equal sets put back, are the result.

No pair is lost: 2 and 3 only drop pairs that cannot reach the threshold, 4 is exact up to hash
collisions (about 2**-64 a pair of different shingles or sets). Common columns and large groups
are split into tiles, so no task holds an unbounded group, and no pairs are written.

Null or empty texts have the empty set, link with nothing and are their own component. Every row is
a document of its own, repeated rows included; ids are labels only. Rows with a null doc_id link
like others, and a component of such rows only has a null id. Other columns of the input are
ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeshare.llm.common import U64, WORD, WordHasher, forest, mixed, runs, stored
from placeshare.llm.components import components

TILE = 2048
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1_000_000
COLUMNS = 4096


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of the whole text if it has fewer."""
    if not len(words):
        return np.zeros(0, dtype=U64)
    with np.errstate(over="ignore"):
        n = max(1, len(words) - size + 1)
        h = np.full(n, min(size, len(words)), dtype=U64)
        for k in range(min(size, len(words))):
            h = mixed(h * U64(0x9E3779B97F4A7C15) + words[k: k + n])
    return np.unique(h)


def fingerprint(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int((mixed(s ^ U64(0xD6E8FEB86659FD93)).sum(dtype=U64) + U64(len(s))).astype(np.int64))


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of b cells; b is a power of two from half the size."""
    bits = max(64, 1 << (max(1, len(s) // 2) - 1).bit_length())
    cells = np.bincount((s >> U64(8) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").tobytes()


def prefix_length(n, t: Fraction):
    """size - ceil(t * size) + 1, without rounding."""
    return n + (-n * t.numerator) // t.denominator + 1


NODES = "doc_id long, text_hash long, node long, n long, bits binary, picked array<long>, others array<long>"


def _nodes(batches: Iterator[pa.RecordBatch], size: int, t: Fraction) -> Iterator[pa.RecordBatch]:
    """Per document its node; for the first of equal sets here also what the join needs."""
    hasher = WordHasher()
    seen: set[int] = set()
    smallest = int(1 / (1 - t))  # smaller sets link with equal sets only
    for batch in batches:
        rows = {k: [] for k in ("node", "n", "bits", "picked", "others")}
        for _, words, _, _ in hasher.texts(batch["text"]):
            s = shingle_set(words, size)
            node = fingerprint(s) if len(s) else None
            new = len(s) + 1 >= smallest and node not in seen
            if new:
                seen.add(node)
                picked = s[: np.searchsorted(s, U64(1 << 62))]
                more = max(0, prefix_length(len(s), t) - len(picked))
                others = s[len(picked): len(picked) + more]
            rows["node"].append(node)
            rows["n"].append(len(s))
            rows["bits"].append(bitmap(s) if new else None)
            rows["picked"].append(picked.astype(np.int64) if new else None)
            rows["others"].append(others.astype(np.int64) if new else None)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"].cast(pa.int64()), batch["text_hash"], pa.array(rows["node"], pa.int64()), pa.array(rows["n"], pa.int64()),
             pa.array(rows["bits"], pa.binary()), pa.array(rows["picked"], pa.list_(pa.int64())),
             pa.array(rows["others"], pa.list_(pa.int64()))],
            names=["doc_id", "text_hash", "node", "n", "bits", "picked", "others"],
        )


def _linked(nodes: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    root = forest(len(nodes), left, right)
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["a", "b"])


def _enough(overlap: np.ndarray, m: np.ndarray, n: np.ndarray, t: Fraction) -> np.ndarray:
    return (t.denominator + t.numerator) * overlap >= t.numerator * (m + n)


def _candidates(batches: Iterator[pa.RecordBatch], t: Fraction) -> Iterator[pa.RecordBatch]:
    """Forests of the pairs of a tile whose bitmaps allow enough overlap."""
    for tile in runs(batches, ["column", "i", "j"]):
        if tile.num_rows < 2:
            continue
        nodes, n = tile["node"].to_numpy(), tile["n"].to_numpy()
        raw = tile["bits"].to_pylist()
        width = np.array([len(x) for x in raw])
        left, right = [], []
        for w in np.unique(width):
            narrow = np.flatnonzero(width == w)
            x = np.frombuffer(b"".join(raw[i] for i in narrow), dtype=U64).reshape(len(narrow), -1)
            folded, others = [x], [narrow]
            for v in np.unique(width[width > w]):  # wider bitmaps, folded, if such sizes can link
                wide = np.flatnonzero(width == v)
                if t.denominator * n[narrow].max() >= t.numerator * n[wide].min():
                    z = np.frombuffer(b"".join(raw[i] for i in wide), dtype=U64).reshape(len(wide), v // w, -1)
                    folded.append(np.bitwise_xor.reduce(z, axis=1))
                    others.append(wide)
            y, other = np.concatenate(folded), np.concatenate(others)
            step = max(1, 2_000_000 // (len(y) * x.shape[1]))
            for a in range(0, len(x), step):
                apart = np.bitwise_count(x[a: a + step, None] ^ y[None]).sum(axis=2, dtype=np.int64)
                m = n[narrow[a: a + step], None]
                k = n[other][None]
                possible = _enough(np.minimum((m + k - apart) // 2, np.minimum(m, k)), m, k, t)
                p, q = np.nonzero(possible)
                left.append(narrow[a + p])
                right.append(other[q])
        yield _linked(nodes, np.concatenate(left), np.concatenate(right))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """A * A' of the rows given, adding up one block of columns after the other."""
    column, where = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = np.bincount(where, minlength=len(column)) > 1
    number = np.cumsum(shared) - 1
    keep = shared[where]
    row, where = row[keep], number[where[keep]]
    order = np.argsort(where, kind="stable")
    row, where = row[order], where[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for first in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(where, [first, first + COLUMNS])
        block = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - first)), dtype=np.float32)
        block[row[a:b], where[a:b] - first] = 1
        out += block @ block.T
    return out.astype(np.int64)


def _exact(batches: Iterator[pa.RecordBatch], t: Fraction) -> Iterator[pa.RecordBatch]:
    """Forests of the links of a tile of a block, from the full rows of the matrix."""
    for tile in runs(batches, ["block", "i", "j"]):
        if tile.num_rows < 2:
            continue
        nodes, first = np.unique(tile["node"].to_numpy(), return_index=True)
        raw = tile["shingles"]
        sets = [np.frombuffer(raw[int(i)].as_py(), dtype=U64) for i in first]
        n = np.array([len(s) for s in sets])
        left, right = np.nonzero(np.triu(_enough(overlaps(sets), n[:, None], n[None], t), 1))
        yield _linked(nodes, left, right)


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The full rows of the matrix, once a node and task."""
    hasher = WordHasher()
    seen: set[int] = set()
    for batch in batches:
        node = batch["node"].to_numpy()
        own, sets = [], []
        for i, words, _, _ in hasher.texts(batch["text"]):
            if node[i] not in seen and fingerprint(s := shingle_set(words, size)) == node[i]:
                seen.add(node[i])
                own.append(i)
                sets.append(s.tobytes())
        kept = batch.select(["block", "parts", "node"]).take(pa.array(own, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array(sets, pa.binary())], names=["block", "parts", "node", "shingles"],
        )


def _tiles(df: DataFrame, key: str, parts: str) -> DataFrame:
    """Each row to every tile (i, j) of its group that has its part; groups of one part stay whole."""
    return (
        df.withColumn("part", F.expr(f"pmod(xxhash64(node, 7), {parts})"))
        .withColumn("to", F.explode(F.expr(f"sequence(0L, {parts} - 1)")))
        .withColumn("i", F.least("part", "to")).withColumn("j", F.greatest("part", "to"))
        .repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")
    )


def similar_sets(docs: DataFrame, size: int = 3, threshold: str = "0.9") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    Also ``text_hash`` and ``group``, which names the component and is null without words.
    """
    t = Fraction(threshold)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    rows = stored(texts.mapInArrow(partial(_nodes, size=size, t=t), NODES), "nodes")

    nodes = rows.where("bits is not null").select("node", "n", "bits", "picked", "others")
    k = F.expr(f"n + floor(-n * {t.numerator} / {t.denominator}) + 1").cast("long")
    incidence = nodes.select("node", "n", F.size("picked").alias("m"), F.explode("picked").alias("column"))
    counts = incidence.groupBy("column").agg(F.count("*").alias("df")).where("df > 1")
    within = Window.partitionBy("node")
    shared = (
        incidence.join(counts, "column").dropDuplicates(["node", "column"])
        .withColumn("single", F.col("m") - F.count("*").over(within))
        .withColumn("at", F.row_number().over(within.orderBy("df", "column")) + F.col("single"))
        .where(F.col("at") <= k).select("node", "column")
    )
    rest = nodes.select("node", F.explode("others").alias("column")).distinct()
    prefix = stored(shared.unionByName(rest), "prefix")
    meeting = prefix.groupBy("column").agg(F.count("*").alias("g")).where("g > 1")
    one = nodes.groupBy("node").agg(F.min_by(F.struct("n", "bits"), "n").alias("s")).select("node", "s.n", "s.bits")
    met = (
        prefix.join(meeting, "column").join(one, "node")
        .select("column", "node", "n", "bits", F.ceil(F.col("g") / TILE).cast("long").alias("parts"))
    )
    near = (
        _tiles(met, "column", "parts").select("column", "i", "j", "node", "n", "bits")
        .mapInArrow(partial(_candidates, t=t), "a long, b long")
    )
    blocks = components(near)

    first = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    member = blocks.join(first, "node").select("node", "n", F.col("root").alias("block"))
    parts = member.groupBy("block").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("parts")
    )
    holders = (
        rows.where("bits is not null").select("node", "text_hash").join(member.join(parts, "block"), "node")
        .groupBy("node", "block", "parts").agg(F.min("text_hash").alias("text_hash"))
    )
    links = components(
        _tiles(
            texts.join(holders, "text_hash").select("block", "parts", "node", "text")
            .mapInArrow(partial(_sets, size=size), "block long, parts long, node long, shingles binary"),
            "block", "parts",
        )
        .select("block", "i", "j", "node", "shingles")
        .mapInArrow(partial(_exact, t=t), "a long, b long")
    )
    labels = stored(
        first.join(links, "node", "left").withColumn("group", F.coalesce("root", "node"))
        .select("node", "group", "doc_id"), "labels",
    )
    lowest = labels.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    component = stored(labels.join(lowest, "group").select("node", "group", "component_id"), "components")
    return rows.select("doc_id", "text_hash", "node", "n").join(component, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "text_hash", "group",
    )


def one_of_each(docs: DataFrame, size: int = 3, threshold: str = "0.9") -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id. Documents without words all stay."""
    sets = stored(similar_sets(docs, size, threshold), "sets")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    kept = sets.where("group is not null").groupBy("group").agg(F.min(order).alias("k")).select(
        F.col("k.doc_id").alias("kept_id"), F.col("k.text_hash").alias("kept_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.xxhash64("text") == F.col("kept_hash"))
    left = docs.join(kept, same, "left_semi")
    without = docs.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    repeated = sets.where("group is not null").groupBy("doc_id", "text_hash").count().where("count > 1")
    return (left.dropDuplicates(["doc_id", "text"]) if repeated.limit(1).count() else left).union(without)
