"""Near-duplicate vectors by p-stable hashing for the Euclidean distance, with exact cosine checks.

Vectors are normalised, so cosine c is distance sqrt(2 - 2c). Each table quantises ``projections``
random projections to cells of ``width``; vectors with the same cells share a bucket, and every
pair within a bucket is checked by its cosine in double precision. A pair that meets in several
tables counts in the first one only. Defaults: a pair at cosine 0.9 meets in one table or more with
probability 0.95, one at 0.98 with more than 0.9999; more tables raise both.

Usable vectors that are equal are one node with a weight before anything is hashed, so copies are not multiplied
out. Buckets are cut into parts, and pairs of parts are multiplied as matrices in tiles; a tile
writes sums of links and a spanning forest, never pairs, so no bucket needs a cap.

A vector that is null, zero, or holds null or non-finite components has no links and is its own
component. Vectors of different lengths never link. Each row counts as one vector, repeated rows
included; rows with a null vec_id count like others. An empty table gives an empty result, and
other columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from placeshare.llm.common import U64, forest, mixed, runs, stored
from placeshare.llm.components import components

TILE = 1024


@lru_cache(maxsize=4)
def _projections(dim: int, tables: int, projections: int, width: float):
    rng = np.random.default_rng(7_919 + dim)
    directions = rng.standard_normal((dim, tables * projections))
    return directions / width, rng.random(tables * projections)


def normalised(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def vectors(column: pa.Array, kind: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places and values of the usable vectors of an array column."""
    size = column.value_lengths().fill_null(0).to_numpy()
    flat = column.flatten()
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    values = flat.to_numpy(zero_copy_only=False).astype(kind)
    if flat.null_count:
        values[flat.is_null().to_numpy(zero_copy_only=False)] = np.nan
    out = {}
    for dim in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == dim)
        rows = values[start[at][:, None] + np.arange(dim)]
        good = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
        if good.any():
            out[dim] = at[good], rows[good]
    return out


def _hashed(batches: Iterator[pa.RecordBatch], kind: str, tables: int, projections: int, width: float):
    """The bucket of each vector in each table; nothing for vectors that take no part."""
    for batch in batches:
        for dim, (at, rows) in vectors(batch["embedding"], kind).items():
            directions, shift = _projections(dim, tables, projections, width)
            cells = np.floor(normalised(rows) @ directions + shift).astype(np.int64)
            h = np.full((len(at), tables), dim, dtype=U64)
            for p in range(projections):
                h = mixed(h * U64(0x9E3779B97F4A7C15) + cells[:, p::projections].astype(U64))
            codes = (h >> U64(32)).astype(np.uint32).view(np.int32)
            kept = batch.select(["node", "weight", "low"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array([r.tobytes() for r in rows], pa.binary()),
                 pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), tables).cast(pa.list_(pa.int32()))],
                names=["node", "weight", "low", "vector", "codes"],
            )


def _tile_links(batches: Iterator[pa.RecordBatch], kind: str, threshold: float):
    """Per tile: links gained by each node (b null), and a forest of the links (b not null)."""
    for tile in runs(batches, ["t", "code", "i", "j"]):
        if tile.num_rows < 2:
            continue
        raw = tile["vector"].to_pylist()
        lengths = np.array([len(r) for r in raw])
        for length in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == length)
            x = normalised(np.frombuffer(b"".join(raw[k] for k in own), dtype=kind).reshape(len(own), -1))
            rows = tile.take(pa.array(own))
            nodes, weight, part = (rows[c].to_numpy() for c in ("node", "weight", "part"))
            linked = x @ x.T >= threshold
            if rows["i"][0].as_py() != rows["j"][0].as_py():
                linked &= part[:, None] != part[None]
            np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            t = rows["t"][0].as_py()
            if t:
                codes = np.array(rows["codes"].combine_chunks().flatten()).reshape(len(own), -1)[:, :t]
                left, right = np.nonzero(linked)
                for a in range(0, len(left), 200_000):
                    p, q = left[a: a + 200_000], right[a: a + 200_000]
                    linked[p, q] = ~(codes[p] == codes[q]).any(axis=1)
            gained = linked @ weight
            some = np.flatnonzero(gained)
            left, right = np.nonzero(np.triu(linked))
            root = forest(len(own), left, right)
            tied = np.flatnonzero(root != np.arange(len(own)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([nodes[some], nodes[tied]])),
                 pa.array([*([None] * len(some)), *nodes[root[tied]].tolist()], pa.int64()),
                 pa.array(np.concatenate([gained[some], np.zeros(len(tied), dtype=np.int64)]))],
                names=["a", "b", "gained"],
            )


def near_vectors(
    table: DataFrame, threshold: float = 0.9, tables: int = 32, projections: int = 12, width: float = 2.0,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row (``vec_id``, ``embedding``)."""
    kind = "<f4" if isinstance(table.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    usable = F.expr(
        "embedding is not null and forall(embedding, e -> e is not null and abs(e) < double('inf')) and exists(embedding, e -> e <> 0)")
    # two hashes of vectors without nulls: 128 bits tell them apart; others get a key of their own that no node has
    key = [F.when(usable, F.xxhash64(F.lit(seed), "embedding")).otherwise(F.xxhash64(F.lit(seed + 2), "vec_id")) for seed in (1, 2)]
    rows = table.select("vec_id", "embedding", usable.alias("usable"), key[0].alias("h"), key[1].alias("k"))
    distinct = stored(
        rows.where("usable").groupBy("h", "k").agg(
            F.first("embedding").alias("embedding"), F.count("*").alias("weight"), F.min("vec_id").alias("low"),
        ).withColumn("node", F.monotonically_increasing_id()), "distinct",
    )
    hashed = partial(_hashed, kind=kind, tables=tables, projections=projections, width=width)
    nodes = stored(
        distinct.mapInArrow(hashed, "node long, weight long, low long, vector binary, codes array<int>"), "vectors",
    )
    places = nodes.select("node", F.posexplode("codes").alias("t", "code"))
    shared = places.groupBy("t", "code").agg(F.count("*").alias("g")).where("g > 1")
    tiles = (
        places.join(shared, ["t", "code"])
        .withColumn("parts", F.ceil(F.col("g") / TILE))
        .withColumn("part", F.expr("pmod(xxhash64(node, 7), parts)"))
        .withColumn("to", F.explode(F.expr("sequence(0L, parts - 1)")))
        .select("t", "code", F.least("part", "to").alias("i"), F.greatest("part", "to").alias("j"), "part", "node")
        .join(nodes.select("node", "weight", "vector", "codes"), "node")
        .repartition("t", "code", "i", "j").sortWithinPartitions("t", "code", "i", "j")
    )
    found = stored(
        tiles.mapInArrow(partial(_tile_links, kind=kind, threshold=threshold), "a long, b long, gained long"), "found",
    )
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("gained").alias("gained"))
    groups = components(found.where("b is not null").select("a", "b"))
    lowest = (
        groups.join(nodes.select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("lowest"))
        .join(groups, "root").select("node", "lowest")
    )
    result = stored(
        nodes.select("node", "weight", "low").join(links, "node", "left").join(lowest, "node", "left").select(
            "node", (F.col("weight") - 1 + F.coalesce("gained", F.lit(0))).alias("n_links"),
            F.least("low", "lowest").alias("component_id"),
        ), "result",
    )
    component = F.coalesce("component_id", "vec_id")
    placed = distinct.select("h", "k", "node").join(result, "node").drop("node")
    return rows.select("vec_id", "h", "k").join(placed, ["h", "k"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )
