"""Nearest neighbours by inner product: hierarchical navigable small-world graphs, one per shard.

Equal vectors are one node, which holds the smallest ids of its rows, one more than are asked for: no
query needs others, and groups of copies do not crowd out the links to other vectors. Nodes are
spread over shards of some ``shard_rows`` by hash. A shard's nodes are put in a random
order and on random levels; on each level a node is linked to a diverse choice of its nearest
among the nodes before it, and back. As a shard is bounded, those nearest are found exactly, block
by block. Lengths are evened out by one more dimension, so that near by distance is near by inner
product. A shard is stored as flat arrays: ids, how many of them each node has, vectors, and a table
of neighbours per level.

A query goes to every shard, in blocks of queries: down the upper levels to the nearest node, then
with a beam of ``beam`` nodes over the lowest. All scores that count are computed in double
precision on the original vectors. The nodes found are expanded to their ids, and each shard's best
rows go to one merge per query. All vectors are indexed; recall against brute force is in the README and in the tests.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
without vec_id. Rows that are equal in id and vector count once; a row with the query's vec_id is
never its neighbour. Vectors of different lengths are not compared. An empty table gives an empty
result, and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType
from pyspark.sql.window import Window

from placeshare.llm.common import stored
from placeshare.llm.nearvectors import vectors

LINKS = 16
CANDIDATES = 48
QUERY_BLOCK = 4096
LANES = 256


def _encoded(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, (at, rows) in vectors(batch["embedding"], kind).items():
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"].take(pa.array(at)), pa.array(np.full(len(at), dim, dtype=np.int64)),
                 pa.array([r.tobytes() for r in rows + 0], pa.binary())],  # -0.0 + 0 is 0.0
                names=["vec_id", "dim", "vector"],
            )


def evened(x: np.ndarray) -> np.ndarray:
    """Vectors of equal length: the missing length goes into one more dimension."""
    square = (x * x).sum(axis=1)
    return np.column_stack([x, np.sqrt(np.maximum(square.max() - square, 0))]).astype(np.float32)


def diverse(near: np.ndarray, apart: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, nearest first (-1: none), those nearer to the node than to any chosen one."""
    n, k = near.shape
    chosen = np.zeros((n, k), dtype=bool)
    for first in range(0, n, 512):
        part = slice(first, first + 512)
        v = x[np.maximum(near[part], 0)]
        square = (v * v).sum(axis=2)
        between = square[:, :, None] + square[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
        nearest = np.full((len(v), k), np.inf)
        held = np.zeros(len(v), dtype=np.int64)
        for c in range(k):
            take = (near[part, c] >= 0) & (apart[part, c] < nearest[:, c]) & (held < most)
            chosen[part, c] = take
            held += take
            nearest[take] = np.minimum(nearest[take], between[take, c])
    order = np.argsort(~chosen, axis=1, kind="stable")[:, :most]
    return np.where(np.take_along_axis(chosen, order, 1), np.take_along_axis(near, order, 1), -1)


def layer(x: np.ndarray, links: int) -> np.ndarray:
    """Neighbours (rows of at most 2 * links, -1 at the end) of nodes that were added in turn."""
    n = len(x)
    k = min(CANDIDATES, max(1, n - 1))
    near, apart = np.full((n, k), -1), np.full((n, k), np.inf)
    square = (x * x).sum(axis=1)
    for first in range(0, n, 512):
        last = min(n, first + 512)
        d = square[first:last, None] + square[None, :last] - 2 * (x[first:last] @ x[:last].T)
        d[np.arange(last)[None] >= np.arange(first, last)[:, None]] = np.inf
        some = min(k, last)
        at = np.argpartition(d, some - 1, axis=1)[:, :some]
        value = np.take_along_axis(d, at, 1)
        order = np.argsort(value, axis=1, kind="stable")
        value = np.take_along_axis(value, order, 1)
        near[first:last, :some] = np.where(np.isfinite(value), np.take_along_axis(at, order, 1), -1)
        apart[first:last, :some] = value
    forth = diverse(near, apart, x, links)
    a, b = np.nonzero(forth >= 0)
    source, target = np.concatenate([a, forth[a, b]]), np.concatenate([forth[a, b], a])
    d = ((x[source] - x[target]) ** 2).sum(axis=1)
    order = np.lexsort((target, d, source))
    source, target, d = source[order], target[order], d[order]
    place = np.arange(len(source)) - np.searchsorted(source, source)
    width = 4 * links
    keep = place < width
    near, apart = np.full((n, width), -1), np.full((n, width), np.inf)
    near[source[keep], place[keep]] = target[keep]
    apart[source[keep], place[keep]] = d[keep]
    return diverse(near, apart, x, 2 * links)


def _built(table: pa.Table, kind: str, links: int) -> pa.Table:
    """One shard as flat arrays; level 0 holds all nodes, each level above every ``links``-th or so."""
    dim = table["dim"][0].as_py()
    ids, raw = table["ids"].to_pylist(), table["vector"].to_pylist()
    order = np.random.default_rng(11).permutation(sorted(range(len(ids)), key=lambda i: (ids[i][0], raw[i])))
    values = np.frombuffer(b"".join(raw[i] for i in order), dtype=kind).reshape(len(ids), dim)
    scale = np.abs(values).max() or 1.0
    x = evened(values.astype(np.float64) / scale)
    levels, members = [], len(ids)
    while members:
        levels.append(layer(x[:members], links).astype(np.int32))
        members //= links
    rows = [np.int64([len(level) for level in levels]).tobytes(), b"".join(level.tobytes() for level in levels)]
    return pa.table({
        "dim": [dim], "shard": table["shard"].slice(0, 1), "ids": [np.int64([v for i in order for v in ids[i]]).tobytes()],
        "held": [np.int64([len(ids[i]) for i in order]).tobytes()], "vectors": [values.tobytes()],
        "levels": [rows[0]], "links": [rows[1]],
    })


def search(x: np.ndarray, levels: list[np.ndarray], q: np.ndarray, beam: int) -> np.ndarray:
    """For each query the nodes in its final beam (-1 where fewer), by inner product in single precision."""
    n, lanes = len(x), np.arange(len(q))
    if n <= beam:
        return np.repeat(np.arange(n)[None], len(q), axis=0)
    entry = np.zeros(len(q), dtype=np.int64)
    score = q @ x[0]
    for links in levels[:0:-1]:
        moving = lanes
        while len(moving):
            to = links[entry[moving]]
            value = np.einsum("qkd,qd->qk", x[np.maximum(to, 0)], q[moving])
            value[to < 0] = -np.inf
            best = value.argmax(axis=1)
            top = value[np.arange(len(moving)), best]
            better = top > score[moving]
            entry[moving[better]] = to[better, best[better]]
            score[moving[better]] = top[better]
            moving = moving[better]
    seen = np.zeros((len(q), n), dtype=bool)
    seen[lanes, entry] = True
    held = np.full((len(q), beam), -1)
    value = np.full((len(q), beam), -np.inf, dtype=np.float32)
    fresh = np.zeros((len(q), beam), dtype=bool)
    held[:, 0], value[:, 0], fresh[:, 0] = entry, score, True
    moving = lanes
    while len(moving):
        pick = np.where(fresh[moving], value[moving], -np.inf).argmax(axis=1)
        go = fresh[moving, pick]
        moving, pick = moving[go], pick[go]
        if not len(moving):
            break
        fresh[moving, pick] = False
        to = levels[0][held[moving, pick]].astype(np.int64)
        new = (to >= 0) & ~seen[moving[:, None], np.maximum(to, 0)]
        row, column = np.nonzero(new)
        seen[moving[row], to[row, column]] = True
        gained = np.full(to.shape, -np.inf, dtype=np.float32)
        gained[row, column] = np.einsum("kd,kd->k", x[to[row, column]], q[moving[row]])
        ids = np.concatenate([held[moving], np.where(new, to, -1)], axis=1)
        scores = np.concatenate([value[moving], gained], axis=1)
        unseen = np.concatenate([fresh[moving], new], axis=1)
        keep = np.argpartition(-scores, beam - 1, axis=1)[:, :beam]
        held[moving], value[moving], fresh[moving] = (np.take_along_axis(a, keep, 1) for a in (ids, scores, unseen))
    return held


def expanded(nodes: np.ndarray, score: np.ndarray, own: np.ndarray, ids: np.ndarray, held: np.ndarray, nearest: int):
    """Row, id and score of each row's ``nearest`` ids, by score and id, of the nodes it has (-1: none).

    Node k has ``held[k]`` ids, in order and without repeats, at least ``nearest`` + 1 of them if there are as many.
    """
    first = np.concatenate([[0], np.cumsum(held)[:-1]])
    low = ids[first]
    second = ids[first + (held > 1)]
    at = np.maximum(nodes, 0)
    lowest = np.where(low[at] == own[:, None], second[at], low[at])
    score = np.where((nodes < 0) | (lowest == own[:, None]), -np.inf, score)
    order = np.lexsort((lowest, -score), axis=1)[:, :nearest]
    score, at = np.take_along_axis(score, order, 1), np.take_along_axis(at, order, 1)
    row, column = np.nonzero(score > -np.inf)
    node = at[row, column]
    times = held[node]
    row, value = np.repeat(row, times), np.repeat(score[row, column], times)
    within = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    other = ids[np.repeat(first[node], times) + within]
    keep = other != own[row]
    row, value, other = row[keep], value[keep], other[keep]
    order = np.lexsort((other, -value, row))
    row, value, other = row[order], value[order], other[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < nearest
    return row[keep], other[keep], value[keep]


def _searched(queries: pa.Table, index: pa.Table, kind: str, nearest: int, beam: int, links: int) -> pa.Table:
    found: dict[str, list] = {"query_id": [], "query": [], "vec_id": [], "score": []}
    if queries.num_rows and index.num_rows:
        dim = index["dim"][0].as_py()
        values = np.frombuffer(index["vectors"][0].as_py(), dtype=kind).reshape(-1, dim)
        ids, held = (np.frombuffer(index[c][0].as_py(), dtype=np.int64) for c in ("ids", "held"))
        sizes = np.frombuffer(index["levels"][0].as_py(), dtype=np.int64)
        flat = np.frombuffer(index["links"][0].as_py(), dtype=np.int32).reshape(-1, 2 * links)
        levels = np.split(flat, np.cumsum(sizes)[:-1])
        x = (values / (np.abs(values).max() or 1.0)).astype(np.float32)
        raw, own = queries["vector"].to_pylist(), queries["vec_id"].to_numpy()
        number = queries["query"].to_numpy()
        for first in range(0, len(raw), LANES):
            part = slice(first, first + LANES)
            q = np.frombuffer(b"".join(raw[part]), dtype=kind).reshape(-1, dim).astype(np.float64)
            nodes = search(x, levels, (q / np.abs(q).max(axis=1, keepdims=True)).astype(np.float32), beam)
            score = np.einsum("qkd,qd->qk", values[np.maximum(nodes, 0)].astype(np.float64), q)
            row, other, score = expanded(nodes, score, own[part], ids, held, nearest)
            for name, a in zip(found, (own[part][row], number[part][row], other, score)):
                found[name].append(a)
    kinds = {"query_id": np.int64, "query": np.int64, "vec_id": np.int64, "score": np.float64}
    return pa.table({k: np.concatenate(v) if v else np.zeros(0, dtype=kinds[k]) for k, v in found.items()})


def nearest_neighbours(
    table: DataFrame, every: int = 20, nearest: int = 20, shard_rows: int = 8192, beam: int = 128, links: int = LINKS,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the nearest of each vector whose id ``every`` divides."""
    kind = "<f4" if isinstance(table.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    usable = table.where("vec_id is not null and embedding is not null").select("vec_id", "embedding").distinct()
    rows = stored(
        usable.select(F.col("vec_id").cast("long"), "embedding")
        .mapInArrow(partial(_encoded, kind=kind), "vec_id long, dim long, vector binary"), "vectors",
    )
    # the limit on the place also holds before the shuffle, task by task
    place = F.row_number().over(Window.partitionBy("dim", "vector").orderBy("vec_id"))
    nodes = stored(
        rows.withColumn("place", place).where(F.col("place") <= nearest + 1)
        .groupBy("dim", "vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "nodes",
    )
    shards = nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).alias("shards")).join(
        rows.groupBy("dim").agg(F.ceil(F.count_if(F.col("vec_id") % every == 0) / QUERY_BLOCK).alias("blocks")), "dim")
    index = stored(
        nodes.join(F.broadcast(shards), "dim")  # one row per length of vectors
        .withColumn("shard", F.expr("pmod(xxhash64(vector), shards)"))
        .select("dim", "shard", "ids", "vector").groupBy("dim", "shard").applyInArrow(
            lambda shard: _built(shard, kind, links),
            "dim long, shard long, ids binary, held binary, vectors binary, levels binary, links binary",
        ), "graphs",
    )
    asked = (
        rows.where(F.col("vec_id") % every == 0).withColumn("query", F.xxhash64("vec_id", "vector"))
        .join(F.broadcast(shards), "dim").withColumn("block", F.expr("pmod(xxhash64(query, 7), blocks)"))
        .withColumn("shard", F.explode(F.expr("sequence(0L, shards - 1)")))
        .select("dim", "shard", "block", "vec_id", "query", "vector")
    )
    spread = index.join(F.broadcast(shards), "dim").where("blocks > 0").withColumn(
        "block", F.explode(F.expr("sequence(0L, blocks - 1)"))).drop("shards", "blocks")
    keys = ["dim", "shard", "block"]
    found = asked.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(
        lambda queries, graph: _searched(queries, graph, kind, nearest, beam, links),
        "query_id long, query long, vec_id long, score double",
    )
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )
