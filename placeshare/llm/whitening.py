"""Whitening of embeddings by shifted CholeskyQR over distributed Gram passes.

Each remaining entry c counts as x = floor(64 * c) + 1,000,000. The centred rows X are made
orthonormal without ever being gathered: a pass sums the Gram matrix of the rows task by task, the
Cholesky factor R of it plus a shift comes to the driver (dimensions squared, whatever the rows), and
the next pass solves the rows through the triangular factors so far before it sums again. The shift
keeps the first factors from breaking down on ill-conditioned data; passes go on until the Gram
matrix is the identity to rounding. With X = Q R, the composed R has the singular values and right singular vectors of X, to
an accuracy that the Gram matrix itself would not give: eigenvalues of the covariance are their
squares over n, components are the vectors. Directions whose singular value is less than ``EMPTY`` of
the largest (constant or dependent dimensions) are taken out there.

Sums are exact or do not depend on the order of tasks: numbers of rows and sums of x are whole
numbers, and the Gram matrices of tasks are added up in the order of tasks, in written rounds of
``FAN`` to one. Only sums and matrices of dimensions squared come to the driver.

Rows whose vector is null, empty, or holds null, non-finite or (from 2**40 on) huge entries are
dropped. Of several lengths of vectors, the commonest (of equally common ones the longest) is
whitened, the others are dropped. Repeated rows and null vec_ids count like others. Components that
have no variance are not returned, so equal vectors and empty tables give an empty result. A
``deviation`` beyond a long is null. Columns other than ``vec_id`` and ``embedding`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeshare.llm.common import runs, stored

SCALE = 64  # the constant that is added to each entry cancels out when rows are centred
HUGE = 2.0 ** 40
FAN = 32
PASSES = 12
EMPTY = 2.0 ** -40  # a direction with less than this part of the largest singular value holds rounding only
BATCH = 4096


def _entries(batch: pa.RecordBatch, dim: int | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places of the usable vectors and their x, less the constant that all have."""
    column = batch["embedding"]
    size = column.value_lengths().fill_null(0).to_numpy()
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    if flat.null_count:
        values[flat.is_null().to_numpy(zero_copy_only=False)] = np.nan
    start = np.cumsum(size) - size
    out = {}
    for d in np.unique(size[size > 0]).tolist() if dim is None else [dim]:
        at = np.flatnonzero(size == d)
        rows = values[start[at][:, None] + np.arange(d)]
        good = (np.abs(rows) < HUGE).all(axis=1)  # false for what is no number
        out[d] = at[good], np.floor(SCALE * rows[good]).astype(np.int64)
    return out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each length: the number of vectors and the sums of their entries."""
    n: dict[int, int] = {}
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, (at, x) in _entries(batch).items():
            n[dim] = n.get(dim, 0) + len(at)
            sums[dim] = sums.get(dim, 0) + x.sum(axis=0)
    dims = [d for d in n if n[d]]
    yield pa.RecordBatch.from_arrays(
        [pa.array(dims, pa.int32()), pa.array([n[d] for d in dims], pa.int64()),
         pa.array([sums[d].tolist() for d in dims], pa.list_(pa.int64()))], names=["dim", "n", "sums"],
    )


def solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """``rows`` times the inverses of the factors: upper triangles by substitution, others (d x k) as products."""
    for kind, r in factors:
        if kind == "times":
            rows = rows @ r
            continue
        out = np.empty((r.shape[0], len(rows)))
        for j in range(r.shape[0]):
            out[j] = (rows[:, j] - r[:j, j] @ out[:j]) / r[j, j]
        rows = out.T
    return rows


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n. Whole numbers below 2**40 and their means: the difference is rounded once or twice."""
    whole, part = np.divmod(sums, n)
    return (x - whole) - part / n


def _gram(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray, factors: list) -> Iterator[pa.RecordBatch]:
    """This task's Gram matrix of solved rows, with a last row of their sums."""
    dim, total = len(sums), None
    for batch in batches:
        at, x = _entries(batch, dim)[dim]
        for first in range(0, len(at), BATCH):
            q = solved(_centred(x[first: first + BATCH], n, sums), factors)
            part = np.vstack([q.T @ q, q.sum(axis=0)])
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "gram"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each group's matrices, in the order of their parts."""
    for run in runs(batches, ["group"]):
        total = sum(np.frombuffer(g) for g in run["gram"].to_pylist())
        yield pa.RecordBatch.from_arrays(
            [pa.array([run["group"][0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "gram"])


class Gram:
    """Sums of Gram matrices over one table."""

    def __init__(self, rows: DataFrame, n: int, sums: np.ndarray):
        self.rows, self.n, self.sums = rows.select("embedding"), n, sums

    def of(self, factors: list) -> tuple[np.ndarray, np.ndarray]:
        """The Gram matrix and the sums of the centred rows, solved through ``factors``."""
        level = stored(self.rows.mapInArrow(
            partial(_gram, n=self.n, sums=self.sums, factors=factors), "part long, gram binary"), "gram")
        while level.select(F.max("part")).first()[0]:
            groups = level.select("part", F.expr(f"part div {FAN}").alias("group"), "gram")
            level = stored(
                groups.repartition("group").sortWithinPartitions("group", "part").mapInArrow(_added, "part long, gram binary"), "gram")
        total = np.frombuffer(level.first()["gram"])
        width = int((-1 + np.sqrt(1 + 4 * len(total))) / 2 + 0.5)
        total = total.reshape(width + 1, width)
        return total[:-1], total[-1]


def factorised(gram, n: int, dim: int) -> np.ndarray:
    """R of the centred rows' QR decomposition, from ``gram(factors)``: passes of shifted Cholesky factors."""
    g = gram([])[0]
    size = np.sqrt(np.diag(g))
    used = np.flatnonzero(size > 0)
    if not len(used):
        return np.zeros((0, dim))
    # columns of unit length first: the inverse of a diagonal factor
    start = np.zeros((dim, len(used)))
    start[used, np.arange(len(used))] = 1 / size[used]
    factors, r = [("times", start)], np.zeros((len(used), dim))
    r[np.arange(len(used)), used] = size[used]
    g = start.T @ g @ start
    for turn in range(PASSES):
        k = len(g)
        values = np.linalg.eigvalsh(g)
        if np.abs(g - np.eye(k)).max() <= 64 * np.finfo(float).eps * k:
            break
        # the shift of the first passes: 11 (m k + k (k + 1)) u |X|**2; none once the rows are nearly orthonormal
        shift = 11 * (n * k + k * (k + 1)) * np.finfo(float).eps / 2 * values[-1] if values[0] < 0.1 else 0.0
        triangle = np.linalg.cholesky(g + min(shift, 1e-2) * np.eye(k)).T
        factors.append(("solve", triangle))
        r = triangle @ r
        g = gram(factors)[0]
    return r


def components(gram, n: int, dim: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues of the covariance by falling size, unit vectors as columns, and its trace."""
    r = factorised(gram, n, dim)
    _, s, v = np.linalg.svd(r, full_matrices=False)
    real = s > s.max(initial=0) * EMPTY  # what is less comes from rounding
    s, v = s[real], v[real]
    values = s * s / n
    return values[:most], v[:most].T, float(values.sum())


def _whitened(batches: Iterator[pa.RecordBatch], n: int, sums: np.ndarray, axes: np.ndarray):
    """``vec_id``, ``deviation`` and the whitened entries of each usable row."""
    dim = len(sums)
    for batch in batches:
        at, x = _entries(batch, dim)[dim]
        for first in range(0, len(at), BATCH):
            rows, ids = x[first: first + BATCH], batch["vec_id"].take(pa.array(at[first: first + BATCH]))
            white = _centred(rows, n, sums) @ axes
            most = max((abs(n * int(v) - s) for s, low, high in zip(sums.tolist(), rows.min(axis=0), rows.max(axis=0)) for v in (low, high)), default=0)
            if dim * most * most < 1 << 63:
                deviation = ((n * rows - sums) ** 2).sum(axis=1).tolist()
            else:
                exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums.tolist())) for row in rows.tolist()]
                deviation = [e if e < 1 << 63 else None for e in exact]
            k = axes.shape[1]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(deviation, pa.int64()),
                 pa.FixedSizeListArray.from_arrays(pa.array(white.ravel()), k).cast(pa.list_(pa.float64()))],
                names=["vec_id", "deviation", "whitened"],
            )


def whitened(table: DataFrame, most: int = 32) -> DataFrame:
    """Each remaining row (``vec_id``, ``embedding``) and component up to ``most``.

    ``vec_id``, ``component`` (from 1, by falling eigenvalue), ``n``, ``deviation``, ``whitened``,
    ``explained`` (the eigenvalue's share of the covariance's trace), ``identity_error`` (the largest
    entry of the whitened rows' covariance less the identity, measured in a pass of its own).
    """
    rows = table.where("embedding is not null").select("vec_id", "embedding")
    kind = dict(table.dtypes)["vec_id"]
    shape = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = stored(rows.select("embedding").mapInArrow(_sums, "dim int, n long, sums array<bigint>"), "sums")
    top = lengths.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if top is None:
        return table.sparkSession.createDataFrame([], shape)
    dim, n = top["dim"], top["n"]
    totals = (
        lengths.where(F.col("dim") == dim).select(F.posexplode("sums").alias("at", "s"))
        .groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()
    )
    sums = np.array([t["s"] for t in totals], dtype=np.int64)
    gram = Gram(rows, n, sums)
    values, vectors, trace = components(lambda factors: gram.of(factors), n, dim, most)
    if not len(values):
        return table.sparkSession.createDataFrame([], shape)
    axes = vectors / np.sqrt(values)
    g, means = gram.of([("times", axes)])
    error = float(np.abs(g / n - np.outer(means, means) / n ** 2 - np.eye(len(values))).max())
    each = rows.mapInArrow(
        partial(_whitened, n=n, sums=sums, axes=axes), f"vec_id {kind}, deviation long, whitened array<double>")
    share = F.array(*(F.lit(float(v / trace)) for v in values))
    return each.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )
