"""Exact quantiles of groups without holding or sorting a group anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeshare.operators.joins import join_parent
from placeshare.sources.storage import written

CELLS = 256


def grouped_quantile(
    rows: DataFrame,
    by: Sequence[str],
    value: str,
    weight: str | None = None,
    q: float = 0.5,
    name: str = "quantile",
    cells: int = CELLS,
    salts: int = 8,
) -> DataFrame:
    """``by`` and the interpolated quantile ``q`` of a number within each group.

    ``weight`` counts a row so many times (whole, positive). Missing values (and NaN) do not count;
    a group without others gets null. The two ranks that a quantile lies between are sought together: each has a
    range of values, first the group's. A round counts the rows of the range in ``cells`` parts of
    equal width, takes the part with the rank, and goes on with the values that really are in it, until
    one value is left. Both ends of a range fall into different parts, so each round leaves fewer
    values; a few rounds do for numbers of similar size. Counters are combined before they are
    shuffled, and a group's ranges are copied over salts, so a group with a third of all rows is
    spread like any other. The driver sees how many ranks are still open.
    """
    spark = rows.sparkSession
    counted = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    groups = rows.select(*by).distinct()
    usable = rows.select(*by, F.col(value).cast("double").alias("__v"), counted.alias("__w")).filter(
        F.col("__v").isNotNull() & ~F.isnan("__v")
    )
    # null keys are a group, too
    known = [f"__by_{i}" for i in range(len(by))]
    usable = written(usable.select(
        *[F.struct(F.col(c)).alias(k) for c, k in zip(by, known)],
        (F.col("__v") + F.lit(0.0)).alias("__v"), "__w",
    ), "values")
    place = (F.col("n") - 1) * F.lit(float(q))
    ranks = F.array(F.floor(place), F.ceil(place))
    targets = written(
        usable.groupBy(*known).agg(
            F.sum("__w").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high")
        ).select(
            *known, "low", "high", F.lit(0).cast("long").alias("below"),
            (place - F.floor(place)).alias("share"), F.posexplode(ranks).alias("side", "rank"),
        ), "ranks",
    )
    found = []
    while True:
        found.append(targets.filter("low = high"))
        open_ = targets.filter("low < high")
        if not open_.limit(1).count():
            break
        targets = written(_narrowed(usable, open_, known, cells, salts), "ranks")
    ends = found[0]
    for more in found[1:]:
        ends = ends.unionByName(more)
    low, high = (F.max(F.when(F.col("side") == side, F.col("low"))) for side in (0, 1))
    between = low + (high - low) * F.max("share")
    values = ends.groupBy(*known).agg(between.alias(name)).select(
        *[F.col(k).getField(c).alias(f"__of_{i}") for i, (k, c) in enumerate(zip(known, by))], name
    )
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{i}"))
    return groups.join(values, same, "left").select(*by, name)


def _narrowed(
    usable: DataFrame, targets: DataFrame, known: Sequence[str], cells: int, salts: int
) -> DataFrame:
    """The open ranks with the range that one more histogram leaves."""
    value, low, high = F.col("__v"), F.col("low"), F.col("high")
    # halved, as the width of the whole range may be beyond the largest number
    place = F.try_divide(value / 2 - low / 2, high / 2 - low / 2) * cells
    cell = F.when(value == high, cells - 1).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(cells - 2), F.floor(F.coalesce(place, F.lit(0.0)))))
    )
    inside = join_parent(usable, targets, known, ["__v"], salts, value.between(low, high))
    key = [*known, "side", "rank", "below", "share"]
    counts = inside.groupBy(*key, cell.cast("int").alias("cell")).agg(
        F.sum("__w").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high")
    )
    part = F.struct("cell", "n", "low", "high")
    return counts.groupBy(*key).agg(F.sort_array(F.collect_list(part)).alias("parts")).select(
        *known, "side", "rank", "share", _holding(F.col("parts")).alias("p")
    ).select(
        *known, "p.low", "p.high", "p.below", "share", "side", "rank"
    )


def _holding(parts: Column) -> Column:
    """The part that holds the rank, and how many rows come before it: at most ``cells`` parts."""
    start = F.struct(
        F.col("below").alias("before"),
        F.expr("cast(null as struct<low:double,high:double,below:bigint>)").alias("it"),
    )

    def step(s: Column, p: Column) -> Column:
        here = s["it"].isNull() & (F.col("rank") < s["before"] + p["n"])
        it = F.struct(p["low"].alias("low"), p["high"].alias("high"), s["before"].alias("below"))
        return F.struct(
            (s["before"] + p["n"]).alias("before"), F.when(here, it).otherwise(s["it"]).alias("it")
        )

    return F.aggregate(parts, start, step, lambda s: s["it"])
