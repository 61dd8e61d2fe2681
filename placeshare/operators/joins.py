"""Join helpers for the shapes these metrics need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "__salt"


def join_parent(
    children: DataFrame,
    parents: DataFrame,
    keys: Sequence[str],
    spread_on: Sequence[str],
    salts: int,
    residual: Column | None = None,
    how: str = "inner",
) -> DataFrame:
    """Lookup of many children in few parents, where one parent may be very hot.

    Every place hangs off a handful of parents, and the root alone can own most of the rows, so
    a plain shuffle on the parent key would send them to one task. The parents are copied once
    per salt and the children spread over the salts by a hash of their own identity, which
    bounds a task to 1/salts of the hottest parent. No broadcast is forced: the planner (and, at
    run time, adaptive execution) broadcasts the parents only when their measured size is under
    ``spark.sql.autoBroadcastJoinThreshold``.
    """
    salted_children = children.withColumn(
        SALT, F.pmod(F.xxhash64(*spread_on), F.lit(salts)).cast("int")
    )
    salted_parents = parents.withColumn(
        SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    joined = salted_children.join(salted_parents, [*keys, SALT], how).drop(SALT)
    return joined if residual is None else joined.filter(residual)


def mark_in(df: DataFrame, key: str, values: DataFrame, value: str, mark: str) -> DataFrame:
    """Add a boolean: is ``key`` one of the (distinct, non-null) ``values``?

    The left side is the one that may be skewed on ``key``; duplicates in the list cannot
    multiply its rows.
    """
    listed = (
        values.select(F.col(value).alias(key))
        .filter(F.col(key).isNotNull())
        .distinct()
        .withColumn(mark, F.lit(True))
    )
    return df.join(listed, key, "left").withColumn(mark, F.coalesce(F.col(mark), F.lit(False)))
