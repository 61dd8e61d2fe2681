"""Exact numbering within groups without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeshare.sources.storage import written_as_is


def number_within(df: DataFrame, group: str, key: str, name: str, width: int = 4096) -> DataFrame:
    """1-based position by an integer ``key`` inside ``group``.

    Keys are cut into buckets of ``width``. Bucket sizes are counted (map-side combined) and
    accumulated per group, and only the rows of one bucket are ever sorted together, so a group
    holding a third of the table is still spread over many tasks.
    """
    bucket = F.floor(F.col(key) / F.lit(width)).alias("__bucket")
    bucketed = df.select("*", bucket)
    sizes = bucketed.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(
        group, "__bucket",
        F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"),
    )
    inside = F.row_number().over(Window.partitionBy(group, "__bucket").orderBy(key))
    return (
        bucketed.withColumn("__inside", inside)
        .join(offsets, [group, "__bucket"])
        .withColumn(name, (F.col("__offset") + F.col("__inside")).cast("long"))
        .drop("__bucket", "__inside", "__offset")
    )


NUMBERS = ("row_number", "rank", "dense_rank")


def number_rows(
    df: DataFrame,
    order: Sequence[tuple[Column, bool]],
    by: Sequence[str] = (),
    names: Mapping[str, str] = {"row_number": "position"},
    ranges: int | None = None,
) -> DataFrame:
    """Row number, rank and dense rank by any order, within ``by`` or over the whole table.

    ``order`` lists sort keys, each with whether it falls; nulls come last either way.
    ``names`` says which numbers are wanted and what they are called. Rows are cut into ranges of
    the order at sampled splitters; a hash of the row as last sort key lets rows that tie, or a
    group with a third of the table, fill many ranges. The ranges are written, so that they stay as
    they are when a task is run again, and numbered one by one. What goes before a range is a fold
    over one small row per range and group: rows, distinct keys, and the rank of the last key,
    which a tie carries over the cut. Row numbers among ties follow the hash, so rows that are
    equal in all columns are the only ones whose numbers could be exchanged.
    """
    unknown = set(names) - set(NUMBERS)
    if unknown:
        raise ValueError(f"no such number: {', '.join(sorted(unknown))}")
    spark, own = df.sparkSession, list(df.columns)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"__key_{i}" for i in range(len(order))]
    keyed = df.select(
        "*", *[value.alias(k) for k, (value, _) in zip(keys, order)],
        F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in own]).alias("__tie"),
    )
    sort = [
        F.desc_nulls_last(k) if falls else F.asc_nulls_last(k) for k, (_, falls) in zip(keys, order)
    ]
    ranged = keyed.repartitionByRange(ranges, *by, *sort, "__tie").withColumn(
        "__range", F.spark_partition_id()
    )
    cut = written_as_is(ranged, "ranges")

    inside = Window.partitionBy("__range", *by).orderBy(*sort)
    numbered = cut.select(
        "*",
        F.row_number().over(Window.partitionBy("__range", *by).orderBy(*sort, "__tie")).alias("__row"),
        F.rank().over(inside).alias("__rank"),
        F.dense_rank().over(inside).alias("__dense"),
    )
    key = F.struct(*keys)
    parts = numbered.groupBy("__range", *by).agg(
        F.count(F.lit(1)).alias("rows"), F.max("__dense").alias("keys"), F.max("__rank").alias("last_rank"),
        F.min_by(key, "__row").alias("first"), F.max_by(key, "__row").alias("last"),
    )
    part = F.struct(F.col("__range").alias("at"), "rows", "keys", "last_rank", "first", "last")
    lists = parts.groupBy(*by).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    offsets = lists.select(*by, F.explode(_folded(F.col("parts"))).alias("o")).select(
        *[F.col(c).alias(f"__by_{i}") for i, c in enumerate(by)], "o.*"
    )
    same = F.col("__range") == F.col("at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{i}"))
    carried = F.col("tied") & (F.col("__dense") == 1)
    values = {
        "row_number": F.col("rows_before") + F.col("__row"),
        "rank": F.when(carried, F.col("rank_before")).otherwise(F.col("rows_before") + F.col("__rank")),
        "dense_rank": F.col("keys_before") + F.col("__dense"),
    }
    return numbered.join(offsets, same).select(
        *[F.col(f"`{c}`") for c in own], *[values[kind].cast("long").alias(name) for kind, name in names.items()]
    )


def _folded(parts: Column) -> Column:
    """What goes before each range of a group, from the ranges in order."""
    start = F.struct(
        F.expr("cast(array() as array<struct<at:int,rows_before:bigint,keys_before:bigint,tied:boolean,rank_before:bigint>>)")
        .alias("all"),
        F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("keys"),
        F.lit(0).cast("long").alias("rank"),
        F.get(parts, F.lit(0))["last"].alias("last"),
    )

    def step(s: Column, p: Column) -> Column:
        tied = (s["rows"] > 0) & p["first"].eqNullSafe(s["last"])
        # one key that began in a range before: its rank stays
        rank = F.when(tied & (p["keys"] == 1), s["rank"]).otherwise(s["rows"] + p["last_rank"])
        before = F.struct(
            p["at"].alias("at"), s["rows"].alias("rows_before"),
            (s["keys"] - tied.cast("int")).alias("keys_before"), tied.alias("tied"),
            s["rank"].alias("rank_before"),
        )
        return F.struct(
            F.concat(s["all"], F.array(before)).alias("all"),
            (s["rows"] + p["rows"]).alias("rows"),
            (s["keys"] + p["keys"] - tied.cast("int")).cast("long").alias("keys"),
            rank.cast("long").alias("rank"), p["last"].alias("last"),
        )

    return F.aggregate(parts, start, step, lambda s: s["all"])
