"""Each place's share against the rest of its parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeshare.definition import Definition
from placeshare.functions import places, stats
from placeshare.operators.joins import join_parent


def with_parent(shares: DataFrame, d: Definition) -> DataFrame:
    """Children (places below global) with the parent's x and n as ``parent_x``, ``parent_n``."""
    children = shares.filter(F.col("geo_level").isin("country", "subregion")).withColumn(
        "parent_id", places.parent_id(F.col("geo_level"), F.col("country_code"), d)
    )
    parents = shares.filter(F.col("geo_level").isin("global", "country")).select(
        *d.keys, "source", "metric", F.col("geo_id").alias("parent_id"),
        F.col("x").alias("parent_x"), F.col("n").alias("parent_n"),
    )
    return join_parent(
        children, parents, [*d.keys, "source", "metric", "parent_id"], ["geo_id"], d.salts
    )


def vs_rest(shares: DataFrame, d: Definition) -> DataFrame:
    x, n = F.col("x"), F.col("n")
    gap_x, gap_n = stats.rest_of_parent(F.col("parent_x"), x, F.col("parent_n"), n)
    without_place = lambda d: d.rest_excludes_self
    x_rest = d.choose(without_place, lambda own: gap_x if own else F.col("parent_x"))
    n_rest = d.choose(without_place, lambda own: gap_n if own else F.col("parent_n"))
    z = d.choose(lambda d: d.z_rest, F.lit)

    def interval(part: int) -> Column:
        return d.choose(lambda d: d.rest_two_sample, lambda two: stats.wald_diff_ci(
            F.col("share"), n, F.col("share_rest"), F.col("n_rest"), z, two
        )[part])

    return (
        with_parent(shares, d)
        .filter(gap_n >= d.choose(lambda d: d.min_rest, F.lit))
        .withColumn("x_rest", x_rest)
        .withColumn("n_rest", n_rest)
        .withColumn("share_rest", stats.ratio(F.col("x_rest"), F.col("n_rest")))
        .select(
            *d.keys, "source", "geo_id", "metric", "parent_id", "x", "n", "share",
            "x_rest", "n_rest", "share_rest",
            interval(0).alias("diff"), interval(1).alias("diff_lo"), interval(2).alias("diff_hi"),
        )
    )
