"""From one row per sampled record to the long table of counts and percentages.

This is where the data volume is. The raw records are read once and reduced, before any
shuffle, to one counter per (source, finest place, facet, label); every coarser level is then
built from those counters, so no grouping-set expansion ever touches a raw record.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeshare.definition import GLOBAL_ID
from placeshare.functions.places import place_prefix
from placeshare.operators.joins import join_parent
from placeshare.sources.storage import written


@dataclass(frozen=True)
class RollupSpec:
    """Which record columns are facets, and what to stamp on the rows."""

    facets: Mapping[str, int]  # facet column -> level of its labels
    place_sources: Sequence[str]  # sources published by place; the rest go to GLOBAL only
    platforms: Mapping[str, str]  # source -> platform_and_product
    date_start: str
    date_end: str
    salts: int = 8  # copies of a place's total, so that its labels spread over tasks


def leaf_counts(records: DataFrame, spec: RollupSpec) -> DataFrame:
    """Count labels at the finest place. One scan; map-side combined; no hot group."""
    return (
        records.unpivot(
            ["source", "country", "subregion"], list(spec.facets), "facet", "cluster_name"
        )
        .groupBy("source", "country", "subregion", "facet", "cluster_name")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )


def _by_place(leaf: DataFrame, spec: RollupSpec) -> DataFrame:
    """The three place levels from the leaf counters, in one grouping-sets pass."""
    country, subregion = F.col("country"), F.col("subregion")
    keys = [F.col("source"), country, subregion, F.col("facet"), F.col("cluster_name")]
    always = ["source", "facet", "cluster_name"]
    at_country = F.grouping("country") == 0
    at_subregion = F.grouping("subregion") == 0
    return (
        leaf.groupingSets(
            [always, [*always, "country"], [*always, "subregion"]], *keys
        )
        .agg(
            F.sum("n").alias("n"),
            F.when(at_country, "country").when(at_subregion, "country-state")
            .otherwise("global").alias("geography"),
        )
        .withColumn(
            "geo_id",
            F.when(F.col("geography") == "global", F.lit(GLOBAL_ID))
            .when(F.col("geography") == "country", country)
            .otherwise(subregion),
        )
        .filter(
            (F.col("geography") == "global") | F.col("source").isin(*spec.place_sources)
        )
        .filter(F.col("geo_id").isNotNull())
        .select("source", "geo_id", "geography", "facet", "cluster_name", "n")
    )


def _count_and_pct(df: DataFrame, count_name: Column, pct_name: Column) -> DataFrame:
    """Two rows per cell: its count ``n`` and its percentage of ``total``."""
    return df.select(
        "source", "geo_id", "geography", "facet", "level", "cluster_name",
        F.stack(
            F.lit(2),
            count_name, F.col("n"),
            pct_name, F.lit(100.0) * F.col("n") / F.col("total"),
        ).alias("variable", "value"),
    )


#: what a cell is counted by
CELL_KEYS = ("source", "geo_id", "geography", "facet", "cluster_name")


def cells_of(records: DataFrame, spec: RollupSpec) -> DataFrame:
    """records(source, country, subregion, <one column per facet>) -> counts at three place levels.

    The leaf counters are written once: grouping sets expand counters, never records.
    """
    return _by_place(written(leaf_counts(records, spec), "leaf_counts"), spec)


def rollup_facts(records: DataFrame, spec: RollupSpec) -> DataFrame:
    """records(source, country, subregion, <one column per facet>) -> the long fact table.

    The cells of the three place levels are written once, because the rest reads them several
    times: without that, every use would count again.
    """
    return facts_of(written(cells_of(records, spec), "cells"), spec)


def facts_of(cells: DataFrame, spec: RollupSpec) -> DataFrame:
    """Counts by ``CELL_KEYS`` -> the long fact table of counts and percentages."""
    totals = cells.groupBy("source", "geo_id", "facet").agg(F.sum("n").alias("total"))

    level = F.lit(None).cast("int")
    for facet, its_level in spec.facets.items():
        level = F.when(F.col("facet") == facet, its_level).otherwise(level)
    labels = _count_and_pct(
        join_parent(
            cells.filter(F.col("cluster_name").isNotNull()), totals,
            ["source", "geo_id", "facet"], ["cluster_name"], spec.salts,
        ).withColumn("level", level),
        F.concat("facet", F.lit("_count")),
        F.concat("facet", F.lit("_pct")),
    )

    # every record has exactly one entry per facet, so any one facet adds up to the usage
    any_facet = next(iter(spec.facets))
    usage = (
        cells.filter((F.col("facet") == any_facet) & F.col("source").isin(*spec.place_sources))
        .groupBy("source", "geo_id", "geography")
        .agg(F.sum("n").alias("n"))
    )
    parent = (
        F.when(F.col("geography") == "country", F.lit(GLOBAL_ID))
        .otherwise(place_prefix(F.col("geo_id")))
    )
    parents = usage.filter(F.col("geography").isin("global", "country")).select(
        "source", F.col("geo_id").alias("parent_id"), F.col("n").alias("total")
    )
    usage_rows = _count_and_pct(
        join_parent(
            usage.filter(F.col("geography") != "global").withColumn("parent_id", parent),
            parents, ["source", "parent_id"], ["geo_id"], spec.salts, how="left",
        )
        .withColumn("facet", F.col("geography"))
        .withColumn("level", F.lit(0))
        .withColumn("cluster_name", F.lit(None).cast("string")),
        F.lit("usage_count"),
        F.lit("usage_pct"),
    )

    platform = F.lit(None).cast("string")
    for source, text in spec.platforms.items():
        platform = F.when(F.col("source") == source, text).otherwise(platform)
    return labels.unionByName(usage_rows).select(
        "source", "geo_id", "geography",
        F.lit(spec.date_start).cast("date").alias("date_start"),
        F.lit(spec.date_end).cast("date").alias("date_end"),
        platform.alias("platform_and_product"),
        "facet", "level", "variable", "cluster_name", "value",
    )
