"""Drill-downs: where subregions do not add up, and what a defect moved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeshare.definition import Definition
from placeshare.functions import places, stats


def usage_counts(facts: DataFrame, geography: str, d: Definition) -> DataFrame:
    return facts.filter(
        (F.col("source") == d.chat_source) & (F.col("facet") == geography)
        & (F.col("geography") == geography) & (F.col("variable") == "usage_count")
    ).select("geo_id", "value")


def subregion_sums(facts: DataFrame, d: Definition) -> DataFrame:
    """Per country prefix, all subregions included, also the unclassified one."""
    return usage_counts(facts, "country-state", d).groupBy(
        places.place_prefix(F.col("geo_id")).alias("parent")
    ).agg(F.count(F.lit(1)).alias("subregions"), F.sum("value").alias("subregion_sum"))


def territory_sums(facts: DataFrame, territories: DataFrame, d: Definition) -> DataFrame:
    """Territories of a parent that are countries of their own: ``code=count`` list and sum."""
    counted = territories.select("parent", F.col("territory").alias("geo_id")).join(
        usage_counts(facts, "country", d), "geo_id"
    )
    entry = F.struct(
        F.col("geo_id").alias("code"),
        F.concat_ws("=", "geo_id", F.bround("value").cast("long").cast("string")).alias("text"),
    )
    # one list entry per row of the territory table with this parent: a handful
    return counted.groupBy("parent").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), ", "
        ).alias("territories"),
        F.sum("value").alias("territory_sum"),
    )


def rollup_gaps(facts: DataFrame, territories: DataFrame, d: Definition) -> DataFrame:
    """Every country that has both a count and subregions, with the difference explained."""
    gap = F.col("subregion_sum") - F.col("country_count")
    return (
        subregion_sums(facts, d)
        .join(
            usage_counts(facts, "country", d).select(
                F.col("geo_id").alias("parent"), F.col("value").alias("country_count")
            ),
            "parent",
        )
        .join(territory_sums(facts, territories, d), "parent", "left")
        .select(
            "parent", "subregions", "country_count", "subregion_sum", gap.alias("gap"),
            "territories", "territory_sum",
            (gap - F.coalesce("territory_sum", F.lit(0.0))).alias("unexplained"),
        )
    )


def rollup_report(facts: DataFrame, territories: DataFrame, d: Definition) -> DataFrame:
    return rollup_gaps(facts, territories, d).filter(F.col("gap") != 0)


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("metric", "column").agg(F.count(F.lit(1)).alias("cells"))


def largest_errors(issues: DataFrame, k: int = 8) -> DataFrame:
    """The k cells that are furthest off, relative to the reference value."""
    error = stats.relative_error_pct(F.col("sut_value"), F.col("ref_value"))
    return (
        issues.filter(F.col("sut_value").isNotNull() & F.col("ref_value").isNotNull())
        .withColumn("error_pct", error)
        .orderBy(F.abs("error_pct").desc_nulls_last(), "metric", "key", "column")
        .limit(k)
        .select("metric", "key", "column", "sut_value", "ref_value", "error_pct")
    )
