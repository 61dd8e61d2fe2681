"""Conversations per resident against the pooled rate of a peer set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeshare.definition import Definition
from placeshare.functions import places, stats


def usage_rows(staged: DataFrame, d: Definition) -> DataFrame:
    rows = staged.filter(
        (F.col("source") == d.chat_source)
        & F.col("facet").isin("country", "country-state")
        & (F.col("variable") == "usage_count")
        & ~places.left_out_always(d)
    )
    return d.tagged(rows).filter(places.kept_place(d)).select(
        *d.keys, "geo_id", "geo_level", F.col("value").alias("conversations")
    )


def populations(countries: DataFrame, provinces: DataFrame) -> DataFrame:
    """Both place dimensions in one lookup, so usage is joined once."""
    return countries.select(
        F.col("iso2").alias("geo_id"), F.lit("country").alias("geo_level"), "population"
    ).unionByName(
        provinces.select("geo_id", F.lit("subregion").alias("geo_level"), "population")
    ).withColumn("listed", F.lit(True))


def peer_candidates(
    staged: DataFrame, countries: DataFrame, provinces: DataFrame, d: Definition
) -> DataFrame:
    """Usage with population, whether it counts as known, and whether it is in the peer set."""
    country = F.col("geo_level") == "country"
    listed = F.coalesce(F.col("listed"), F.lit(False))
    listed_province = (F.col("geo_level") == "subregion") & listed
    known_province = d.choose(
        lambda d: d.province_total_scope,
        lambda scope: listed_province if scope == "dimension"
        else F.col("geo_level") == "subregion",
    )
    has_population = d.choose(
        lambda d: d.require_population,
        lambda needed: F.coalesce(F.col("population") > 0, F.lit(False)) if needed else F.lit(True),
    )
    enough = F.col("conversations") >= d.choose(lambda d: d.min_usage, F.lit)
    return (
        usage_rows(staged, d)
        .join(populations(countries, provinces), ["geo_id", "geo_level"], "left")
        .withColumn("is_known", country | known_province)
        .withColumn("in_pool", enough & ((country & has_population) | listed_province))
    )


def pool_totals(candidates: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per place level and version. An aggregate, not a window: two levels would be two tasks."""
    conversations, people = F.col("conversations"), F.col("population")
    return candidates.groupBy(*keys, "geo_level").agg(
        F.sum(F.when(F.col("is_known"), conversations)).alias("known_conversations"),
        F.sum(F.when(F.col("in_pool"), conversations)).alias("pool_conversations"),
        F.sum(F.when(F.col("in_pool"), people)).alias("pool_population"),
    )


def geo_usage(
    staged: DataFrame, countries: DataFrame, provinces: DataFrame, d: Definition
) -> DataFrame:
    candidates = peer_candidates(staged, countries, provinces, d)
    # one row per place level (global, country, subregion) and version: bounded whatever the data
    totals = F.broadcast(pool_totals(candidates, d.keys))
    conversations, people = F.col("conversations"), F.col("population")
    index = stats.usage_index(
        conversations, people, F.col("pool_conversations"), F.col("pool_population")
    )
    low, high = stats.poisson_band(F.col("usage_index"), conversations, d.choose(lambda d: d.z_index, F.lit))
    return (
        candidates.filter("in_pool")
        .join(totals, [*d.keys, "geo_level"])
        .withColumn("usage_index", index)
        .select(
            *d.keys,
            "geo_id",
            "geo_level",
            "conversations",
            "population",
            stats.ratio(conversations, F.col("known_conversations")).alias("share_of_known"),
            stats.per_residents(conversations, people, d.choose(lambda d: d.per_capita_base, F.lit)).alias("per_100k"),
            "usage_index",
            low.alias("usage_index_lo"),
            high.alias("usage_index_hi"),
        )
    )
