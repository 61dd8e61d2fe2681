"""Row-wise normalisation of the fact table: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeshare.definition import Definition
from placeshare.functions import places


def stage_facts(facts: DataFrame, d: Definition) -> DataFrame:
    geography, geo_id = F.col("geography"), F.col("geo_id")
    return facts.select(
        "source",
        "geo_id",
        places.geo_level(geography).alias("geo_level"),
        places.country_code(geography, geo_id).alias("country_code"),
        *[
            places.matches_place_rule(geo_id, rule).alias(name)
            for rule, name in places.place_flags(d).items()
        ],
        "facet",
        "level",
        "variable",
        places.cluster_or_blank(F.col("cluster_name")).alias("cluster"),
        "value",
    )
