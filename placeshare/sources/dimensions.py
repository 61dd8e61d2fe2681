"""Reference tables: country list, populations, occupation groups and the small lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeshare.inputs import (
    COUNTRY_SCHEMA, GROUP_SCHEMA, LENS_SCHEMA, OCCUPATION_SCHEMA, TERRITORY_SCHEMA, typed,
)

# Field positions in the 19-column tab-separated country list.
COUNTRY_FIELDS = {"iso2": 0, "iso3": 1, "country": 4, "population": 7, "continent": 8}
COUNTRY_FILE_WIDTH = 19

POPULATION_SCHEMA = T.StructType([
    T.StructField("iso3", T.StringType()),
    T.StructField("wb_name", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("population", T.LongType()),
])
REGION_SCHEMA = T.StructType([
    T.StructField("geo_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("population", T.LongType()),
    T.StructField("as_of", T.StringType()),
    T.StructField("source", T.StringType()),
])


def scan_geonames_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Five fields of the country list. Comments and blanks skipped, short rows accepted."""
    wide = T.StructType([
        T.StructField(f"f{i}", T.StringType()) for i in range(COUNTRY_FILE_WIDTH)
    ])
    rows = spark.read.schema(wide).csv(
        path, sep="\t", comment="#", quote="", mode="PERMISSIVE", nullValue="",
        encoding="UTF-8",
    )
    named = rows.select(*[F.col(f"f{i}").alias(name) for name, i in COUNTRY_FIELDS.items()])
    return typed(
        named.withColumn("population", F.col("population").cast("long")), COUNTRY_SCHEMA
    )


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A reference table with a declared schema: codes such as ``13`` stay text."""
    return typed(
        spark.read.schema(schema).csv(
            path, header=True, nullValue="", escape='"', mode="FAILFAST"
        ),
        schema,
    )


def scan_populations(spark: SparkSession, path: str) -> DataFrame:
    return scan_csv(spark, path, POPULATION_SCHEMA).select("iso3", "population")


def scan_regions(spark: SparkSession, path: str) -> DataFrame:
    return scan_csv(spark, path, REGION_SCHEMA)


def scan_reference_csvs(
    spark: SparkSession, groups: str, occupations: str, lens: str, territories: str
) -> dict[str, DataFrame]:
    return {
        "occupation_groups": scan_csv(spark, groups, GROUP_SCHEMA),
        "occupations": scan_csv(spark, occupations, OCCUPATION_SCHEMA),
        "lens": scan_csv(spark, lens, LENS_SCHEMA),
        "territories": scan_csv(spark, territories, TERRITORY_SCHEMA),
    }


def dim_country(countries: DataFrame, populations: DataFrame) -> DataFrame:
    """Replace the list's own, stale population by the published one; unknown stays null."""
    return typed(
        countries.drop("population").join(populations.select("iso3", "population"), "iso3", "left"),
        COUNTRY_SCHEMA,
    )


def dim_province(regions: DataFrame) -> DataFrame:
    return regions.filter(F.col("level") == "province").select("geo_id", "name", "population")


def country_population(regions: DataFrame) -> DataFrame:
    """One row: the published total of the focus country. Any other number of rows is an error."""
    found = F.count(F.lit(1))
    message = F.concat(
        F.lit("expected one row of level 'country' in the regions, found "), found.cast("string")
    )
    return regions.filter(F.col("level") == "country").agg(
        F.when(found == 1, F.max("population").cast("long"))
        .otherwise(F.raise_error(message).cast("long")).alias("population")
    )
