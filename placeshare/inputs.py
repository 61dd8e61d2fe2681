"""The tables a run works on."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACT_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("geo_id", T.StringType()),
    T.StructField("geography", T.StringType()),
    T.StructField("date_start", T.DateType()),
    T.StructField("date_end", T.DateType()),
    T.StructField("platform_and_product", T.StringType()),
    T.StructField("facet", T.StringType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("variable", T.StringType()),
    T.StructField("cluster_name", T.StringType()),
    T.StructField("value", T.DoubleType()),
])
COUNTRY_SCHEMA = T.StructType([
    T.StructField("iso2", T.StringType()),
    T.StructField("iso3", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("population", T.LongType()),
    T.StructField("continent", T.StringType()),
])
PROVINCE_SCHEMA = T.StructType([
    T.StructField("geo_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("population", T.LongType()),
])
FOCUS_POPULATION_SCHEMA = T.StructType([T.StructField("population", T.LongType())])
GROUP_SCHEMA = T.StructType([
    T.StructField("soc_group", T.StringType()),
    T.StructField("name", T.StringType()),
])
OCCUPATION_SCHEMA = T.StructType([
    T.StructField("occ_code", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("observed_exposure", T.DoubleType()),
])
LENS_SCHEMA = T.StructType([T.StructField("cluster", T.StringType())])
TERRITORY_SCHEMA = T.StructType([
    T.StructField("parent", T.StringType()),
    T.StructField("subregion", T.StringType()),
    T.StructField("territory", T.StringType()),
])

SCHEMAS = {
    "facts": FACT_SCHEMA,
    "countries": COUNTRY_SCHEMA,
    "provinces": PROVINCE_SCHEMA,
    "focus_population": FOCUS_POPULATION_SCHEMA,
    "occupation_groups": GROUP_SCHEMA,
    "occupations": OCCUPATION_SCHEMA,
    "lens": LENS_SCHEMA,
    "territories": TERRITORY_SCHEMA,
}

# table name in SQL -> field of Inputs
SQL_TABLES = {
    "facts": "facts",
    "dim_country": "countries",
    "dim_province": "provinces",
    "dim_occupation_group": "occupation_groups",
    "occupations": "occupations",
    "lens": "lens",
    "dim_territory": "territories",
}


@dataclass(frozen=True)
class Inputs:
    """Seven tables and a one-row lookup, all lazy."""

    facts: DataFrame
    countries: DataFrame
    provinces: DataFrame
    focus_population: DataFrame
    occupation_groups: DataFrame
    occupations: DataFrame
    lens: DataFrame
    territories: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.facts.sparkSession

    def replace(self, **tables: DataFrame) -> "Inputs":
        return dataclasses.replace(self, **tables)


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to the table's schema; a missing number arrives as null, never as NaN."""
    columns = []
    for field in schema:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            column = column.cast("double")
            column = F.when(~F.isnan(column), column)
        elif isinstance(field.dataType, (T.IntegerType, T.LongType)):
            # half-to-even, as the double-to-integer casts this table layout comes from
            if not isinstance(df.schema[field.name].dataType, T.IntegralType):
                column = F.bround(column.cast("double"))
            column = column.cast(field.dataType)
        else:
            column = column.cast(field.dataType)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def typed_inputs(**tables: DataFrame) -> Inputs:
    return Inputs(**{name: typed(tables[name], schema) for name, schema in SCHEMAS.items()})


def register_frames(inputs: Inputs, prefix: str = "") -> list[str]:
    """Expose every table to SQL; returns the view names."""
    names = []
    for table, attribute in SQL_TABLES.items():
        getattr(inputs, attribute).createOrReplaceTempView(prefix + table)
        names.append(prefix + table)
    return names


def sql_query(inputs: Inputs, text: str) -> DataFrame:
    """Ad-hoc SQL over the tables, named as ``{facts}``, ``{dim_country}`` and so on."""
    frames = {t: getattr(inputs, a) for t, a in SQL_TABLES.items() if "{" + t + "}" in text}
    return inputs.spark.sql(text, **frames)
