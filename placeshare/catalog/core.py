"""Registration of named queries and the tables they share."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeshare.catalog.counterpart import counterpart
from placeshare.definition import Definition
from placeshare.inputs import Inputs
from placeshare.operators.staging import stage_facts
from placeshare.plans.jobs import materialized_from, written_all
from placeshare.plans.registry import build_metrics
from placeshare.plans.sqlmodels import sql_metrics
from placeshare.report.figures import geo_names
from placeshare.sources import orders

DIGITS = 8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The base tables of one data folder, written once per session, and what is built on them."""

    _known: dict[tuple[str, str], "Tables"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.d: Definition = orders.DEFINITION

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Tables":
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._known:
            cls._known[key] = cls(spark, sf_dir)
        return cls._known[key]

    @classmethod
    def forget(cls) -> None:
        cls._known.clear()

    @cached_property
    def inputs(self) -> Inputs:
        return materialized_from(self.spark, orders.order_builders(self.spark, self.sf_dir))

    @property
    def facts(self) -> DataFrame:
        return self.inputs.facts

    @property
    def staged(self) -> DataFrame:
        return stage_facts(self.facts, self.d)

    @cached_property
    def metrics(self) -> dict[str, DataFrame]:
        return build_metrics(self.inputs, self.d)

    @cached_property
    def second(self) -> dict[str, DataFrame]:
        return sql_metrics(self.inputs, self.d)

    @cached_property
    def results(self) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        """Both formulations' results as written tables, for everything that compares them."""
        tables = written_all(self.spark, {
            **{f"first_{name}": df for name, df in self.metrics.items()},
            **{f"second_{name}": df for name, df in self.second.items()},
        })
        return (
            {name: tables[f"first_{name}"] for name in self.metrics},
            {name: tables[f"second_{name}"] for name in self.metrics},
        )

    @property
    def names(self) -> DataFrame:
        return geo_names(self.inputs.countries, self.inputs.provinces)


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to a fixed number of digits (and no negative zero), dates as text."""
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            column = F.round(column, DIGITS) + F.lit(0.0)
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register ``build(tables) -> DataFrame`` and, if given, its SQL counterpart.

    ``doubles`` names the double columns of the result, which are rounded on both sides.
    """
    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: tidy(build(Tables.of(spark, sf_dir)))
        if sql is not None:
            SQL[name] = counterpart(sql, doubles.split(), DIGITS)
        return build

    return register
