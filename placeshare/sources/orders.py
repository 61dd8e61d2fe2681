"""Reads the order tables as sampled records and dimensions.

One order line stands for one sampled conversation. The rules that turn keys and flags into
sources, places and labels are plain projections; the long table is then ``rollup_facts``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeshare.definition import Definition
from placeshare.functions.places import padded
from placeshare.inputs import SCHEMAS, Inputs, typed
from placeshare.operators.numbering import number_within
from placeshare.operators.rollup import RollupSpec, rollup_facts

FOCUS = "N03"
UNKNOWN_NATION = 24
TERRITORY_NATION = 23
TERRITORY_PARENT = "N05"
NO_POPULATION_NATION = 7
FOCUS_NATION = 3

# Label of each line number, 1 to 7.
COLLABORATION_LABELS = (
    "directive", "feedback loop", "learning", "task iteration", "validation", "none",
    "not_classified",
)
# Categories of interest.
LENS = ("Brand#1", "Brand#2", "Brand#3", "Brand#4")

SPEC = RollupSpec(
    facets={"use_case": 0, "collaboration": 0, "task_success": 0, "request": 2},
    place_sources=("chat",),
    platforms={"chat": "Chat", "api": "API"},
    date_start="2026-02-05",
    date_end="2026-02-12",
)

DEFINITION = Definition(focus_country=FOCUS)


def _nation_code(key: Column) -> Column:
    return F.concat(F.lit("N"), padded(key.cast("string"), 2))


def _country(key: Column) -> Column:
    return F.when(key == UNKNOWN_NATION, F.lit("not_classified")).otherwise(_nation_code(key))


def _subregion(key: Column, segment: Column) -> Column:
    return (
        F.when(key == UNKNOWN_NATION, F.lit(None).cast("string"))
        .when(key == TERRITORY_NATION, F.lit(f"{TERRITORY_PARENT}-N{TERRITORY_NATION}"))
        .when(
            (key == FOCUS_NATION) & (segment == "HOUSEHOLD"), F.lit(f"{FOCUS}-not_classified")
        )
        .otherwise(F.concat(_nation_code(key), F.lit("-"), segment))
    )


def _use_case(priority: Column) -> Column:
    urgency = F.substring(priority, 1, 1)
    return (
        F.when(urgency.isin("1", "2"), "work")
        .when(urgency == "3", "personal")
        .when(urgency == "5", "coursework")
        .otherwise("none")
    )


def _task_success(flag: Column) -> Column:
    return F.when(flag == "A", "yes").when(flag == "N", "no").otherwise("not_classified")


class OrderTables:
    """The tables of one folder, each opened once (opening reads a file footer)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._folder = spark, sf_dir
        self._opened: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
        return self._opened[name]

    def only(self, name: str, condition: Column) -> "OrderTables":
        """The same tables with some rows of one of them."""
        out = OrderTables(self._spark, self._folder)
        out._opened = {**self._opened, name: self[name].filter(condition)}
        return out


def records(tables: OrderTables) -> DataFrame:
    """source, country, subregion and one label per facet, for every order line.

    Three equi-joins on well-spread keys, with only the needed columns; which sides are
    broadcast is left to the size threshold. Keys and flags travel through the joins in their
    short form and become labels afterwards.
    """
    orders = tables["orders"].select(
        "o_orderkey", "o_custkey", "o_orderpriority"
    )
    customers = tables["customer"].select(
        "c_custkey", "c_nationkey", "c_mktsegment"
    )
    parts = tables["part"].select("p_partkey", "p_brand")
    lines = tables["lineitem"].select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"
    )
    placed = orders.join(customers, F.col("c_custkey") == F.col("o_custkey")).select(
        "o_orderkey", "o_orderpriority", "c_nationkey", "c_mktsegment"
    )
    labels = F.array(*[F.lit(label) for label in COLLABORATION_LABELS])
    nation, brand = F.col("c_nationkey"), F.col("p_brand")
    return (
        lines.join(parts, F.col("p_partkey") == F.col("l_partkey"))
        .join(placed, F.col("o_orderkey") == F.col("l_orderkey"))
        .select(
            F.when(F.col("l_suppkey") % 4 == 0, "api").otherwise("chat").alias("source"),
            _country(nation).alias("country"),
            _subregion(nation, F.col("c_mktsegment")).alias("subregion"),
            _use_case(F.col("o_orderpriority")).alias("use_case"),
            F.element_at(labels, F.col("l_linenumber")).alias("collaboration"),
            _task_success(F.col("l_returnflag")).alias("task_success"),
            F.when(brand == "Brand#25", "not_classified").otherwise(brand).alias("request"),
        )
    )


def countries(tables: OrderTables) -> DataFrame:
    people = tables["customer"].groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("customers")
    )
    key = F.col("n_nationkey")
    population = F.when(key != NO_POPULATION_NATION, F.col("customers") * 1000)
    return (
        tables["nation"]
        .filter(key != UNKNOWN_NATION)
        .join(people, F.col("c_nationkey") == key, "left")
        .select(
            _nation_code(key).alias("iso2"),
            F.concat(F.lit("X"), _nation_code(key)).alias("iso3"),
            F.col("n_name").alias("country"),
            population.alias("population"),
            F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("continent"),
        )
    )


def provinces(tables: OrderTables) -> DataFrame:
    region = _subregion(F.col("c_nationkey"), F.col("c_mktsegment"))
    return (
        tables["customer"]
        .filter(
            (F.col("c_nationkey") == FOCUS_NATION) & (F.col("c_mktsegment") != "HOUSEHOLD")
        )
        .groupBy(region.alias("geo_id"), F.col("c_mktsegment").alias("name"))
        .agg((F.count(F.lit(1)) * 1000).alias("population"))
    )


def focus_population(tables: OrderTables) -> DataFrame:
    return (
        tables["customer"]
        .filter(
            (F.col("c_nationkey") == FOCUS_NATION) & (F.col("c_mktsegment") != "HOUSEHOLD")
        )
        .agg((F.count(F.lit(1)) * 1000).alias("population"))
    )


def _brand_group() -> Column:
    return padded(F.regexp_replace("p_brand", "^Brand#", ""), 2)


def occupations(tables: OrderTables) -> DataFrame:
    parts = tables["part"].select(
        "p_partkey", "p_name", "p_size", _brand_group().alias("soc_group")
    )
    return number_within(parts, "soc_group", "p_partkey", "position").select(
        F.concat(
            "soc_group", F.lit("-"), padded(F.col("position").cast("string"), 4)
        ).alias("occ_code"),
        F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("title"),
        (F.greatest(F.col("p_size") - 20, F.lit(0)) / F.lit(30.0)).alias("observed_exposure"),
    )


def occupation_groups(tables: OrderTables) -> DataFrame:
    return tables["part"].select(
        _brand_group().alias("soc_group"), F.col("p_brand").alias("name")
    ).distinct()


def lens(tables: OrderTables) -> DataFrame:
    """The categories of interest that the part table really has."""
    return (
        tables["part"]
        .filter(F.col("p_brand").isin(*LENS))
        .select(F.col("p_brand").alias("cluster"))
        .distinct()
    )


def territories(tables: OrderTables) -> DataFrame:
    """The nation that is listed both as a country and inside another one."""
    code = _nation_code(F.col("n_nationkey"))
    return tables["nation"].filter(
        F.col("n_nationkey") == TERRITORY_NATION
    ).select(
        F.lit(TERRITORY_PARENT).alias("parent"),
        F.concat(F.lit(f"{TERRITORY_PARENT}-"), code).alias("subregion"),
        code.alias("territory"),
    )


def order_builders(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    """One function for each input table, typed. Building the facts counts the records."""
    tables = OrderTables(spark, sf_dir)
    build = {
        "facts": lambda: rollup_facts(records(tables), SPEC),
        "countries": lambda: countries(tables),
        "provinces": lambda: provinces(tables),
        "focus_population": lambda: focus_population(tables),
        "occupation_groups": lambda: occupation_groups(tables),
        "occupations": lambda: occupations(tables),
        "lens": lambda: lens(tables),
        "territories": lambda: territories(tables),
    }
    return {name: lambda n=name: typed(build[n](), SCHEMAS[n]) for name in SCHEMAS}


def order_inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    return Inputs(**{name: build() for name, build in order_builders(spark, sf_dir).items()})
