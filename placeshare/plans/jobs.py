"""Writing many result tables side by side."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from placeshare.inputs import SCHEMAS, Inputs
from placeshare.sources.concurrent import concurrently
from placeshare.sources.storage import written


def written_all(
    spark: SparkSession, frames: Mapping[str, DataFrame | Callable[[], DataFrame]]
) -> dict[str, DataFrame]:
    """Write several result tables at once and read them back.

    A frame may be given as a function that builds it; building a plan also takes driver time,
    and is then done side by side too.
    """
    def write(name: str, frame: DataFrame | Callable[[], DataFrame]) -> DataFrame:
        return written(frame() if callable(frame) else frame, name)

    tables = concurrently(spark, [lambda n=n, f=f: write(n, f) for n, f in frames.items()])
    return dict(zip(frames, tables))


def materialized(inputs: Inputs) -> Inputs:
    """All base tables written once, typed, side by side; the facts split by source and facet.

    Everything after this reads small columnar tables of known size, not the records behind them.
    """
    return materialized_from(inputs.spark, {name: lambda n=name: getattr(inputs, n) for name in SCHEMAS})


def materialized_from(spark: SparkSession, builders: Mapping[str, Callable[[], DataFrame]]) -> Inputs:
    """As ``materialized``, from functions that build the tables.

    Building the facts counts the records, which is most of the work: the dimensions are then built
    and written beside it, not after it.
    """
    def write(name: str) -> DataFrame:
        split = ("source", "facet") if name == "facts" else ()
        return written(builders[name](), name, split)

    tables = concurrently(spark, [lambda n=name: write(n) for name in SCHEMAS])
    return Inputs(**dict(zip(SCHEMAS, tables)))
