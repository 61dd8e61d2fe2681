"""Artifacts: metric tables, evidence tables and the run summary, written and read back.

A run writes all its tables to a folder of its own, and as the last step one row that names it. Readers follow
the last row, so they have the tables of one run, and a run that stops half-way leaves those of the
run before as they are. The rows are a table that is only ever appended to, and the committer makes a
row visible as a whole or not at all. A full run then writes its tables by plain paths (``OUT/gold``, ``OUT/qa``)
too, for reading by hand: these are replaced one by one, so a program should follow the pointer.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from placeshare.sources.concurrent import concurrently

RUNS, POINTER = "runs", "published"
POINTER_SCHEMA = "number long, run string"
METRIC_DIR = "gold"
EVIDENCE_DIR = "qa"


def new_run(out: str) -> str:
    """A folder for a run's tables that no reader looks at yet."""
    return f"{out}/{RUNS}/{uuid.uuid4().hex[:12]}"


def publish(spark: SparkSession, out: str, folder: str) -> None:
    """From here on readers of ``out`` get the tables of this run."""
    last = _pointers(spark, out)
    number = 0 if last is None else last["number"]
    row = spark.createDataFrame([(number + 1, folder.rpartition("/")[2])], POINTER_SCHEMA)
    row.coalesce(1).write.mode("append").json(f"{out}/{POINTER}")


def published(spark: SparkSession, out: str) -> str | None:
    """The folder of the run that was published last, if any."""
    last = _pointers(spark, out)
    return None if last is None else f"{out}/{RUNS}/{last['run']}"


def _pointers(spark: SparkSession, out: str):
    """The last row of the pointer table; of two with one number, the same for all readers."""
    rows = read_table(spark, f"{out}/{POINTER}", T.StructType.fromDDL(POINTER_SCHEMA), "json")
    return None if rows is None else rows.orderBy(F.desc("number"), F.desc("run")).first()


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """A folder of part files; parquet by default, CSV for reading elsewhere."""
    writer = df.write.mode("overwrite")
    if form == "csv":
        writer.csv(path, header=True, nullValue="", emptyValue='""', escape='"')
    else:
        writer.format(form).save(path)


def _write_tables(tables: Mapping[str, DataFrame], folder: str, form: str) -> None:
    if tables:
        spark = next(iter(tables.values())).sparkSession
        concurrently(spark, [
            lambda n=name, df=df: write_table(df, f"{folder}/{n}", form)
            for name, df in tables.items()
        ])


def write_gold(metrics: Mapping[str, DataFrame], out: str, form: str = "parquet") -> None:
    _write_tables(metrics, f"{out}/{METRIC_DIR}", form)


def write_qa(tables: Mapping[str, DataFrame], out: str, form: str = "parquet") -> None:
    _write_tables(tables, f"{out}/{EVIDENCE_DIR}", form)


def write_summary(summary: DataFrame, out: str) -> None:
    """The one-row run summary as JSON."""
    summary.coalesce(1).write.mode("overwrite").json(f"{out}/{EVIDENCE_DIR}/summary")


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, form: str = "parquet"
) -> DataFrame | None:
    """A written table, or ``None`` where it was not written (optional artifacts)."""
    reader = spark.read.schema(schema)
    try:
        if form == "csv":
            return reader.csv(path, header=True, nullValue="", escape='"')
        return reader.format(form).load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def read_gold(
    spark: SparkSession, out: str, schemas: Mapping[str, T.StructType], form: str = "parquet"
) -> dict[str, DataFrame | None]:
    return {
        name: read_table(spark, f"{out}/{METRIC_DIR}/{name}", schema, form)
        for name, schema in schemas.items()
    }
