"""Fact files: the header contract, the scan, and the union of the configured sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeshare.definition import FACT_COLUMNS
from placeshare.inputs import FACT_SCHEMA, typed
from placeshare.sources.concurrent import concurrently
from placeshare.sources.storage import written

FILE_SCHEMA = T.StructType([FACT_SCHEMA[name] for name in FACT_COLUMNS])


class SchemaError(ValueError):
    """A fact file's columns are not the agreed ones, in the agreed order."""


class MissingSourcesError(FileNotFoundError):
    """Configured fact files that do not exist."""


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _data_files(spark: SparkSession, path: str) -> list:
    """(file system, path) of the non-empty data files a path, folder or pattern stands for.

    Folders are followed to any depth, with the scan's own rule for names that do not count.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    files = pattern.getFileSystem(conf)
    found, folders = [], []

    def take(items):
        for item in items:
            if item.isDirectory():
                folders.append(item.getPath())
            elif item.getLen() > 0 and not _hidden(item.getPath().getName()):
                found.append((files, item.getPath()))

    take(files.globStatus(pattern) or [])
    while folders:
        take(i for i in files.listStatus(folders.pop()) if not _hidden(i.getPath().getName()))
    return found


def _first_line(spark: SparkSession, files, path) -> str:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    stream = files.open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        text = codec.createInputStream(stream) if codec is not None else stream
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(text, "UTF-8"))
        return reader.readLine() or ""
    finally:
        stream.close()


def header_violations(
    spark: SparkSession, paths: str | Sequence[str]
) -> list[tuple[str, list[str]]]:
    """Files whose columns are not the agreed ones, with the columns found.

    Opens every file and reads one buffer of it, so the cost is per file and not per byte: no
    job scans the data for this.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    opened = [f for path in listed for f in _data_files(spark, path)]
    lines = concurrently(
        spark, [lambda f=files, p=path: _first_line(spark, f, p) for files, path in opened], 16
    )
    bad = []
    for (_, path), line in zip(opened, lines):
        columns = [c.strip('"') for c in line.lstrip("\ufeff").rstrip("\r").split(",")]
        if columns != list(FACT_COLUMNS):
            bad.append((path.toString(), columns))
    return bad


def check_header(spark: SparkSession, paths: str | Sequence[str]) -> None:
    bad = header_violations(spark, paths)
    if bad:
        shown = "; ".join(f"{file}: {columns}" for file, columns in bad)
        raise SchemaError(f"expected columns {list(FACT_COLUMNS)}, found {shown}")


def tag_source(df: DataFrame, source: str) -> DataFrame:
    return df.select(F.lit(source).alias("source"), *[F.col(c) for c in df.columns])


def scan_facts_csv(spark: SparkSession, paths: str | Sequence[str], source: str) -> DataFrame:
    """Typed scan of one source's files. Empty text is null; the text ``NA`` is a place.

    Malformed numbers or dates fail the run instead of turning into nulls.
    """
    check_header(spark, paths)
    files = spark.read.schema(FILE_SCHEMA).csv(
        paths, header=True, nullValue="", emptyValue="", mode="FAILFAST", multiLine=False,
        dateFormat="yyyy-MM-dd", enforceSchema=True, escape='"',
    )
    return typed(tag_source(files, source), FACT_SCHEMA)


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def missing_sources(spark: SparkSession, files: Mapping[str, str]) -> list[str]:
    """Sources whose path matches nothing. A listing on the driver; no data is read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    absent = []
    for source, path in files.items():
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        found = hadoop_path.getFileSystem(conf).globStatus(hadoop_path)
        if found is None or len(found) == 0:
            absent.append(source)
    return absent


def absent_sources(
    spark: SparkSession, configured: DataFrame, folder: str, key: str = "source"
) -> DataFrame:
    """Configured names without a file in ``folder/<name>/``, for long lists of sources.

    Lists paths and sizes only; the file contents are pruned.
    """
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(
        folder
    ).select(F.element_at(F.split("path", "/"), -2).alias(key)).distinct()
    return configured.join(names, key, "left_anti")


def require_sources(spark: SparkSession, files: Mapping[str, str]) -> None:
    absent = missing_sources(spark, files)
    if absent:
        raise MissingSourcesError(
            "missing source files: " + ", ".join(files[source] for source in absent)
        )


def load_facts(spark: SparkSession, files: Mapping[str, str]) -> DataFrame:
    require_sources(spark, files)
    return union_sources([scan_facts_csv(spark, path, key) for key, path in files.items()])


def facts_table(facts: DataFrame) -> DataFrame:
    """The fact table as the metrics read it: columnar, pruned by source and facet."""
    return written(facts, "facts", ("source", "facet"))


def source_row_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
