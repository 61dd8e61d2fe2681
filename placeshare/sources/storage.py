"""Where intermediate tables live: the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local session without it gets a temporary folder."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _local_dirs:
        _local_dirs[application] = tempfile.mkdtemp(prefix="placeshare-")
    return _local_dirs[application]


_written: dict[str, list[str]] = {}


def new_path(spark: SparkSession, name: str) -> str:
    folder = f"{shared_dir(spark)}/placeshare-{uuid.uuid4().hex[:12]}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return f"{folder}/{name}"


def remove_intermediate(spark: SparkSession) -> int:
    """Delete the tables that this session has written between its steps; says how many there were.

    For the end of a run, when its results are published: frames that read these tables, among them
    those of a ``Run``, cannot be used any more.
    """
    folders = _written.pop(spark.sparkContext.applicationId, [])
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(settings).delete(path, True)
    return len(folders)


def written(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a table once and read it back.

    Cuts the lineage, survives the loss of executors, and gives later queries real file sizes to
    plan with, column pruning, and partition pruning on ``partition_by``. Rebalancing makes files
    of even size: a partition value that owns a third of the rows is split over several tasks.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    even = df.hint("rebalance", *partition_by) if partition_by else df.hint("rebalance")
    even.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def written_as_is(df: DataFrame, name: str) -> DataFrame:
    """As ``written``, but each task's rows stay one file, in their order."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
