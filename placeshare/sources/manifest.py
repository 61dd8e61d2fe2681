"""Size and digest of every source file, against the published digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READ_BYTES = 4 << 20
DIGESTED = "path string, bytes long, sha256 string"


def _digest(path: str) -> str:
    """SHA-256 of a file's bytes as they are stored, in reads of a fixed size."""
    if path.startswith("file:"):
        system, place = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        system, place = fs.FileSystem.from_uri(path)
    digest = hashlib.sha256()
    with system.open_input_stream(place, compression=None) as stream:
        while block := stream.read(READ_BYTES):
            digest.update(block)
    return digest.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = pa.array([_digest(p) for p in batch["path"].to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch["path"], batch["bytes"], digests], names=["path", "bytes", "sha256"]
        )


def source_manifest(
    spark: SparkSession, files: Mapping[str, str], published: Mapping[str, str]
) -> DataFrame:
    """(source, file, bytes, sha256, matches_published_sha256), one row per file.

    Spark lists the files; each is hashed by one task on an executor, which holds one read of it
    at a time, so there is no limit on its size. The store must be one that pyarrow opens by the
    same address (local and mounted folders, HDFS, S3, GCS, Azure). Spark does not list files
    without bytes: a source that has no others gets one row, without a digest or a match.
    """
    rows = []
    for source, path in files.items():
        listed = spark.read.format("binaryFile").load(path).select(
            "path", F.col("length").alias("bytes")
        )
        rows.append(
            listed.mapInArrow(_digests, DIGESTED).select(
                F.lit(source).alias("source"),
                F.element_at(F.split("path", "/"), -1).alias("file"),
                "bytes",
                "sha256",
                F.coalesce(
                    F.col("sha256") == F.lit(published.get(source)), F.lit(False)
                ).alias("matches_published_sha256"),
            )
        )
    result = rows[0]
    for more in rows[1:]:
        result = result.unionByName(more)
    named = spark.createDataFrame(
        [(source, path.rstrip("/").rsplit("/", 1)[-1]) for source, path in files.items()],
        "source string, given string",
    )
    return named.join(result, "source", "left").select(
        "source", F.coalesce("file", "given").alias("file"),
        F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"), "sha256",
        F.coalesce("matches_published_sha256", F.lit(False)).alias("matches_published_sha256"),
    )
