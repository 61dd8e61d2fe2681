"""The rollup kept up to date batch by batch: counters that add up, and a ledger of batches."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeshare.operators.rollup import CELL_KEYS, RollupSpec, cells_of, facts_of
from placeshare.sources.sinks import read_table
from placeshare.sources.storage import written

LEDGER = "number long, batch string, run string, buckets array<int>"


class CellStore:
    """Cells (source, place, facet, label -> n) of all batches so far, under one folder.

    Cells of any level only ever add up, so a batch is folded to its own cells and these are added to
    what is there. Cells are kept in buckets by source, place and facet; a batch rewrites the
    buckets that it touches and no others. Its files lie in a folder of their own and count from the moment the
    ledger, a table that is only appended to, gets its row: which batch, which folder, which
    buckets. The last row that names a bucket says where it is. So a batch that is replayed has no
    effect, one that stopped half-way has not happened, and readers always see whole batches. One writer
    at a time; the driver holds the ledger, one small row per batch.
    """

    def __init__(self, spark: SparkSession, folder: str, spec: RollupSpec, buckets: int = 64):
        self.spark, self.folder, self.spec, self.buckets = spark, folder.rstrip("/"), spec, buckets

    def _ledger(self) -> list:
        rows = read_table(self.spark, f"{self.folder}/ledger", T.StructType.fromDDL(LEDGER), "json")
        return [] if rows is None else rows.orderBy("number").collect()

    def batches(self) -> list[str]:
        return [row["batch"] for row in self._ledger()]

    def add(self, batch: str, records: DataFrame) -> bool:
        """Add a batch's records; false, and nothing done, if it is in already."""
        ledger = self._ledger()
        if batch in [row["batch"] for row in ledger]:
            return False
        bucket = F.pmod(F.xxhash64("source", "geo_id", "facet"), F.lit(self.buckets)).cast("int")
        delta = written(cells_of(records, self.spec).withColumn("bucket", bucket), "delta")
        touched = sorted(row["bucket"] for row in delta.select("bucket").distinct().collect())
        run = uuid.uuid4().hex[:12]
        if touched:
            before = self._cells(ledger, touched)
            both = delta if before is None else delta.unionByName(before)
            merged = both.groupBy(*CELL_KEYS, "bucket").agg(F.sum("n").alias("n"))
            merged.write.partitionBy("bucket").parquet(f"{self.folder}/cells/{run}")
        row = [(len(ledger) + 1, batch, run, touched)]
        self.spark.createDataFrame(row, LEDGER).coalesce(1).write.mode("append").json(
            f"{self.folder}/ledger"
        )
        return True

    def _cells(self, ledger: list, buckets: list[int] | None = None) -> DataFrame | None:
        """The current cells of some buckets (all by default)."""
        last = {b: row["run"] for row in ledger for b in row["buckets"] or []}
        places: dict[str, list[str]] = {}
        for b, run in sorted(last.items()):
            if buckets is None or b in buckets:
                base = f"{self.folder}/cells/{run}"
                places.setdefault(base, []).append(f"{base}/bucket={b}")
        schema = ", ".join([*(f"{c} string" for c in CELL_KEYS), "n double", "bucket int"])
        parts = [
            self.spark.read.schema(schema).option("basePath", base).parquet(*paths)
            for base, paths in places.items()
        ]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def facts(self) -> DataFrame | None:
        """The long fact table of all batches so far; none before the first."""
        cells = self._cells(self._ledger())
        return None if cells is None else facts_of(cells.select(*CELL_KEYS, "n"), self.spec)
