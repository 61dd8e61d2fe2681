"""The release decision: every part of the evidence must be complete and clean."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _part(name: str, df: DataFrame, total: Column, passed: Column) -> DataFrame:
    return df.agg(
        F.coalesce(total, F.lit(0)).cast("long").alias("total"),
        F.coalesce(passed, F.lit(0)).cast("long").alias("passed"),
    ).select(F.lit(name).alias("part"), "total", "passed")


def _ones(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def gate_parts(
    manifest: DataFrame,
    reconciliation: DataFrame,
    invariants: DataFrame,
    checks: DataFrame,
    verification: DataFrame,
    defects: DataFrame | None = None,
) -> DataFrame:
    """(part, total, passed): what was looked at and how much of it is clean."""
    rows = F.count(F.lit(1))
    cells, bad = F.sum("cells_compared"), F.sum("mismatches")
    parts = [
        _part("checksums", manifest, rows, _ones(F.col("matches_published_sha256"))),
        # extra rows may outnumber the cells, so any mismatch fails the part
        _part("reconciliation", reconciliation, cells, F.when(bad == 0, cells)),
        _part("invariants", invariants, rows, _ones(F.col("passed"))),
        _part("checks", checks, rows, _ones(F.col("passed"))),
        _part("figures", verification, rows, _ones(F.col("match"))),
    ]
    if defects is not None:
        parts.append(_part("defects", defects, rows, _ones(F.col("killed"))))
    return reduce(DataFrame.unionByName, parts)


def run_gate(parts: DataFrame) -> DataFrame:
    """One row: totals and passes of every part, and the verdict."""
    def pick(part: str, column: str) -> Column:
        return F.max(F.when(F.col("part") == part, F.col(column)))

    return parts.agg(
        (pick("checksums", "total") == pick("checksums", "passed"))
        .alias("sources_match_published_checksums"),
        pick("reconciliation", "total").alias("cells_compared"),
        (pick("reconciliation", "total") == pick("reconciliation", "passed"))
        .alias("reconciled"),
        pick("invariants", "total").alias("invariants"),
        pick("invariants", "passed").alias("invariants_passed"),
        pick("checks", "total").alias("checks"),
        pick("checks", "passed").alias("checks_passed"),
        pick("defects", "total").alias("defects"),
        pick("defects", "passed").alias("defects_killed"),
        pick("figures", "total").alias("figures"),
        (pick("figures", "total") == pick("figures", "passed")).alias("figures_verified"),
        F.bool_and(F.col("total") == F.col("passed")).alias("all_gates_passed"),
    )
