"""Submitting independent Spark jobs side by side.

After the rollup, most jobs are many and small: their time goes into planning, not data. Sent from
a few driver threads, they plan and run together and share the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

Result = TypeVar("Result")
THREADS = 8


def concurrently(
    spark: SparkSession, calls: Sequence[Callable[[], Result]], threads: int = THREADS
) -> list[Result]:
    """Results in the order of the calls; the first failure is raised."""
    if len(calls) < 2:
        return [call() for call in calls]
    with ThreadPoolExecutor(min(threads, len(calls))) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(call)) for call in calls]
        return [future.result() for future in futures]
