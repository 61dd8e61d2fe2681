"""Times the headline queries and a full checked run on one machine; prints one JSON line.

Each query is timed to a complete result. ``facts`` is the only one that reads the raw records
(600,000 at sf0.1); the metrics read the fact table it writes, as they do in production, and
``cold_shares`` shows records to metric in one go. ``full_run`` is everything: records, both
formulations, all checks, all 26 defects on two corpora, the figures and the written artifacts.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from placeshare.catalog import QUERIES
from placeshare.catalog.core import Tables
from placeshare.plans.pipeline import run_pipeline
from placeshare.session import local_session
from placeshare.sources import orders
from placeshare.sources.manifest import source_manifest

METRICS = (
    "stg_facts", "m_geo_usage", "m_shares", "m_vs_rest", "m_request_mix", "m_platform_gap",
    "m_function_exposure", "run_checks", "reconcile_summary", "check_invariants",
    "rollup_report", "brief_facts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    seconds: dict[str, float] = {}

    def timed(name, action):
        started = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - started, 3)

    def finish(df):
        df.write.format("noop").mode("overwrite").save()

    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start the executor threads
    timed("facts", lambda: Tables.of(spark, sf_dir).inputs)
    for name in METRICS:
        timed(name, lambda: finish(QUERIES[name](spark, sf_dir)))

    def cold():
        Tables.forget()
        finish(QUERIES["m_shares"](spark, sf_dir))

    timed("cold_shares", cold)

    def everything():
        manifest = source_manifest(spark, {"lineitem": f"{sf_dir}/lineitem.parquet"}, {})
        run = run_pipeline(
            orders.order_inputs(spark, sf_dir), orders.DEFINITION, manifest,
            tempfile.mkdtemp(prefix="placeshare-bench-"),
        )
        run.summary.collect()

    timed("full_run", everything)
    print(json.dumps({
        "metric": "placeshare headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
