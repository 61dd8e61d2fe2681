"""A checked run from files: ``python -m placeshare --facts chat=PATH --facts api=PATH ...``.

Exit status 0 if every part of the evidence is clean, 1 if not.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import SparkSession

from placeshare.definition import Definition
from placeshare.plans.pipeline import gate_passed, run_from_files
from placeshare.quality.defects import DEFECTS
from placeshare.sources.loading import ReferenceFiles
from placeshare.sources.storage import remove_intermediate


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="placeshare", description=__doc__)
    parser.add_argument("--facts", action="append", required=True, metavar="SOURCE=PATH")
    parser.add_argument("--reference", required=True, help="folder of the reference files")
    parser.add_argument("--published", help="JSON file: source or table name to SHA-256")
    parser.add_argument("--out", required=True, help="folder for the artifacts")
    parser.add_argument("--chat-source", default="chat")
    parser.add_argument("--api-source", default="api")
    parser.add_argument("--focus-country", default="CA")
    parser.add_argument("--skip-defects", action="store_true")
    return parser.parse_args(argv)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    given = arguments(argv)
    published = {}
    if given.published:
        with open(given.published, encoding="utf-8") as listed:
            published = json.load(listed)
    own_session = spark is None
    spark = spark or SparkSession.builder.appName("placeshare").getOrCreate()
    run = run_from_files(
        spark,
        dict(pair.split("=", 1) for pair in given.facts),
        ReferenceFiles.in_folder(given.reference),
        published,
        Definition(
            chat_source=given.chat_source, api_source=given.api_source,
            focus_country=given.focus_country,
        ),
        given.out,
        None if given.skip_defects else DEFECTS,
    )
    passed = gate_passed(run)
    if own_session:  # the artifacts are published; nothing reads the steps between any more
        remove_intermediate(spark)
    return 0 if passed else 1


if __name__ == "__main__":
    raise SystemExit(main())
