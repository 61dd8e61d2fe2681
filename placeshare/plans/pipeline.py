"""Everything in one run: metrics, second formulation, evidence, artifacts and the gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeshare.definition import Definition
from placeshare.inputs import Inputs
from placeshare.plans.gate import gate_parts, run_gate
from placeshare.plans.jobs import materialized, written_all
from placeshare.plans.registry import METRICS, build_metrics
from placeshare.plans.sqlmodels import sql_metrics
from placeshare.quality import golden
from placeshare.quality.checks import run_checks
from placeshare.quality.defects import DEFECTS, Corpus, Defect, defect_suite
from placeshare.quality.investigate import rollup_report
from placeshare.quality.invariants import check_invariants
from placeshare.quality.reconcile import reconcile_metric, reconcile_summary
from placeshare.report.figures import brief_facts, figure_verification, geo_names
from placeshare.sources.concurrent import concurrently
from placeshare.sources.facts import source_row_counts
from placeshare.sources.loading import ReferenceFiles, load_inputs
from placeshare.sources.manifest import source_manifest
from placeshare.sources.sinks import new_run, publish, write_gold, write_qa, write_summary


@dataclass(frozen=True)
class Run:
    """The written results, as frames to query further."""

    metrics: Mapping[str, DataFrame]
    evidence: Mapping[str, DataFrame]
    summary: DataFrame


def golden_corpus(spark: SparkSession) -> Corpus:
    """The hand-made tables with their answers, written like any other base tables."""
    inputs = materialized(golden.golden_inputs(spark))
    answers = {f"expected_{n}": df for n, df in golden.golden_expected(spark).items()}
    models = {
        f"second_{n}": df for n, df in sql_metrics(inputs, golden.DEFINITION).items()
    }
    tables = written_all(spark, answers | models)
    return Corpus(
        "golden data", inputs, golden.DEFINITION,
        {name: tables[f"second_{name}"] for name in METRICS},
        {name: tables[f"expected_{name}"] for name in METRICS},
    )


def run_pipeline(
    inputs: Inputs,
    d: Definition,
    manifest: DataFrame,
    out: str | None = None,
    defects: Sequence[Defect] | None = DEFECTS,
    form: str = "parquet",
) -> Run:
    """Build and check everything; publish the artifacts under ``out`` if given.

    ``defects=None`` skips the planted defects. Results move between the steps as written
    tables; only defect findings reach the driver.
    """
    spark = inputs.spark
    steps = [lambda: materialized(inputs)]
    if defects is not None:
        steps.append(lambda: golden_corpus(spark))
    base, *known = concurrently(spark, steps)
    both = written_all(spark, {
        **{f"first_{name}": df for name, df in build_metrics(base, d).items()},
        **{f"second_{name}": df for name, df in sql_metrics(base, d).items()},
    })
    first = {name: both[f"first_{name}"] for name in METRICS}
    second = {name: both[f"second_{name}"] for name in METRICS}

    names = geo_names(base.countries, base.provinces)

    def figures() -> DataFrame:
        return figure_verification(
            brief_facts(first, names, d), brief_facts(second, names, d)
        )

    def planted() -> dict[str, DataFrame]:
        corpora = [Corpus("real data", base, d, second), *known]
        return {"defects": defect_suite(spark, corpora, defects, {"real data": first})}

    evidence_of = {
        **{
            f"issues_{name}": lambda n=name: reconcile_metric(n, first[n], second[n])
            for name in METRICS
        },
        "checks": lambda: run_checks(base, d),
        "invariants": lambda: check_invariants(first, base, d),
        "figures": figures,
        "rollup_gaps": lambda: rollup_report(base.facts, base.territories, d),
        "source_rows": lambda: source_row_counts(base.facts),
        "manifest": manifest,
    }
    calls = [lambda: written_all(spark, evidence_of)]
    if defects is not None:
        calls.append(planted)
    evidence: dict[str, DataFrame] = {}
    for part in concurrently(spark, calls):
        evidence |= part
    evidence["issues"] = reduce(
        DataFrame.unionByName, [evidence.pop(f"issues_{name}") for name in METRICS]
    )
    evidence["reconciliation"] = reconcile_summary(first, second, evidence["issues"])

    summary = run_gate(gate_parts(
        evidence["manifest"], evidence["reconciliation"], evidence["invariants"],
        evidence["checks"], evidence["figures"], evidence.get("defects"),
    ))
    if out is not None:
        def write(folder: str) -> None:
            concurrently(spark, [
                lambda: write_gold({**first, "geo_names": names}, folder, form),
                lambda: write_qa(evidence, folder, form),
                lambda: write_summary(summary, folder),
            ])

        folder = new_run(out)
        write(folder)
        publish(spark, out, folder)
        write(out)  # by plain paths, for those who open the folder by hand
    return Run(first, evidence, summary)


def run_from_files(
    spark: SparkSession,
    files: Mapping[str, str],
    reference: ReferenceFiles,
    published: Mapping[str, str],
    d: Definition,
    out: str | None = None,
    defects: Sequence[Defect] | None = DEFECTS,
) -> Run:
    """As ``run_pipeline``, from files: those that are read are those that are digested.

    Refuses to run if one is missing. ``published`` has digests by source and reference table.
    """
    inputs = load_inputs(spark, files, reference)
    manifest = source_manifest(spark, {**files, **reference.paths()}, published)
    return run_pipeline(inputs, d, manifest, out, defects)


def gate_passed(run: Run) -> bool:
    """The verdict, for an exit status."""
    return bool(run.summary.select(F.col("all_gates_passed")).first()[0])
