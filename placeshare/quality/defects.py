"""Twenty-six planted defects, each one changed definition, that the checks must notice.

All defects are evaluated together: each metric is built once with all definitions as parameters, so
a corpus costs six tables, four comparisons and one pass of invariants, whatever the number of defects.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeshare.definition import Definition
from placeshare.inputs import Inputs
from placeshare.plans.jobs import written_all
from placeshare.plans.registry import METRICS, affected_metrics, build_metrics
from placeshare.plans.sqlmodels import sql_metrics
from placeshare.plans.versions import Versions
from placeshare.quality.investigate import issue_counts, largest_errors
from placeshare.quality.invariants import check_invariants, invariant_parts
from placeshare.quality.reconcile import reconcile_all, reconcile_metric
from placeshare.sources.concurrent import concurrently

BY = ("defect",)
CLEAN = ""

# The layers that can notice a defect.
RECONCILIATION, INVARIANT, HAND = "reconciliation", "invariants", "hand-computed"


@dataclass(frozen=True)
class Defect:
    id: str
    name: str
    bug: str
    changes: Mapping[str, object] = field(hash=False)


DEFECTS: tuple[Defect, ...] = tuple(Defect(*row) for row in (
    ("M01", "narrow_wilson", "Share intervals are drawn at 90% instead of 95%",
     {"z_wilson": 1.645}),
    ("M02", "lopsided_wilson", "Only the upper share bound is recentred",
     {"wilson_lo_centred": False}),
    ("M03", "nowhere_is_a_place", "Conversations without a location are treated as places",
     {"exclude_unclassified": False}),
    ("M04", "no_usage_minimum", "The usage index accepts any sample size", {"min_usage": 0}),
    ("M05", "population_optional", "Countries of unknown population join the peer set",
     {"require_population": False}),
    ("M06", "per_million", "Conversations per 100,000 are per million",
     {"per_capita_base": 1_000_000.0}),
    ("M07", "narrow_index_band", "The usage index band is drawn at 90%", {"z_index": 1.645}),
    ("M08", "all_subregions_known", "Provinces are divided by every subregion of any country",
     {"province_total_scope": "all"}),
    ("M09", "automation_is_directive", "Feedback loops do not count as automation",
     {"automation": ("directive",)}),
    ("M10", "validation_forgotten", "Validation is missing from the collaboration total",
     {"collaboration_base": ("directive", "feedback loop", "learning", "task iteration")}),
    ("M11", "unknown_success_is_failure", "Unclassified outcomes count as failures",
     {"success_base": ("yes", "no", "not_classified")}),
    ("M12", "none_is_a_use_case", "Conversations of no use case enter the total",
     {"use_case_base": ("work", "personal", "coursework", "none")}),
    ("M13", "no_share_minimum", "Shares are given for any sample size", {"min_share_n": 0}),
    ("M14", "rest_contains_place", "The rest of the parent still contains the place",
     {"rest_excludes_self": False}),
    ("M15", "province_against_world", "Subregions are compared with the world, not the country",
     {"subregion_parent": "global"}),
    ("M16", "difference_one_sided", "The difference interval leaves out the rest's variance",
     {"rest_two_sample": False}),
    ("M17", "unknown_is_a_request", "Unclassified requests are a category of their own",
     {"unclassified_categories": ()}),
    ("M18", "quotient_one_sided", "The quotient band leaves out the rest's variance",
     {"mix_two_sample": False}),
    ("M19", "no_category_minimum", "Quotients are given for any category count",
     {"min_category": 0}),
    ("M20", "category_rest_is_parent", "A category is compared with the whole parent",
     {"mix_rest_excludes_self": False}),
    ("M21", "gap_reversed", "The platform gap is chat minus api", {"gap_sign": -1.0}),
    ("M22", "gap_one_sided", "The platform gap interval leaves out the api's variance",
     {"gap_two_sample": False}),
    ("M23", "mean_of_exposed", "The mean skips occupations without exposure",
     {"mean_over": "exposed"}),
    ("M24", "mean_as_median", "The median is the mean", {"median": "mean"}),
    ("M25", "dense_ranks", "Ties leave no gap in the ranking", {"ranking": "dense_rank"}),
    ("M26", "tiny_rest", "Any non-empty rest group will do", {"min_rest": 1}),
))


@dataclass(frozen=True)
class Corpus:
    """Inputs, the second formulation's metrics and, where they exist, known answers."""

    name: str
    inputs: Inputs
    definition: Definition
    reference: Mapping[str, DataFrame]
    expected: Mapping[str, DataFrame] | None = None


def make_corpus(
    name: str, inputs: Inputs, d: Definition, expected: Mapping[str, DataFrame] | None = None
) -> Corpus:
    return Corpus(name, inputs, d, sql_metrics(inputs, d), expected)


def override(d: Definition, defect: Defect) -> Definition:
    """The changed definition; a defect that changes nothing is an error."""
    return d.replace(**defect.changes) if defect.changes else d


def version_ids(corpus: Corpus, defects: Sequence[Defect]) -> dict[str, list[str]]:
    """Per metric, the defects that change a setting it reads."""
    before = corpus.definition
    affected = {i.id: affected_metrics(override(before, i), before) for i in defects}
    return {name: [i for i, names in affected.items() if name in names] for name in METRICS}


def stacked_versions(
    corpus: Corpus, defects: Sequence[Defect], clean: Mapping[str, DataFrame] | None = None
) -> dict[str, DataFrame]:
    """Per metric, one frame with the clean version and each defect's that moves it.

    The definitions are the parameters of one plan a metric: facts are read once, folded to one
    counter per distinct rule, and only then told apart by ``defect`` (see plans/versions.py).
    The comparison with the parent's shares needs the shares of each version that it has. Clean
    metrics that are already there need not be built again.
    """
    changed = {defect.id: override(corpus.definition, defect) for defect in defects}
    ids = version_ids(corpus, defects)
    ids["shares"] = [i for i in changed if i in ids["shares"] or i in ids["vs_rest"]]

    def build(name: str) -> DataFrame:
        of = {i: changed[i] for i in ids[name]}
        if clean is not None:
            known = clean[name].withColumn("defect", F.lit(CLEAN))
            if not of:
                return known
            built = build_metrics(corpus.inputs, Versions(of, *BY), [name])[name]
            return built.unionByName(known)
        of = {CLEAN: corpus.definition, **of}
        return build_metrics(corpus.inputs, Versions(of, *BY), [name])[name]

    return written_all(
        corpus.inputs.spark, {name: lambda n=name: build(n) for name in METRICS}
    )


def find_defects(
    corpus: Corpus, defects: Sequence[Defect], metrics: Mapping[str, DataFrame] | None = None
) -> list[Callable[[], DataFrame]]:
    """(defect, layer, metric): which layer sees which defect, and in which metric.

    A few functions, so that they can be planned and run side by side: the comparisons of two
    metrics each, and the invariants. What the clean version shows holds for each defect that
    leaves the metric as it is.
    """
    ids = [defect.id for defect in defects]
    moved = version_ids(corpus, defects)
    sut = stacked_versions(corpus, defects, metrics)

    def spread(found: DataFrame, of: Sequence[str]) -> DataFrame:
        others = [i for i in ids if i not in of]
        clean = F.array(*[F.lit(i) for i in others]).cast("array<string>")
        own = F.filter(F.array("defect"), lambda i: i.isin(*ids))
        return found.withColumn(
            "defect", F.explode(F.when(F.col("defect") == CLEAN, clean).otherwise(own))
        )

    def compare(names: Sequence[str]) -> DataFrame:
        parts = []
        for name in names:
            tags = F.array(*[F.lit(i) for i in (CLEAN, *moved[name])])
            own = sut[name].filter(F.col("defect").isin(CLEAN, *moved[name]))
            for layer, side in sides.items():
                reference = side[name].withColumn("defect", F.explode(tags))
                issues = reconcile_metric(name, own, reference, by=BY)
                parts.append(spread(
                    issues.select("defect", F.lit(layer).alias("layer"), "metric").distinct(),
                    moved[name],
                ))
        return reduce(DataFrame.unionAll, parts)

    def broken() -> DataFrame:
        # each by the metrics it looks at
        parts = []
        for names, check in invariant_parts(
            sut, corpus.inputs, corpus.definition, BY, apart=True
        ):
            looked_at = [i for i in ids if any(i in moved[name] for name in names)]
            parts.append(spread(check().filter(~F.col("passed")).select(
                "defect", F.lit(INVARIANT).alias("layer"),
                F.lit(None).cast("string").alias("metric"),
            ).distinct(), looked_at))
        return reduce(DataFrame.unionAll, parts)

    sides = {
        layer: side for layer, side in
        ((RECONCILIATION, corpus.reference), (HAND, corpus.expected)) if side is not None
    }
    pairs = [("geo_usage", "function_exposure"), ("shares", "platform_gap"),
             ("vs_rest",), ("request_mix",)]
    return [*[lambda names=names: compare(names) for names in pairs], broken]


def _evaluate(
    corpus: Corpus, defects: Sequence[Defect], metrics: Mapping[str, DataFrame] | None
) -> tuple[list[tuple], list[tuple]]:
    """Findings and errors. If the joint run fails, each defect is run alone to find the culprit."""
    try:
        comparisons = find_defects(corpus, defects, metrics)
        rows = concurrently(
            corpus.inputs.spark, [lambda c=compare: c().collect() for compare in comparisons]
        )
        return [(*row, corpus.name) for part in rows for row in part], []
    except PySparkException as failure:
        if len(defects) == 1:
            return [], [(defects[0].id, str(failure))]
        found, errors = [], []
        for defect in defects:
            more, failed = _evaluate(corpus, [defect], metrics)
            found += more
            errors += failed
        return found, errors


def defect_run(corpus: Corpus, *defects: Defect) -> DataFrame:
    """Findings of the given defects on one corpus: (defect, layer, metric, corpus)."""
    found = [compare() for compare in find_defects(corpus, defects)]
    return reduce(DataFrame.unionAll, found).withColumn("corpus", F.lit(corpus.name))


def defect_suite(
    spark: SparkSession,
    corpora: Sequence[Corpus],
    defects: Sequence[Defect] = DEFECTS,
    metrics: Mapping[str, Mapping[str, DataFrame]] | None = None,
) -> DataFrame:
    """(id, name, bug, killed, detected_by, caught_on, metrics_affected, error)

    Collected on the driver: findings only, at most defects x layers x metrics rows per corpus.
    ``metrics`` may hand in a corpus' already built clean metrics, by corpus name.
    """
    found: list[tuple] = []
    errors: list[tuple] = []
    for more, failed in concurrently(spark, [
        lambda c=corpus: _evaluate(c, defects, (metrics or {}).get(c.name)) for corpus in corpora
    ]):
        found += more
        errors += failed
    order = {corpus.name: i for i, corpus in enumerate(corpora)}
    error_of = dict(errors)
    rows = []
    for defect in defects:
        mine = [f for f in found if f[0] == defect.id]
        rows.append((
            defect.id, defect.name, defect.bug, bool(mine),
            ", ".join(sorted({layer for _, layer, _, _ in mine})),
            ", ".join(sorted({c for *_, c in mine}, key=order.__getitem__)),
            ", ".join(sorted({m for _, _, m, _ in mine if m})),
            error_of.get(defect.id),
        ))
    return spark.createDataFrame(
        rows,
        "id string, name string, bug string, killed boolean, detected_by string, "
        "caught_on string, metrics_affected string, error string",
    )


@dataclass(frozen=True)
class DefectReport:
    issues: DataFrame
    cells: DataFrame
    largest: DataFrame
    moved: DataFrame
    unmoved: DataFrame
    broken: DataFrame
    newly_broken: DataFrame


def defect_report(corpus: Corpus, defect_id: str) -> DefectReport:
    """What one defect moves: cells by metric and column, largest errors, metrics that stay.

    ``broken`` has all invariants that fail with the defect; ``newly_broken`` leaves out those that the
    corpus' clean metrics break too, which are the data's doing.
    """
    wanted = [defect for defect in DEFECTS if defect.id == defect_id.upper()]
    if not wanted:
        raise ValueError(f"unknown defect {defect_id!r}")
    d = override(corpus.definition, wanted[0])
    metrics = build_metrics(corpus.inputs, d)
    issues = reconcile_all(metrics, corpus.reference)
    moved = issues.select("metric").distinct()
    names = corpus.inputs.spark.createDataFrame([(name,) for name in METRICS], "metric string")
    broken, before = [
        check_invariants(side, corpus.inputs, corpus.definition).filter(~F.col("passed"))
        for side in (metrics, corpus.reference)
    ]
    return DefectReport(
        issues, issue_counts(issues), largest_errors(issues), moved,
        names.join(moved, "metric", "left_anti"), broken,
        broken.join(before.select("invariant"), "invariant", "left_anti"),
    )
