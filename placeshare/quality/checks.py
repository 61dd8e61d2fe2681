"""Twenty checks on the inputs, in about eight passes instead of twenty."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeshare.definition import CHECKED_FACETS, GLOBAL_ID, Definition
from placeshare.functions import places, stats
from placeshare.inputs import Inputs
from placeshare.operators.joins import join_parent
from placeshare.quality.investigate import rollup_gaps, usage_counts

INFINITE = float("inf")


@dataclass(frozen=True)
class Check:
    name: str
    layer: str
    severity: str
    max_allowed: float
    description: str


CHECKS: dict[str, Check] = {
    check.name: check
    for check in (
        Check("both_sources_loaded", "source", "error", 0,
              "How many of the two expected sources have no rows"),
        Check("duplicate_keys", "source", "error", 0,
              "Keys (source, place, facet, level, variable, label) with more than one row"),
        Check("null_values", "source", "error", 0,
              "Rows without a value, place, facet or variable"),
        Check("negative_values", "source", "error", 0,
              "Rows below zero that are not the lower end of an interval"),
        Check("negative_ci_lower_bounds", "source", "info", INFINITE,
              "Lower interval ends below zero; no metric uses them"),
        Check("percentages_out_of_range", "source", "error", 0,
              "Percentages under 0 or over 100"),
        Check("period_is_one_week", "source", "error", 0,
              "Sources that mix periods or do not span exactly seven days"),
        Check("shares_sum_to_100", "consistency", "error", 0,
              "Label groups whose percentages miss 100"),
        Check("counts_agree_with_percentages", "consistency", "error", 0,
              "Labels whose percentage is not their count over the group's total"),
        Check("unknown_country_codes", "geography", "error", 0,
              "Distinct country ids that the country table lacks"),
        Check("unknown_subregion_parents", "geography", "error", 0,
              "Distinct subregion ids whose prefix the country table lacks"),
        Check("unexplained_rollup_gaps", "geography", "error", 0,
              "Countries whose subregions miss the country count by something other than the "
              "territories that are listed twice"),
        Check("documented_rollup_gaps", "geography", "info", INFINITE,
              "Countries whose subregions do not add up to the country count"),
        Check("countries_missing_from_sample_total", "coverage", "warn", 0.02,
              "Part of the sample that no country row accounts for"),
        Check("unclassified_geography_share", "coverage", "warn", 0.25,
              "Part of the sample that has no usable country"),
        Check("countries_without_population", "coverage", "info", INFINITE,
              "Countries with a sufficient sample that the index leaves out for lack of a "
              "population figure"),
        Check("small_count_cells", "coverage", "warn", 0.15,
              "Part of the count cells that hold fewer than 15 conversations"),
        Check("finance_lens_clusters_exist", "reference", "error", 0,
              "Listed categories that the global request taxonomy lacks"),
        Check("job_exposure_contract", "reference", "error", 0,
              "Occupations with a malformed or repeated code or a score outside 0 to 1"),
        Check("province_population_adds_up", "reference", "error", 0,
              "Distance between the provinces' populations and the published total"),
    )
}


def _count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0)))


def _is_ci_lower(variable: Column) -> Column:
    return variable.endswith("_ci_lower")


def per_source(facts: DataFrame, d: Definition) -> DataFrame:
    """Every row-level check in one scan, folded to one row per source before the shuffle."""
    value, variable, geo_id = F.col("value"), F.col("variable"), F.col("geo_id")
    chat = F.col("source") == d.chat_source
    country_usage = (
        chat & (F.col("geography") == "country") & (F.col("facet") == "country")
        & (variable == "usage_count")
    )
    sample = (
        chat & (geo_id == GLOBAL_ID) & (F.col("facet") == "use_case")
        & (variable == "use_case_count")
    )
    pct = variable.endswith("_pct") & ~places.is_histogram(variable)
    count_cell = variable.endswith("_count") & ~places.is_histogram(variable)
    span = F.datediff("date_end", "date_start")
    return facts.groupBy("source").agg(
        _count_if(places.any_null([value, geo_id, F.col("facet"), variable])).alias("nulls"),
        _count_if((value < 0) & ~_is_ci_lower(variable)).alias("negatives"),
        _count_if((value < 0) & _is_ci_lower(variable)).alias("negative_lower"),
        _count_if(pct & ((value < 0) | (value > 100.000001))).alias("pct_outside"),
        F.min("date_start").alias("start_min"), F.max("date_start").alias("start_max"),
        F.min("date_end").alias("end_min"), F.max("date_end").alias("end_max"),
        F.min(span).alias("span_min"), F.max(span).alias("span_max"),
        F.sum(F.when(country_usage, value)).alias("in_countries"),
        F.sum(F.when(country_usage & geo_id.isin(*d.unclassified_ids), value)).alias("nowhere"),
        F.sum(F.when(sample, value)).alias("sampled"),
        _count_if(count_cell & (value < 15)).alias("small_cells"),
        _count_if(count_cell).alias("cells"),
    )


def row_checks(facts: DataFrame, d: Definition) -> DataFrame:
    def differs(a: Column, b) -> Column:
        return F.coalesce(a != b, F.lit(False))

    one_start = F.coalesce(F.col("start_min") == F.col("start_max"), F.lit(False))
    one_end = F.coalesce(F.col("end_min") == F.col("end_max"), F.lit(False))
    bad_period = (
        ~one_start | ~one_end | differs(F.col("span_min"), 7) | differs(F.col("span_max"), 7)
    )
    sampled = F.sum("sampled")
    folded = per_source(facts, d).agg(
        (F.lit(2) - F.count("source")).alias("both_sources_loaded"),
        F.sum("nulls").alias("null_values"),
        F.sum("negatives").alias("negative_values"),
        F.sum("negative_lower").alias("negative_ci_lower_bounds"),
        F.sum("pct_outside").alias("percentages_out_of_range"),
        _count_if(bad_period).alias("period_is_one_week"),
        (F.lit(1.0) - stats.ratio(F.sum("in_countries"), sampled))
        .alias("countries_missing_from_sample_total"),
        stats.ratio(F.sum("nowhere"), sampled).alias("unclassified_geography_share"),
        stats.ratio(F.sum("small_cells"), F.sum("cells")).alias("small_count_cells"),
    )
    return _as_checks(folded)


def key_signature(columns: Sequence[Column]) -> Column:
    """64 bits of a key; a hash passes over nulls, so where they are is hashed, too."""
    return F.xxhash64(*columns, *[column.isNull() for column in columns])


def duplicate_keys(
    facts: DataFrame, signature: Callable[[Sequence[Column]], Column] = key_signature
) -> DataFrame:
    """How many keys occur twice or more.

    Only signatures of keys are shuffled and counted; whole keys only of rows whose signature occurs
    twice, which tells real duplicates from keys that share a signature by chance.
    """
    keys = [
        F.col("source"), F.col("geo_id"), F.col("facet"), F.col("level"), F.col("variable"),
        places.cluster_or_blank(F.col("cluster_name")).alias("cluster"),
    ]
    names = ["source", "geo_id", "facet", "level", "variable", "cluster"]
    keyed = facts.select(*keys).withColumn("signature", signature([F.col(n) for n in names]))
    twice = keyed.groupBy("signature").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    suspects = keyed.join(twice.select("signature"), "signature", "left_semi")
    return suspects.groupBy(*names).agg(F.count(F.lit(1)).alias("k")).filter("k > 1").agg(
        F.count(F.lit(1)).alias("duplicate_keys")
    )


GROUP = ("source", "geo_id", "facet", "level")


def _checked(facts: DataFrame, which: str, is_kind) -> DataFrame:
    return facts.filter(
        F.col("facet").isin(*CHECKED_FACETS)
        & F.col("variable").isin(*[f"{facet}_{which}" for facet in CHECKED_FACETS])
        & is_kind(F.col("facet"), F.col("variable"))
    )


def pct_groups(facts: DataFrame) -> DataFrame:
    return _checked(facts, "pct", places.is_pct_of_facet).groupBy(*GROUP).agg(
        F.sum("value").alias("total")
    )


def shares_sum_to_100(facts: DataFrame) -> DataFrame:
    return pct_groups(facts).agg(
        _count_if(F.abs(F.col("total") - 100) > 0.01).alias("shares_sum_to_100")
    )


def count_pct_pairs(facts: DataFrame, d: Definition) -> DataFrame:
    """count, total of its group and published percentage, for every label that has all three."""
    counts = _checked(facts, "count", places.is_count_of_facet).select(
        *GROUP, "cluster_name", F.col("value").alias("n")
    )
    totals = counts.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    pcts = _checked(facts, "pct", places.is_pct_of_facet).select(
        *GROUP, "cluster_name", F.col("value").alias("pct")
    )
    pairs = counts.join(pcts, [*GROUP, "cluster_name"])
    return join_parent(pairs, totals, GROUP, ["cluster_name"], d.salts)


def counts_agree_with_percentages(facts: DataFrame, d: Definition) -> DataFrame:
    expected = stats.ratio(F.lit(100.0) * F.col("n"), F.col("total"))
    return count_pct_pairs(facts, d).agg(
        _count_if(F.abs(expected - F.col("pct")) > 0.0001)
        .alias("counts_agree_with_percentages")
    )


def unknown_places(facts: DataFrame, countries: DataFrame, d: Definition) -> DataFrame:
    """Distinct places whose country code is in no country row."""
    is_country = F.col("geography") == "country"
    # distinct first: map-side, a fact table has few places
    ids = facts.filter(
        (is_country & ~F.col("geo_id").isin(*d.unclassified_ids))
        | (F.col("geography") == "country-state")
    ).select("geography", "geo_id").distinct()
    coded = ids.withColumn(
        "iso2", F.when(is_country, F.col("geo_id")).otherwise(places.place_prefix(F.col("geo_id")))
    ).filter(F.col("iso2").isNotNull())
    known = countries.select("iso2").filter(F.col("iso2").isNotNull()).distinct()
    return coded.join(known, "iso2", "left_anti")


def place_checks(facts: DataFrame, countries: DataFrame, d: Definition) -> DataFrame:
    geography = F.col("geography")
    return _as_checks(unknown_places(facts, countries, d).agg(
        _count_if(geography == "country").alias("unknown_country_codes"),
        _count_if(geography == "country-state").alias("unknown_subregion_parents"),
    ))


def gap_checks(facts: DataFrame, territories: DataFrame, d: Definition) -> DataFrame:
    return _as_checks(rollup_gaps(facts, territories, d).agg(
        _count_if(F.col("unexplained") != 0).alias("unexplained_rollup_gaps"),
        _count_if(F.col("gap") != 0).alias("documented_rollup_gaps"),
    ))


def countries_lacking_population(
    facts: DataFrame, countries: DataFrame, d: Definition
) -> DataFrame:
    usage = usage_counts(facts, "country", d).filter(F.col("value") >= d.min_usage)
    return usage.join(
        countries.select(F.col("iso2").alias("geo_id"), "population"), "geo_id"
    ).filter(F.col("population").isNull())


def unknown_lens_clusters(facts: DataFrame, lens: DataFrame, d: Definition) -> DataFrame:
    """Listed categories the taxonomy lacks; a null in the list is not a category."""
    taxonomy = facts.filter(
        (F.col("source") == d.chat_source) & (F.col("geo_id") == GLOBAL_ID)
        & (F.col("facet") == "request") & (F.col("level") == d.request_level)
        & (F.col("variable") == "request_count")
    ).select(F.col("cluster_name").alias("cluster"))
    return lens.filter(F.col("cluster").isNotNull()).join(taxonomy, "cluster", "left_anti")


OCCUPATION_CODE = "^[0-9]{2}-[0-9]{4}$"


def job_exposure_contract(occupations: DataFrame) -> DataFrame:
    score = F.col("observed_exposure")
    bad = ~F.col("occ_code").rlike(OCCUPATION_CODE) | (score < 0) | (score > 1)
    by_code = occupations.groupBy("occ_code").agg(
        _count_if(bad).alias("bad"), F.count(F.lit(1)).alias("k")
    )
    return by_code.agg(
        (F.sum("bad") + F.sum("k") - F.count("occ_code")).alias("job_exposure_contract")
    )


def province_population_adds_up(provinces: DataFrame, published: DataFrame) -> DataFrame:
    signed = provinces.select("population").unionAll(
        published.select(-F.col("population"))
    )
    return signed.agg(F.abs(F.sum("population")).alias("province_population_adds_up"))


def _as_checks(one_row: DataFrame) -> DataFrame:
    """A one-row frame with a column per check -> one row per check, judged."""
    cells = []
    for name in one_row.columns:
        check = CHECKS[name]
        cells.append(
            f"""'{check.layer}', '{name}', '{check.severity}', cast({name} as double), """
            f"""cast('{check.max_allowed}' as double), "{check.description}\""""
        )
    rows = one_row.selectExpr(
        f"stack({len(cells)}, {', '.join(cells)}) "
        "as (layer, check, severity, value, max_allowed, description)"
    )
    # nothing to divide or count is not a finding
    return rows.selectExpr(
        "layer", "check", "severity", "coalesce(nanvl(value, 0D), 0D) as value", "max_allowed",
        "abs(coalesce(nanvl(value, 0D), 0D)) <= max_allowed as passed", "description",
    )


def _passes(inputs: Inputs, d: Definition) -> list[tuple[tuple[str, ...], Callable]]:
    """Which checks each pass answers, and the pass itself."""
    facts, count = inputs.facts, F.count(F.lit(1))
    return [
        (
            ("both_sources_loaded", "null_values", "negative_values", "negative_ci_lower_bounds",
             "percentages_out_of_range", "period_is_one_week",
             "countries_missing_from_sample_total", "unclassified_geography_share",
             "small_count_cells"),
            lambda: row_checks(facts, d),
        ),
        (("duplicate_keys",), lambda: _as_checks(duplicate_keys(facts))),
        (("shares_sum_to_100",), lambda: _as_checks(shares_sum_to_100(facts))),
        (
            ("counts_agree_with_percentages",),
            lambda: _as_checks(counts_agree_with_percentages(facts, d)),
        ),
        (
            ("unknown_country_codes", "unknown_subregion_parents"),
            lambda: place_checks(facts, inputs.countries, d),
        ),
        (
            ("unexplained_rollup_gaps", "documented_rollup_gaps"),
            lambda: gap_checks(facts, inputs.territories, d),
        ),
        (
            ("countries_without_population",),
            lambda: _as_checks(
                countries_lacking_population(facts, inputs.countries, d)
                .agg(count.alias("countries_without_population"))
            ),
        ),
        (
            ("finance_lens_clusters_exist",),
            lambda: _as_checks(
                unknown_lens_clusters(facts, inputs.lens, d)
                .agg(count.alias("finance_lens_clusters_exist"))
            ),
        ),
        (
            ("job_exposure_contract",),
            lambda: _as_checks(job_exposure_contract(inputs.occupations)),
        ),
        (
            ("province_population_adds_up",),
            lambda: _as_checks(
                province_population_adds_up(inputs.provinces, inputs.focus_population)
            ),
        ),
    ]


def check_frames(
    inputs: Inputs, d: Definition, names: Collection[str] | None = None
) -> list[DataFrame]:
    """The passes that answer the named checks, as independent lazy frames."""
    wanted = set(CHECKS if names is None else names)
    frames = []
    for answers, build in _passes(inputs, d):
        if wanted.issuperset(answers):
            frames.append(build())
        elif wanted & set(answers):
            frames.append(build().filter(F.col("check").isin(*sorted(wanted))))
    return frames


def run_checks(
    inputs: Inputs, d: Definition, layers: Collection[str] | None = None
) -> DataFrame:
    """(layer, check, severity, value, max_allowed, passed, description)"""
    names = [c.name for c in CHECKS.values() if layers is None or c.layer in layers]
    if not names:
        raise ValueError(f"no such layer: {layers}")
    return reduce(DataFrame.unionByName, check_frames(inputs, d, names))


def run_check(inputs: Inputs, d: Definition, name: str) -> DataFrame:
    return reduce(DataFrame.unionByName, check_frames(inputs, d, [name]))
