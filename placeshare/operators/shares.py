"""Four label shares per source and place, with Wilson intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeshare.definition import Definition
from placeshare.functions import places, stats

PLACE = ("source", "geo_id", "geo_level", "country_code")


def families(d: Definition) -> tuple[tuple[str, str, tuple[str, ...], tuple[str, ...]], ...]:
    """(metric, facet, labels counted, labels that hit)"""
    return (
        ("work_share", "use_case", d.use_case_base, d.work),
        ("coursework_share", "use_case", d.use_case_base, d.coursework),
        ("automation_share", "collaboration", d.collaboration_base, d.automation),
        ("success_rate", "task_success", d.success_base, d.success),
    )


def label_counts(staged: DataFrame, d: Definition) -> DataFrame:
    facets = sorted({facet for rules in d.distinct(families) for _, facet, _, _ in rules})
    return staged.filter(
        F.col("facet").isin(*facets)
        & F.col("variable").isin(*[f"{facet}_count" for facet in facets])
        & places.is_count_of_facet(F.col("facet"), F.col("variable"))
        & ~places.left_out_always(d)
    )


def conditional_sum(facet: str, labels: tuple[str, ...]) -> Column:
    """Sum over some labels of a facet; null where the place has no row of that facet."""
    counted = F.when(F.col("cluster").isin(*labels), F.col("value")).otherwise(F.lit(0.0))
    return F.sum(F.when(F.col("facet") == facet, counted))


def share_counts(staged: DataFrame, d: Definition) -> DataFrame:
    """x and n of all four metrics from one scan and one (partially aggregated) shuffle.

    One sum per distinct set of labels of all versions; each version then takes its own.
    """
    sums: dict[tuple, str] = {}
    for rules in d.distinct(families):
        for _, facet, base, hits in rules:
            for labels in (base, hits):
                sums.setdefault((facet, labels), f"sum_{len(sums)}")
    flags = list(places.place_flags(d).values())  # rules on a place's id
    wide = label_counts(staged, d).groupBy(*PLACE, *(flags if len(flags) > 1 else ())).agg(
        *[conditional_sum(facet, labels).alias(name) for (facet, labels), name in sums.items()]
    )
    tagged = d.tagged(wide)
    if len(flags) > 1:
        tagged = tagged.filter(places.kept_place(d))
    names = [metric for metric, _, _, _ in d.distinct(families)[0]]
    cells: list[Column] = []
    for i, metric in enumerate(names):
        cells += [
            F.lit(metric),
            *[
                d.choose(
                    lambda d: (families(d)[i][1], families(d)[i][part]),  # noqa: B023
                    lambda rule: F.col(sums[rule]),
                )
                for part in (3, 2)
            ],
        ]
    return tagged.select(
        *d.keys, *PLACE, F.stack(F.lit(len(names)), *cells).alias("metric", "x", "n")
    )


def shares(staged: DataFrame, d: Definition) -> DataFrame:
    x, n = F.col("x"), F.col("n")
    z = d.choose(lambda d: d.z_wilson, F.lit)
    low = d.choose(lambda d: d.wilson_lo_centred, lambda centred: stats.wilson(x, n, z, centred)[0])
    high = stats.wilson(x, n, z)[1]
    enough = n >= d.choose(lambda d: d.min_share_n, F.lit)
    return share_counts(staged, d).filter(enough).select(
        *d.keys, *PLACE, "metric", "x", "n",
        stats.ratio(x, n).alias("share"), low.alias("lo"), high.alias("hi"),
    )
