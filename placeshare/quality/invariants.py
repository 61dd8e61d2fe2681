"""Eighteen properties that any correct output has, whatever the data."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeshare.definition import Definition
from placeshare.functions import places, stats
from placeshare.inputs import Inputs
from placeshare.operators.joins import join_parent, mark_in

BRACKET_SLACK = 1e-12
SUM_SLACK = 1e-9
SALTS = Definition().salts  # copies of a parent, as most places hang off the root

INVARIANTS: dict[str, str] = {
    "shares_within_unit_range": "a share lies outside 0 to 1",
    "share_inside_its_interval": "an interval misses its share",
    "numerator_within_denominator": "x exceeds n",
    "index_positive_and_inside_its_band": "an index is not positive or misses its band",
    "weighted_mean_index_is_one": "a peer set's population-weighted mean index is not 1",
    "known_usage_shares_within_one": "shares of known usage exceed 1",
    "rest_share_within_unit_range": "a rest-of-parent share lies outside 0 to 1",
    "place_and_rest_rebuild_parent": "a place and its rest do not add up to the parent",
    "difference_inside_its_interval": "an interval misses its difference",
    "quotient_positive_and_inside_its_band": "a quotient is not positive or misses its band",
    "category_meets_minimum": "a category is below the minimum count",
    "category_shares_within_one": "category shares of a place exceed 1",
    "gap_is_api_minus_chat": "a gap is not api minus chat, or misses its interval",
    "exposure_in_range": "exposure statistics are out of range",
    "occupations_all_counted": "group counts do not add up to the occupation table",
    "ranks_start_at_one": "no group ranks first",
    "no_unclassified_place": "an unclassified place reached a metric",
    "indexed_places_are_known": "an indexed place is in no population table",
}


def _every(condition: Column) -> Column:
    """True for no rows; a comparison with a missing value counts as failed."""
    return F.coalesce(F.bool_and(F.coalesce(condition, F.lit(False))), F.lit(True))


def _within(column: str, low: float = 0.0, high: float = 1.0) -> Column:
    return F.col(column).between(low, high) & ~F.isnan(column)


def _bracketed(low: str, middle: str, high: str, slack: float = BRACKET_SLACK) -> Column:
    return (
        (F.col(low) <= F.col(middle) + slack) & (F.col(middle) <= F.col(high) + slack)
        & ~F.isnan(low) & ~F.isnan(high) & ~F.isnan(middle)
    )


def _long(verdicts: DataFrame, by: Sequence[str]) -> DataFrame:
    names = [c for c in verdicts.columns if c not in by]
    cells = [
        f"""'{name}', {name}, if({name}, '', "{INVARIANTS[name]}")""" for name in names
    ]
    return verdicts.selectExpr(
        *by, f"stack({len(names)}, {', '.join(cells)}) as (invariant, passed, detail)"
    )


def _geo_usage(geo: DataFrame, by: Sequence[str]) -> DataFrame:
    levels = geo.groupBy(*by, "geo_level").agg(
        _every(
            (F.col("usage_index") > 0)
            & _bracketed("usage_index_lo", "usage_index", "usage_index_hi", 0.0)
        ).alias("inside"),
        stats.ratio(
            F.sum(F.col("population") * F.col("usage_index")), F.sum("population")
        ).alias("mean"),
        F.sum("share_of_known").alias("known"),
    )
    per_level = levels.groupBy(*by).agg(
        _every(F.col("inside")).alias("index_positive_and_inside_its_band"),
        _every(stats.is_close(F.col("mean"), F.lit(1.0), 1e-5, 1e-8))
        .alias("weighted_mean_index_is_one"),
        _every(F.col("known") <= 1 + SUM_SLACK).alias("known_usage_shares_within_one"),
    )
    return _long(per_level, by)


def _known_places(geo: DataFrame, inputs: Inputs, by: Sequence[str]) -> DataFrame:
    known = inputs.countries.select(F.col("iso2").alias("geo_id")).unionAll(
        inputs.provinces.select("geo_id")
    )
    listed = mark_in(geo.select(*by, "geo_id"), "geo_id", known, "geo_id", "is_known")
    places_known = listed.groupBy(*by).agg(
        _every(F.col("is_known")).alias("indexed_places_are_known")
    )
    return _long(places_known, by)


def _shares(shares: DataFrame, by: Sequence[str]) -> DataFrame:
    return _long(shares.groupBy(*by).agg(
        _every(_within("share")).alias("shares_within_unit_range"),
        _every(_bracketed("lo", "share", "hi")).alias("share_inside_its_interval"),
        _every(F.col("x") <= F.col("n")).alias("numerator_within_denominator"),
    ), by)


def rebuilt_parents(rest: DataFrame, shares: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """x and rest put back together, next to the parent's own share."""
    parents = shares.filter(F.col("geo_level").isin("global", "country")).select(
        *by, "source", "metric", F.col("geo_id").alias("parent_id"),
        F.col("share").alias("parent_share"),
    )
    rebuilt = rest.withColumn(
        "rebuilt",
        stats.ratio(F.col("x") + F.col("x_rest"), F.col("n") + F.col("n_rest")),
    )
    return join_parent(
        rebuilt, parents, [*by, "source", "metric", "parent_id"], ["geo_id"], SALTS, how="left"
    )


def _vs_rest(rest: DataFrame, shares: DataFrame, by: Sequence[str]) -> DataFrame:
    same = stats.is_close(F.col("rebuilt"), F.col("parent_share"), 1e-9, 1e-12)
    whole = F.col("rebuilt").isNotNull() & F.col("parent_share").isNotNull() & same
    return _long(rebuilt_parents(rest, shares, by).groupBy(*by).agg(
        _every(_within("share_rest")).alias("rest_share_within_unit_range"),
        _every(whole).alias("place_and_rest_rebuild_parent"),
        _every(_bracketed("diff_lo", "diff", "diff_hi"))
        .alias("difference_inside_its_interval"),
    ), by)


def _request_mix(mix: DataFrame, d: Definition, by: Sequence[str]) -> DataFrame:
    place = mix.groupBy(*by, "geo_id").agg(
        _every((F.col("lq") > 0) & _bracketed("lq_lo", "lq", "lq_hi")).alias("inside"),
        _every(F.col("x") >= d.min_category).alias("enough"),
        F.sum("share").alias("total"),
    )
    return _long(place.groupBy(*by).agg(
        _every(F.col("inside")).alias("quotient_positive_and_inside_its_band"),
        _every(F.col("enough")).alias("category_meets_minimum"),
        _every(F.col("total") <= 1 + SUM_SLACK).alias("category_shares_within_one"),
    ), by)


def _platform_gap(gap: DataFrame, d: Definition, by: Sequence[str]) -> DataFrame:
    expected = F.col(f"{d.api_source}_share") - F.col(f"{d.chat_source}_share")
    return _long(gap.groupBy(*by).agg(
        _every(
            stats.is_close(F.col("diff"), expected, 1e-5, 1e-8)
            & _bracketed("diff_lo", "diff", "diff_hi", 0.0)
        ).alias("gap_is_api_minus_chat"),
    ), by)


def _function_exposure(
    exposure: DataFrame, inputs: Inputs, by: Sequence[str]
) -> DataFrame:
    ranges = exposure.groupBy(*by).agg(
        _every(
            _within("mean_exposure") & _within("share_with_exposure")
            & (F.col("median_exposure") <= F.col("max_exposure") + BRACKET_SLACK)
        ).alias("exposure_in_range"),
        F.coalesce(F.min("rank_by_mean") == 1, F.lit(False)).alias("ranks_start_at_one"),
        F.coalesce(F.sum("occupations"), F.lit(0)).alias("counted"),
    )
    size = inputs.occupations.agg(F.count(F.lit(1))).scalar()
    tagged = ranges.withColumn("occupations_all_counted", F.col("counted") == size)
    return _long(tagged.select(
        *by, "exposure_in_range", "ranks_start_at_one", "occupations_all_counted"
    ), by)


def _unclassified(
    frames: Sequence[DataFrame], d: Definition, by: Sequence[str]
) -> DataFrame:
    ids = reduce(DataFrame.unionAll, [df.select(*by, "geo_id") for df in frames])
    return _long(ids.groupBy(*by).agg(
        _every(~places.is_unclassified(F.col("geo_id"), d)).alias("no_unclassified_place")
    ), by)


def invariant_parts(
    metrics: Mapping[str, DataFrame], inputs: Inputs, d: Definition, by: Sequence[str] = (),
    apart: bool = False,
) -> list[tuple[tuple[str, ...], Callable[[], DataFrame]]]:
    """The verdicts as independent frames, built on call, with the metrics that each looks at.

    ``apart`` judges places metric by metric, for groups that do not have all metrics.
    """
    geo, shares, mix = metrics["geo_usage"], metrics["shares"], metrics["request_mix"]
    placed = [("geo_usage", "shares", "request_mix")]
    if apart:
        placed = [(name,) for name in placed[0]]
    return [
        (("shares",), lambda: _shares(shares, by)),
        (("geo_usage",), lambda: _geo_usage(geo, by)),
        (("geo_usage",), lambda: _known_places(geo, inputs, by)),
        (("vs_rest", "shares"), lambda: _vs_rest(metrics["vs_rest"], shares, by)),
        (("request_mix",), lambda: _request_mix(mix, d, by)),
        (("platform_gap",), lambda: _platform_gap(metrics["platform_gap"], d, by)),
        (("function_exposure",), lambda: _function_exposure(metrics["function_exposure"], inputs, by)),
        *[
            (names, lambda names=names: _unclassified([metrics[n] for n in names], d, by))
            for names in placed
        ],
    ]


def check_invariants(
    metrics: Mapping[str, DataFrame], inputs: Inputs, d: Definition, by: Sequence[str] = ()
) -> DataFrame:
    """(invariant, passed, detail), one aggregate per metric; per value of ``by`` if given."""
    frames = [build() for _, build in invariant_parts(metrics, inputs, d, by)]
    return reduce(DataFrame.unionByName, frames)
