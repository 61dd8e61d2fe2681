"""The fifty-three figures of a report, as a long table computed from the six metrics."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeshare.definition import Definition
from placeshare.functions import stats

NUMBER, TEXT = "number", "text"


def geo_names(countries: DataFrame, provinces: DataFrame) -> DataFrame:
    """(geo_id, name, iso3, level) of every country and province."""
    return countries.select(
        F.col("iso2").alias("geo_id"), F.col("country").alias("name"), "iso3",
        F.lit("country").alias("level"),
    ).unionByName(
        provinces.select("geo_id", "name", F.lit("subregion").alias("level")),
        allowMissingColumns=True,
    )


def with_names(df: DataFrame, names: DataFrame, key: str = "geo_id") -> DataFrame:
    """Look a name up; an id without one keeps its id."""
    lookup = names.select(F.col("geo_id").alias(key), F.col("name").alias("__name"))
    return df.join(lookup, key, "left").withColumn(
        "name", F.coalesce("__name", F.col(key))
    ).drop("__name")


def _pick(condition: Column, column: Column) -> Column:
    return F.max(F.when(condition, column))


def _long(one_row: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """A one-row frame -> (label, value, text), one row per figure."""
    cells = []
    for label, kind in kinds.items():
        number = f"cast({label} as double)" if kind == NUMBER else "cast(null as double)"
        text = f"cast({label} as string)" if kind == TEXT else "cast(null as string)"
        cells.append(f"'{label}', {number}, {text}")
    return one_row.selectExpr(f"stack({len(cells)}, {', '.join(cells)}) as (label, value, text)")


def _figures(df: DataFrame, columns: Mapping[str, Column], texts: set[str]) -> DataFrame:
    kinds = {label: TEXT if label in texts else NUMBER for label in columns}
    return _long(df.agg(*[c.alias(label) for label, c in columns.items()]), kinds)


def focus_rank(geo_usage: DataFrame, d: Definition) -> DataFrame:
    """The focus country's position by usage index, ties by id: a count, not a global sort."""
    countries = geo_usage.filter(F.col("geo_level") == "country")
    # one row: the place id is the key of geo_usage
    focus = F.broadcast(countries.filter(F.col("geo_id") == d.focus_country).select(
        "geo_level", F.col("usage_index").alias("its_index")
    ))
    ahead = (F.col("usage_index") > F.col("its_index")) | (
        (F.col("usage_index") == F.col("its_index")) & (F.col("geo_id") < d.focus_country)
    )
    return countries.join(focus, "geo_level").agg(
        (F.sum(F.when(ahead, 1).otherwise(0)) + 1).alias("focus_rank")
    )


def usage_figures(geo_usage: DataFrame, names: DataFrame, d: Definition) -> DataFrame:
    index, place = F.col("usage_index"), F.col("geo_id")
    country = F.col("geo_level") == "country"
    province = F.col("geo_level") == "subregion"
    focus = place == d.focus_country
    row = F.struct("name", "usage_index", "usage_index_lo", "usage_index_hi")
    highest = F.struct((-index).alias("i"), place.alias("g"))
    lowest = F.struct(index.alias("i"), place.alias("g"))
    top = F.min_by(row, F.when(country, highest))
    best = F.min_by(row, F.when(province, highest))
    worst = F.min_by(row, F.when(province, lowest))
    columns = {
        "countries_in_index": F.sum(F.when(country, 1).otherwise(0)),
        "focus_index": _pick(focus, index),
        "focus_index_lo": _pick(focus, F.col("usage_index_lo")),
        "focus_index_hi": _pick(focus, F.col("usage_index_hi")),
        "focus_conversations": _pick(focus, F.col("conversations")),
        "top_country": top["name"],
        "top_country_index": top["usage_index"],
        "best_province": best["name"],
        "best_province_index": best["usage_index"],
        "worst_province": worst["name"],
        "worst_province_index": worst["usage_index"],
        "worst_province_index_lo": worst["usage_index_lo"],
        "worst_province_index_hi": worst["usage_index_hi"],
        "province_spread": stats.ratio(_pick(province, index), F.min(F.when(province, index))),
    }
    named = with_names(geo_usage, names)
    return _figures(named, columns, {"top_country", "best_province", "worst_province"}).unionByName(
        _long(focus_rank(geo_usage, d), {"focus_rank": NUMBER})
    )


def rest_figures(vs_rest: DataFrame, d: Definition) -> DataFrame:
    focus = vs_rest.filter(
        (F.col("source") == d.chat_source) & (F.col("geo_id") == d.focus_country)
    )

    def points(metric: str, column: str) -> Column:
        return F.lit(100.0) * _pick(F.col("metric") == metric, F.col(column))

    return _figures(focus, {
        "focus_work_pct": points("work_share", "share"),
        "rest_work_pct": points("work_share", "share_rest"),
        "work_gap_points": points("work_share", "diff"),
        "work_gap_points_lo": points("work_share", "diff_lo"),
        "work_gap_points_hi": points("work_share", "diff_hi"),
        "coursework_gap_points": points("coursework_share", "diff"),
        "focus_automation_pct": points("automation_share", "share"),
        "rest_automation_pct": points("automation_share", "share_rest"),
        "focus_success_pct": points("success_rate", "share"),
        "rest_success_pct": points("success_rate", "share_rest"),
        "success_gap_points_lo": points("success_rate", "diff_lo"),
        "success_gap_points_hi": points("success_rate", "diff_hi"),
    }, set())


def request_figures(request_mix: DataFrame, d: Definition) -> DataFrame:
    focus = request_mix.filter(F.col("geo_id") == d.focus_country)
    lq, cluster, listed = F.col("lq"), F.col("cluster"), F.col("is_finance_lens")
    over, under = F.col("lq_lo") > 1, F.col("lq_hi") < 1
    row = F.struct("cluster", "lq", "lq_lo", "lq_hi")
    most = F.min_by(row, F.when(over, F.struct((-lq).alias("q"), cluster.alias("c"))))
    least = F.min_by(row, F.when(under, F.struct(lq.alias("q"), cluster.alias("c"))))

    def how_many(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))

    def names(condition: Column) -> Column:
        # at most one entry per category of the lens list
        return F.array_join(F.array_sort(F.collect_set(F.when(condition, cluster))), "; ")

    return _figures(focus, {
        "top_over_request": F.coalesce(most["cluster"], F.lit("none")),
        "top_under_request": F.coalesce(least["cluster"], F.lit("none")),
        "over_request_lq": most["lq"],
        "over_request_lq_lo": most["lq_lo"],
        "over_request_lq_hi": most["lq_hi"],
        "under_request_lq": least["lq"],
        "under_request_lq_lo": least["lq_lo"],
        "under_request_lq_hi": least["lq_hi"],
        "lens_categories": how_many(listed),
        "lens_over": how_many(listed & over),
        "lens_under": how_many(listed & under),
        "lens_over_names": names(listed & over),
        "lens_under_names": names(listed & under),
    }, {"top_over_request", "top_under_request", "lens_over_names", "lens_under_names"})


def gap_figures(platform_gap: DataFrame, d: Definition) -> DataFrame:
    columns = {}
    for metric, short in (
        ("work_share", "work"), ("automation_share", "automation"), ("success_rate", "success")
    ):
        for source in (d.chat_source, d.api_source):
            columns[f"global_{source}_{short}_pct"] = F.lit(100.0) * _pick(
                F.col("metric") == metric, F.col(f"{source}_share")
            )
    return _figures(platform_gap, columns, set())


def exposure_figures(function_exposure: DataFrame, d: Definition) -> DataFrame:
    mine = F.col("soc_group") == d.focus_group
    return _figures(function_exposure, {
        "focus_group_rank": _pick(mine, F.col("rank_by_mean")),
        "occupation_groups": F.count(F.lit(1)),
        "focus_group_mean_exposure": _pick(mine, F.col("mean_exposure")),
        "focus_group_exposed_pct": F.lit(100.0) * _pick(mine, F.col("share_with_exposure")),
        "focus_group_top_occupation": _pick(mine, F.col("most_exposed_occupation")),
        "focus_group_top_exposure": _pick(mine, F.col("max_exposure")),
        "top_group": F.min_by("soc_name", F.struct("rank_by_mean", "soc_group")),
    }, {"focus_group_top_occupation", "top_group"})


def figure_frames(
    metrics: Mapping[str, DataFrame], names: DataFrame, d: Definition
) -> list[DataFrame]:
    return [
        usage_figures(metrics["geo_usage"], names, d),
        rest_figures(metrics["vs_rest"], d),
        request_figures(metrics["request_mix"], d),
        gap_figures(metrics["platform_gap"], d),
        exposure_figures(metrics["function_exposure"], d),
    ]


def brief_facts(
    metrics: Mapping[str, DataFrame], names: DataFrame, d: Definition
) -> DataFrame:
    """(label, value, text): 53 figures, each with a number or a text."""
    return reduce(DataFrame.unionByName, figure_frames(metrics, names, d))


def figure_verification(figures: DataFrame, reference: DataFrame) -> DataFrame:
    """Each figure next to the one from the second formulation, and whether they agree."""
    other = reference.select(
        "label", F.col("value").alias("ref_value"), F.col("text").alias("ref_text"),
        F.lit(True).alias("in_ref"),
    )
    agree = (
        stats.is_close(F.col("value"), F.col("ref_value"), 1e-9, 1e-9)
        & F.col("text").eqNullSafe(F.col("ref_text"))
    )
    return (
        figures.withColumn("in_sut", F.lit(True)).join(other, "label", "full")
        .withColumn(
            "match", agree & F.col("in_sut").isNotNull() & F.col("in_ref").isNotNull()
        )
        .select("label", "value", "ref_value", "text", "ref_text", "match")
    )


def direction_flags(figures: DataFrame) -> DataFrame:
    """The words a reader would use, decided on the figures as they are printed (one decimal)."""
    def shown(label: str) -> Column:
        return F.round(_pick(F.col("label") == label, F.col("value")), 1)

    clear = (shown("success_gap_points_lo") > 0) | (shown("success_gap_points_hi") < 0)
    return figures.agg(
        F.when(shown("work_gap_points") < 0, "lower").otherwise("higher").alias("work_direction"),
        F.when(shown("coursework_gap_points") > 0, "higher").otherwise("lower")
        .alias("coursework_direction"),
        F.when(shown("focus_automation_pct") < shown("rest_automation_pct"), "less")
        .otherwise("more").alias("automation_direction"),
        F.coalesce(clear, F.lit(False)).alias("success_gap_is_clear"),
    )
