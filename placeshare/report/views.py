"""Metric tables shaped for display. Sorting happens here, at the output, and nowhere before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeshare.definition import METRIC_ORDER, Definition
from placeshare.report.figures import with_names

# Display names of the share metrics.
METRIC_LABELS = {
    "work_share": "Use at work",
    "coursework_share": "Use for studies",
    "automation_share": "Handed over whole",
    "success_rate": "Rated a success",
}
WORLD = "the world"


def metric_position(metric: Column) -> Column:
    return F.array_position(F.array(*[F.lit(name) for name in METRIC_ORDER]), metric)


def metric_label(metric: Column) -> Column:
    label = F.lit(None).cast("string")
    for name, text in METRIC_LABELS.items():
        label = F.when(metric == name, text).otherwise(label)
    return label


def top_n_pinned(geo_usage: DataFrame, n: int, d: Definition) -> DataFrame:
    """The n highest countries, and the focus country if it is not among them.

    Each task keeps its own n highest rows, so nothing is sorted as a whole.
    """
    countries = geo_usage.filter(F.col("geo_level") == "country")
    top = countries.orderBy(F.desc("usage_index"), "geo_id").limit(n)
    pinned = countries.filter(F.col("geo_id") == d.focus_country).join(
        top.select("geo_id"), "geo_id", "left_anti"
    )
    return top.unionByName(pinned)


def view_countries(geo_usage: DataFrame, names: DataFrame, n: int, d: Definition) -> DataFrame:
    index = F.col("usage_index")
    return with_names(top_n_pinned(geo_usage, n, d), names).select(
        "geo_id", "name", "usage_index",
        (F.col("usage_index_hi") - index).alias("error_up"),
        (index - F.col("usage_index_lo")).alias("error_down"),
        (F.col("geo_id") == d.focus_country).alias("is_focus"),
    ).orderBy("usage_index", F.desc("geo_id"))


def view_provinces(geo_usage: DataFrame, names: DataFrame) -> DataFrame:
    provinces = geo_usage.filter(F.col("geo_level") == "subregion")
    return with_names(provinces, names).select(
        "geo_id", "name", "conversations", "population", "share_of_known", "per_100k",
        "usage_index",
    ).orderBy(F.desc("usage_index"), "geo_id")


def focus_first(ids: DataFrame, names: DataFrame, d: Definition) -> DataFrame:
    """Distinct places, the focus first and then by name."""
    return with_names(ids.select("geo_id").distinct(), names).select("geo_id", "name").orderBy(
        F.col("geo_id") != d.focus_country, "name", "geo_id"
    )


def view_vs_rest(
    vs_rest: DataFrame, names: DataFrame, geo_id: str, d: Definition
) -> DataFrame:
    """One place against the rest of its parent, in percentage points."""
    rows = vs_rest.filter((F.col("source") == d.chat_source) & (F.col("geo_id") == geo_id))
    named = with_names(rows, names, "parent_id").withColumn(
        "parent", F.when(F.col("parent_id") == "GLOBAL", WORLD).otherwise(F.col("name"))
    )

    def points(column: Column) -> Column:
        return F.lit(100.0) * column

    return named.orderBy(metric_position(F.col("metric"))).select(
        metric_label(F.col("metric")).alias("label"), "parent",
        points(F.col("share")).alias("share_pct"),
        points(F.col("share_rest")).alias("rest_pct"),
        points(F.col("diff")).alias("diff_points"),
        points(F.col("diff_hi") - F.col("diff")).alias("error_up"),
        points(F.col("diff") - F.col("diff_lo")).alias("error_down"),
        "n", "n_rest",
    )


def view_request_mix(request_mix: DataFrame, geo_id: str) -> DataFrame:
    lq = F.col("lq")
    return request_mix.filter(F.col("geo_id") == geo_id).select(
        "cluster", "lq",
        (F.col("lq_hi") - lq).alias("error_up"),
        (lq - F.col("lq_lo")).alias("error_down"),
        (F.lit(100.0) * F.col("share")).alias("share_pct"),
        (F.lit(100.0) * F.col("share_rest")).alias("rest_pct"),
        "is_finance_lens",
    ).orderBy("lq", "cluster")


def view_platform_gap(platform_gap: DataFrame, d: Definition) -> DataFrame:
    measures = [f"{d.chat_source}_share", f"{d.api_source}_share", "diff", "diff_lo", "diff_hi"]
    return platform_gap.orderBy(metric_position(F.col("metric"))).select(
        metric_label(F.col("metric")).alias("label"),
        *[(F.lit(100.0) * F.col(column)).alias(column) for column in measures],
    )


def view_group_occupations(occupations: DataFrame, soc_group: str) -> DataFrame:
    return occupations.filter(F.col("occ_code").startswith(f"{soc_group}-")).orderBy(
        F.desc("observed_exposure"), "occ_code"
    )


def view_defects(defects: DataFrame) -> DataFrame:
    return defects.select(
        "id", "bug", F.when(F.col("killed"), "yes").otherwise("NO").alias("caught"),
        "detected_by", "caught_on",
    )
