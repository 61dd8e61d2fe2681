"""Which request categories a place over- or under-uses against the rest of its parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeshare.definition import Definition
from placeshare.functions import places, stats
from placeshare.operators.joins import join_parent, mark_in


def category_rule(d: Definition) -> tuple[str, ...]:
    return d.unclassified_categories


def is_counted(rule: tuple[str, ...]) -> Column:
    return ~F.col("cluster").isin(*rule) if rule else F.lit(True)


def total_names(d: Definition, prefix: str = "") -> dict[tuple[str, ...], str]:
    """The column of a place's total under each distinct rule on categories."""
    rules = d.distinct(category_rule)
    return {rule: f"{prefix}n" + (f"_{i}" if i else "") for i, rule in enumerate(rules)}


def _flags(d: Definition) -> list[str]:
    """Columns that tell versions apart; a single definition needs none."""
    flags = list(places.place_flags(d).values())
    return flags if len(flags) > 1 else []


def request_rows(staged: DataFrame, d: Definition) -> DataFrame:
    counted = F.lit(False)
    for rule in d.distinct(category_rule):
        counted = counted | is_counted(rule)
    return staged.filter(
        (F.col("facet") == "request")
        & (F.col("level") == d.request_level)
        & (F.col("variable") == "request_count")
        & ~places.left_out_always(d)
        & counted
    ).select(
        "source", "geo_id", "geo_level", "country_code", *_flags(d), "cluster",
        F.col("value").alias("x"),
    )


def request_totals(requests: DataFrame, d: Definition) -> DataFrame:
    """One counter per distinct rule on categories."""
    return requests.groupBy("source", "geo_id").agg(*[
        F.sum(F.when(is_counted(rule), F.col("x"))).alias(name)
        for rule, name in total_names(d).items()
    ])


def with_totals(requests: DataFrame, d: Definition) -> DataFrame:
    """Attach each place's total once; child and parent rows both need it."""
    return join_parent(
        requests, request_totals(requests, d), ["source", "geo_id"], ["cluster"], d.salts
    )


def in_scope(counted: DataFrame, provinces: DataFrame, d: Definition) -> DataFrame:
    """Chat rows of countries, and of those subregions that are listed provinces."""
    enough = F.lit(False)
    for name in total_names(d).values():
        enough = enough | (F.col(name) >= min(d.distinct(lambda d: d.min_request_n)))
    chat = counted.filter(
        (F.col("source") == d.chat_source)
        & enough
        & F.col("geo_level").isin("country", "subregion")
    )
    return (
        mark_in(chat, "geo_id", provinces, "geo_id", "is_province")
        .filter((F.col("geo_level") == "country") | F.col("is_province"))
        .withColumn(
            "parent_id",
            places.country_or_global(F.col("geo_level"), F.col("country_code")),
        )
    )


def paired_with_parent(
    staged: DataFrame, provinces: DataFrame, d: Definition
) -> DataFrame:
    """Rows with their parent's counters, paired once for all versions and only then told apart."""
    counted = with_totals(request_rows(staged, d), d)
    names, above = total_names(d), total_names(d, "parent_")
    # a parent is global or a country, and only chat rows have children
    parents = counted.filter(
        (F.col("source") == d.chat_source) & F.col("geo_level").isin("global", "country")
    ).select(
        "source", F.col("geo_id").alias("parent_id"), "cluster", F.col("x").alias("parent_x"),
        *[F.col(names[rule]).alias(above[rule]) for rule in names],
        *[F.col(flag).alias(f"parent_{flag}") for flag in _flags(d)],
    )
    paired = join_parent(
        in_scope(counted, provinces, d), parents,
        ["source", "parent_id", "cluster"], ["geo_id"], d.salts, F.col("parent_x") > F.col("x"),
    )
    told_apart = d.tagged(paired)
    if _flags(d):
        told_apart = told_apart.filter(places.kept_place(d) & places.kept_place(d, "parent_"))
    if len(names) > 1:
        told_apart = told_apart.filter(d.choose(category_rule, is_counted))
    own = [c for c in paired.columns if c not in (*names.values(), *above.values())]
    return told_apart.select(
        *d.keys, *own,
        d.choose(category_rule, lambda rule: F.col(names[rule])).alias("n"),
        d.choose(category_rule, lambda rule: F.col(above[rule])).alias("parent_n"),
    ).filter(
        (F.col("n") >= d.choose(lambda d: d.min_request_n, F.lit))
        & (F.col("parent_n") > F.col("n"))
    )


def request_mix(
    staged: DataFrame, provinces: DataFrame, lens: DataFrame, d: Definition
) -> DataFrame:
    x, n, x_rest, n_rest = F.col("x"), F.col("n"), F.col("x_rest"), F.col("n_rest")
    gap_x, gap_n = stats.rest_of_parent(F.col("parent_x"), x, F.col("parent_n"), n)
    z = d.choose(lambda d: d.z_mix, F.lit)

    def bound(part: int) -> Column:
        return d.choose(lambda d: d.mix_two_sample, lambda two: stats.log_ratio_ci(
            F.col("lq"), x, n, x_rest, n_rest, z, two
        )[part])

    scored = (
        paired_with_parent(staged, provinces, d)
        .filter(x >= d.choose(lambda d: d.min_category, F.lit))
        .withColumn("x_rest", d.choose(
            lambda d: d.mix_rest_excludes_self,
            lambda own: gap_x if own else F.col("parent_x"),
        ))
        .withColumn("n_rest", gap_n)
        .withColumn("lq", stats.location_quotient(x, n, x_rest, n_rest))
        .select(
            *d.keys, "source", "geo_id", "parent_id", "cluster", "x", "n",
            stats.ratio(x, n).alias("share"), "x_rest", "n_rest",
            stats.ratio(x_rest, n_rest).alias("share_rest"), "lq",
            bound(0).alias("lq_lo"), bound(1).alias("lq_hi"),
        )
    )
    columns = [*scored.columns, "is_finance_lens"]
    return mark_in(scored, "cluster", lens, "cluster", "is_finance_lens").select(*columns)
