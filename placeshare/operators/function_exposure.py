"""Exposure statistics by occupation group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeshare.definition import Definition
from placeshare.functions import stats
from placeshare.functions.places import occupation_group

# tied means may differ in the last bits with the order of addition
RANK_DIGITS = 12


def score_counts(occupations: DataFrame) -> DataFrame:
    """Occupations per (group, score), with the first title: the map-side reduced form.

    Every statistic below is exact on these counters, so a huge group is never sorted, and its
    scores are never held in one buffer beyond its distinct values.
    """
    return occupations.groupBy(
        occupation_group(F.col("occ_code")).alias("soc_group"), "observed_exposure"
    ).agg(F.count(F.lit(1)).alias("k"), F.min("title").alias("first_title"))


def group_stats(occupations: DataFrame, d: Definition) -> DataFrame:
    score, k = F.col("observed_exposure"), F.col("k")

    def mean(condition: Column) -> Column:
        return stats.ratio(
            F.sum(F.when(condition, score * k)), F.sum(F.when(condition, k))
        )

    over_all = mean(score.isNotNull())
    means = {"all": over_all, "exposed": mean(score > 0)}
    medians = {"median": F.percentile(score, F.lit(0.5), k), "mean": over_all}
    counted = [means[kind].alias(f"mean_{kind}") for kind in d.distinct(lambda d: d.mean_over)]
    counted += [medians[kind].alias(f"median_{kind}") for kind in d.distinct(lambda d: d.median)]
    highest_first = F.struct(score.isNull(), -score, F.col("first_title"))
    folded = score_counts(occupations).groupBy("soc_group").agg(
        F.sum(k).alias("occupations"),
        *counted,
        stats.ratio(
            F.sum(F.when(score > 0, k).otherwise(F.lit(0))), F.sum(k)
        ).alias("share_with_exposure"),
        F.max(score).alias("max_exposure"),
        F.min_by("first_title", highest_first).alias("most_exposed_occupation"),
    )
    return d.tagged(folded).select(
        *d.keys, "soc_group", "occupations",
        d.choose(lambda d: d.mean_over, lambda kind: F.col(f"mean_{kind}")).alias("mean_exposure"),
        d.choose(lambda d: d.median, lambda kind: F.col(f"median_{kind}")).alias("median_exposure"),
        "share_with_exposure", "max_exposure", "most_exposed_occupation",
    )


def function_exposure(occupations: DataFrame, groups: DataFrame, d: Definition) -> DataFrame:
    named = groups.select("soc_group", F.col("name").alias("soc_name"))
    # ranks two-character groups: at most a few thousand rows, whatever the occupation count
    by_mean = Window.partitionBy(*d.keys).orderBy(F.round("mean_exposure", RANK_DIGITS).desc())
    rank = d.choose(
        lambda d: d.ranking,
        lambda kind: (F.rank() if kind == "rank" else F.dense_rank()).over(by_mean),
    )
    return group_stats(occupations, d).join(named, "soc_group").select(
        *d.keys, "soc_group", "soc_name", "occupations", "mean_exposure", "median_exposure",
        "share_with_exposure", "max_exposure", "most_exposed_occupation",
        rank.alias("rank_by_mean"),
    )
