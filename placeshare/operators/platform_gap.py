"""The two sources side by side at the global level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeshare.definition import GLOBAL_ID, Definition
from placeshare.functions import stats


def gap_columns(d: Definition) -> list[str]:
    return [
        "metric", f"{d.chat_source}_share", f"{d.chat_source}_n",
        f"{d.api_source}_share", f"{d.api_source}_n", "diff", "diff_lo", "diff_hi",
    ]


def both_sources(shares: DataFrame, d: Definition) -> DataFrame:
    """One row per metric that both sources have; a fold by key, not a self-join."""
    folded = shares.filter(
        (F.col("geo_id") == GLOBAL_ID) & F.col("source").isin(d.chat_source, d.api_source)
    ).groupBy(*d.keys, "metric").agg(*[
        F.max(F.when(F.col("source") == source, F.col(column))).alias(f"{source}_{column}")
        for source in (d.chat_source, d.api_source)
        for column in ("share", "n")
    ])
    return folded.dropna(subset=[f"{d.chat_source}_n", f"{d.api_source}_n"])


def platform_gap(shares: DataFrame, d: Definition) -> DataFrame:
    chat, api = F.col(f"{d.chat_source}_share"), F.col(f"{d.api_source}_share")
    chat_n, api_n = F.col(f"{d.chat_source}_n"), F.col(f"{d.api_source}_n")
    diff = api - chat
    both = stats.share_variance(chat, chat_n) + stats.share_variance(api, api_n)
    variance = d.choose(
        lambda d: d.gap_two_sample,
        lambda two: both if two else stats.share_variance(chat, chat_n),
    )
    half = d.choose(lambda d: d.z_gap, F.lit) * F.sqrt(variance)
    return both_sources(shares, d).select(
        *d.keys, *gap_columns(d)[:5],
        (diff * d.choose(lambda d: d.gap_sign, F.lit)).alias("diff"),
        (diff - half).alias("diff_lo"),
        (diff + half).alias("diff_hi"),
    )
