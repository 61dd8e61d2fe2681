"""The staged facts and the six metrics."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeshare.catalog.core import query
from placeshare.plans.registry import METRICS

query("stg_facts", "select * from stg", "value")(lambda t: t.staged)

query(
    "m_geo_usage", "select * from m_geo_usage",
    "conversations share_of_known per_100k usage_index usage_index_lo usage_index_hi",
)(lambda t: t.metrics["geo_usage"])

query("m_shares", "select * from m_shares", "x n share lo hi")(lambda t: t.metrics["shares"])

query(
    "m_vs_rest", "select * from m_vs_rest",
    "x n share x_rest n_rest share_rest diff diff_lo diff_hi",
)(lambda t: t.metrics["vs_rest"])

query(
    "m_request_mix", "select * from m_request_mix",
    "x n share x_rest n_rest share_rest lq lq_lo lq_hi",
)(lambda t: t.metrics["request_mix"])

query(
    "m_platform_gap", "select * from m_platform_gap",
    "chat_share chat_n api_share api_n diff diff_lo diff_hi",
)(lambda t: t.metrics["platform_gap"])

query(
    "m_function_exposure", "select * from m_function_exposure",
    "mean_exposure median_exposure share_with_exposure max_exposure",
)(lambda t: t.metrics["function_exposure"])


ESTIMATES = """
    select 'geo_usage' as metric, geo_id as key, usage_index as estimate from m_geo_usage
    union all select 'shares', source || '|' || geo_id || '|' || metric, share from m_shares
    union all select 'vs_rest', source || '|' || geo_id || '|' || metric, diff from m_vs_rest
    union all select 'request_mix', source || '|' || geo_id || '|' || cluster, lq from m_request_mix
    union all select 'platform_gap', metric, diff from m_platform_gap
    union all select 'function_exposure', soc_group, mean_exposure from m_function_exposure
"""


def estimates(metrics):
    """(metric, key, estimate): the main figure of every row of the six metrics."""
    estimate = {
        "geo_usage": "usage_index", "shares": "share", "vs_rest": "diff", "request_mix": "lq",
        "platform_gap": "diff", "function_exposure": "mean_exposure",
    }
    return reduce(DataFrame.unionByName, [
        df.select(
            F.lit(name).alias("metric"), F.concat_ws("|", *METRICS[name].keys).alias("key"),
            F.col(estimate[name]).alias("estimate"),
        )
        for name, df in metrics.items()
    ])


query("metrics_all", ESTIMATES, "estimate")(lambda t: estimates(t.metrics))
