"""Aggregations, each over the whole table it names."""

from pyspark.sql import functions as F

from placeshare.catalog.core import query
from placeshare.functions import stats
from placeshare.operators.quantiles import grouped_quantile
from placeshare.operators import function_exposure, geo_usage, request_mix, shares
from placeshare.quality import checks, investigate
from placeshare.quality.reconcile import reconcile_all


def _candidates(t):
    return geo_usage.peer_candidates(t.staged, t.inputs.countries, t.inputs.provinces, t.d)


query("a_sum_total", """
    select geo_level, sum(conversations) as known_conversations from visit_use
    where geo_level = 'country' or geo_id in (select geo_id from dim_province) group by geo_level
""", "known_conversations")(
    lambda t: geo_usage.pool_totals(_candidates(t)).select("geo_level", "known_conversations")
)

query("a_cond_sum", """
    select source, geo_id, geo_level, country_code,
           sum(value) filter (where facet = 'use_case' and cluster <> 'none') as use_case_n,
           sum(value) filter (where facet = 'use_case' and cluster = 'work') as work,
           sum(value) filter (where cluster in ('directive', 'feedback loop')) as automation
    from stg where variable in ('use_case_count', 'collaboration_count', 'task_success_count')
      and not is_unclassified_geo
    group by all
""", "use_case_n work automation")(
    lambda t: shares.label_counts(t.staged, t.d).groupBy(*shares.PLACE).agg(
        shares.conditional_sum("use_case", t.d.use_case_base).alias("use_case_n"),
        shares.conditional_sum("use_case", t.d.work).alias("work"),
        shares.conditional_sum("collaboration", t.d.automation).alias("automation"),
    )
)

query("a_group_total", "select source, geo_id, sum(x) as n from req group by source, geo_id", "n")(
    lambda t: request_mix.request_totals(request_mix.request_rows(t.staged, t.d), t.d)
)

query("a_group_stats", """
    select left(occ_code, 2) as soc_group, count(*) as occupations,
           avg(observed_exposure) as mean_exposure, max(observed_exposure) as max_exposure
    from occupations group by 1
""", "mean_exposure max_exposure")(
    lambda t: function_exposure.group_stats(t.inputs.occupations, t.d).select(
        "soc_group", "occupations", "mean_exposure", "max_exposure"
    )
)

query("a_median", """
    select left(occ_code, 2) as soc_group, median(observed_exposure) as median_exposure
    from occupations group by 1
""", "median_exposure")(
    lambda t: grouped_quantile(
        function_exposure.score_counts(t.inputs.occupations), ["soc_group"], "observed_exposure", "k",
        name="median_exposure",
    )
)

query("a_share_positive", """
    select left(occ_code, 2) as soc_group,
           avg(case when observed_exposure > 0 then 1e0 else 0e0 end) as share_with_exposure
    from occupations group by 1
""", "share_with_exposure")(
    lambda t: function_exposure.group_stats(t.inputs.occupations, t.d).select(
        "soc_group", "share_with_exposure"
    )
)

query("a_arg_max", """
    select soc_group, title as most_exposed_occupation from (
        select left(occ_code, 2) as soc_group, title,
               row_number() over (partition by left(occ_code, 2)
                                  order by observed_exposure desc, title) as pos
        from occupations) where pos = 1
""")(
    lambda t: function_exposure.group_stats(t.inputs.occupations, t.d).select(
        "soc_group", "most_exposed_occupation"
    )
)

query("a_filtered_avg", """
    select left(occ_code, 2) as soc_group,
           avg(observed_exposure) filter (where observed_exposure > 0) as mean_exposure
    from occupations group by 1
""", "mean_exposure")(
    lambda t: function_exposure.group_stats(
        t.inputs.occupations, t.d.replace(mean_over="exposed")
    ).select("soc_group", "mean_exposure")
)

query("a_count_distinct", """
    select source, count(distinct geo_id) as places, count(distinct date_start) as starts,
           count(distinct cluster_name) as labels
    from facts group by source
""")(
    lambda t: t.facts.groupBy("source").agg(
        F.countDistinct("geo_id").alias("places"), F.countDistinct("date_start").alias("starts"),
        F.countDistinct("cluster_name").alias("labels"),
    )
)

query("a_having", """
    select source, geo_id, facet, level, sum(value) as total from facts
    where facet in ('use_case', 'collaboration', 'task_success', 'request')
      and variable = facet || '_pct'
    group by all having abs(sum(value) - 100) <= 0.01
""", "total")(
    lambda t: checks.pct_groups(t.facts).filter(F.abs(F.col("total") - 100) <= 0.01)
)

query("a_group_all", """
    select facet, level, geography, count(*) as cells, sum(value) as total from facts
    where variable = facet || '_count' group by all
""", "total")(
    lambda t: t.facts.filter(F.col("variable") == F.concat("facet", F.lit("_count")))
    .groupBy("facet", "level", "geography")
    .agg(F.count(F.lit(1)).alias("cells"), F.sum("value").alias("total"))
)

query("a_minmax_datediff", """
    select source, min(date_end - date_start) as shortest, max(date_end - date_start) as longest
    from facts group by source
""")(
    lambda t: checks.per_source(t.facts, t.d).select(
        "source", F.col("span_min").cast("long").alias("shortest"),
        F.col("span_max").cast("long").alias("longest"),
    )
)

query("a_scalar_subquery", """
    select (select sum(value) from facts where source = 'chat' and geography = 'country'
            and facet = 'country' and variable = 'usage_count'
            and geo_id in ('NONE', 'not_classified'))
         / (select sum(value) from facts where source = 'chat' and geo_id = 'GLOBAL'
            and facet = 'use_case' and variable = 'use_case_count') as unclassified_share
""", "unclassified_share")(
    lambda t: checks.per_source(t.facts, t.d).agg(
        stats.ratio(F.sum("nowhere"), F.sum("sampled")).alias("unclassified_share")
    )
)

query("a_string_agg", """
    select split_part(geo_id, '-', 1) as parent,
           string_agg(geo_id || '=' || cast(cast(value as bigint) as varchar), ', '
                      order by geo_id) as territories, sum(value) as territory_sum
    from facts where source = 'chat' and geography = 'country' and facet = 'country'
      and variable = 'usage_count' and geo_id in (select iso2 from dim_country)
    group by 1
""", "territory_sum")(
    lambda t: investigate.territory_sums(
        t.facts,
        t.inputs.countries.select(
            F.col("iso2").alias("parent"), F.lit("").alias("subregion"),
            F.col("iso2").alias("territory"),
        ),
        t.d,
    )
)

query("a_weighted_mean", """
    select geo_level, sum(usage_index * population) / sum(population) as mean_index
    from m_geo_usage group by geo_level
""", "mean_index")(
    lambda t: t.metrics["geo_usage"].groupBy("geo_level").agg(
        stats.ratio(
            F.sum(F.col("usage_index") * F.col("population")), F.sum("population")
        ).alias("mean_index")
    )
)

query("a_all_true", """
    select metric, bool_and(share between 0 and 1) as in_range, bool_and(n >= 500) as all_large
    from m_shares group by metric
""")(
    lambda t: t.metrics["shares"].groupBy("metric").agg(
        F.bool_and(F.col("share").between(0, 1)).alias("in_range"),
        F.bool_and(F.col("n") >= 500).alias("all_large"),
    )
)


@query("a_issue_counts", """
    select 'shares' as metric, 'x' as "column", count(*) as cells from m_shares
    where geo_level = 'country'
""")
def a_issue_counts(t):
    tampered = t.metrics["shares"].withColumn(
        "x", F.when(F.col("geo_level") == "country", F.col("x") + 1).otherwise(F.col("x"))
    )
    return investigate.issue_counts(
        reconcile_all({"shares": tampered}, {"shares": t.metrics["shares"]})
    )


@query("a_grouped_quantile", """
    select geo_level, metric, quantile_cont(share, 0.25) as lower, quantile_cont(share, 0.5) as mid,
           quantile_cont(share, 0.75) as upper
    from m_shares group by geo_level, metric
""", "lower mid upper")
def grouped_quantiles(t):
    shares = t.results[0]["shares"]
    parts = [
        grouped_quantile(shares, ["geo_level", "metric"], "share", q=q, name=name)
        for q, name in ((0.25, "lower"), (0.5, "mid"), (0.75, "upper"))
    ]
    return parts[0].join(parts[1], ["geo_level", "metric"]).join(parts[2], ["geo_level", "metric"])


query("a_distinct_rows", """
    select distinct source, geo_id, geo_level, country_code from stg
""")(
    lambda t: t.staged.groupBy("source", "geo_id", "geo_level").agg(
        F.min("country_code").alias("country_code")
    )
)
