"""Windows, sorts, top-k and set operations."""

from pyspark.sql import functions as F

from placeshare.catalog.core import query
from placeshare.functions import places
from placeshare.operators import function_exposure, geo_usage
from placeshare.operators.numbering import number_rows
from placeshare.operators.platform_gap import both_sources
from placeshare.quality.investigate import largest_errors, rollup_report
from placeshare.quality.reconcile import reconcile_metric
from placeshare.report import figures, views
from placeshare.sources.facts import union_sources

@query("w_pool_sum", """
    select geo_id, geo_level, sum(conversations) over (partition by geo_level) as pool_conversations,
           cast(sum(population) over (partition by geo_level) as bigint) as pool_population
    from m_geo_usage
""", "pool_conversations")
def w_pool_sum(t):
    candidates = geo_usage.peer_candidates(
        t.staged, t.inputs.countries, t.inputs.provinces, t.d
    )
    return candidates.filter("in_pool").join(
        geo_usage.pool_totals(candidates), "geo_level"
    ).select("geo_id", "geo_level", "pool_conversations", "pool_population")


query("w_row_number", """
    select occ_code, row_number() over (partition by left(occ_code, 2)
               order by observed_exposure desc nulls last, title) as pos
    from occupations
""")(
    lambda t: number_rows(
        t.inputs.occupations.withColumn("soc_group", places.occupation_group(F.col("occ_code"))),
        [(F.col("observed_exposure"), True), (F.col("title"), False)], ["soc_group"],
        {"row_number": "pos"},
    ).select("occ_code", "pos")
)

query("w_occupation_ranks", """
    select occ_code, row_number() over (order by observed_exposure desc nulls last, title) as pos,
           rank() over (order by observed_exposure desc nulls last) as score_rank,
           dense_rank() over (order by observed_exposure desc nulls last) as score_dense_rank
    from occupations
""")(
    lambda t: number_rows(
        number_rows(
            t.inputs.occupations, [(F.col("observed_exposure"), True), (F.col("title"), False)],
            names={"row_number": "pos"},
        ),
        [(F.col("observed_exposure"), True)],
        names={"rank": "score_rank", "dense_rank": "score_dense_rank"},
    ).select("occ_code", "pos", "score_rank", "score_dense_rank")
)


def _by_mean(t, kind: str):
    """Ranks over the rounded means, as tied means may differ in the last bits."""
    rounded = F.round("mean_exposure", function_exposure.RANK_DIGITS)
    exposure = t.metrics["function_exposure"].select("soc_group", "mean_exposure")
    return number_rows(exposure, [(rounded, True)], names={kind: "rank_by_mean"}).select(
        "soc_group", F.col("rank_by_mean").cast("int").alias("rank_by_mean")
    )


query("w_rank", "select soc_group, rank_by_mean from m_function_exposure")(
    lambda t: _by_mean(t, "rank")
)

query("w_dense_rank", """
    select soc_group, cast(dense_rank() over (order by round(mean_exposure, 12) desc) as integer)
        as rank_by_mean from m_function_exposure
""")(
    lambda t: _by_mean(t, "dense_rank")
)

query("w_position", """
    select pos as focus_rank from (
        select geo_id, row_number() over (order by usage_index desc, geo_id) as pos
        from m_geo_usage where geo_level = 'country') where geo_id = 'N03'
""")(lambda t: figures.focus_rank(t.metrics["geo_usage"], t.d))

query("s_by_key", """
    select source, geo_id, metric, n from m_shares order by source, geo_id, metric
""", "n")(
    lambda t: t.metrics["shares"].select("source", "geo_id", "metric", "n").orderBy(
        "source", "geo_id", "metric"
    )
)

query("s_rollup", "select parent, gap from gaps where gap <> 0 order by parent", "gap")(
    lambda t: rollup_report(t.facts, t.inputs.territories, t.d).select("parent", "gap").orderBy(
        "parent"
    )
)


@query("t_top_errors", """
    select 'geo_usage' as metric, 'geo_id=' || geo_id as key, 'conversations' as "column",
           conversations + 10e0 as sut_value, conversations as ref_value,
           100e0 * 10e0 / conversations as error_pct
    from m_geo_usage order by error_pct desc, key limit 8
""", "sut_value ref_value error_pct")
def t_top_errors(t):
    usage = t.metrics["geo_usage"]
    off = usage.withColumn("conversations", F.col("conversations") + 10)
    return largest_errors(reconcile_metric("geo_usage", off, usage), 8)


query("t_best_worst", """
    select geo_level, first(geo_id order by usage_index desc, geo_id) as best,
           first(geo_id order by usage_index, geo_id) as worst,
           max(usage_index) / min(usage_index) as spread
    from m_geo_usage group by geo_level
""", "spread")(
    lambda t: t.metrics["geo_usage"].groupBy("geo_level").agg(
        F.min_by("geo_id", F.struct(-F.col("usage_index"), F.col("geo_id"))).alias("best"),
        F.min_by("geo_id", F.struct("usage_index", "geo_id")).alias("worst"),
        (F.max("usage_index") / F.min("usage_index")).alias("spread"),
    )
)

query("t_top_significant", """
    select geo_id,
           coalesce(first(cluster order by lq desc, cluster) filter (where lq_lo > 1), 'none')
             as top_over,
           coalesce(first(cluster order by lq, cluster) filter (where lq_hi < 1), 'none')
             as top_under
    from m_request_mix group by geo_id
""")(
    lambda t: t.metrics["request_mix"].groupBy("geo_id").agg(
        F.coalesce(
            F.min_by("cluster", F.when(
                F.col("lq_lo") > 1, F.struct((-F.col("lq")).alias("q"), F.col("cluster")))),
            F.lit("none"),
        ).alias("top_over"),
        F.coalesce(
            F.min_by("cluster", F.when(
                F.col("lq_hi") < 1, F.struct(F.col("lq").alias("q"), F.col("cluster")))),
            F.lit("none"),
        ).alias("top_under"),
    )
)

query("t_top_n_pinned", """
    select geo_id, usage_index from (
        select *, row_number() over (order by usage_index desc, geo_id) as pos
        from m_geo_usage where geo_level = 'country') where pos <= 10 or geo_id = 'N03'
""", "usage_index")(
    lambda t: views.top_n_pinned(t.metrics["geo_usage"], 10, t.d).select("geo_id", "usage_index")
)

query("s_custom_order", """
    select geo_id, metric, share, case metric when 'work_share' then 1 when 'coursework_share' then 2
        when 'automation_share' then 3 else 4 end as position
    from m_shares where source = 'chat'
""", "share")(
    lambda t: t.metrics["shares"].filter(F.col("source") == t.d.chat_source).select(
        "geo_id", "metric", "share",
        views.metric_position(F.col("metric")).cast("int").alias("position"),
    ).orderBy("geo_id", "position")
)

query("s_focus_first", """
    select distinct geo_id, coalesce(place_name, geo_id) as name from m_vs_rest
    left join named on named_id = geo_id
""")(lambda t: views.focus_first(t.metrics["vs_rest"], t.names, t.d))

query("u_union_all", """
    select geo_id, 'count' as kind, value from facts where variable = 'usage_count'
    union all
    select geo_id, 'pct', value from facts where variable = 'usage_pct'
""", "value")(
    lambda t: union_sources([
        t.facts.filter(F.col("variable") == f"usage_{kind}").select(
            "geo_id", F.lit(kind).alias("kind"), "value"
        )
        for kind in ("count", "pct")
    ])
)

query("u_concat_fill", "select * from names")(lambda t: t.names)

query("u_intersect_keys", """
    select metric from m_shares where geo_id = 'GLOBAL' and source = 'chat'
    intersect select metric from m_shares where geo_id = 'GLOBAL' and source = 'api'
""")(lambda t: both_sources(t.metrics["shares"], t.d).select("metric"))

query("u_difference", """
    select distinct geo_id from m_shares except select distinct geo_id from m_geo_usage
""")(
    lambda t: t.metrics["shares"].select("geo_id").distinct().join(
        t.metrics["geo_usage"].select("geo_id"), "geo_id", "left_anti"
    )
)

def _outside(t, name):
    unknown = t.metrics[name].join(t.names, "geo_id", "left_anti")
    return unknown.select(F.lit(name).alias("name"))


@query("u_subset", """
    select (select count(*) from m_geo_usage where geo_id not in (select geo_id from names)) = 0
             as usage_is_known,
           (select count(*) from m_shares where geo_id not in (select geo_id from names)) = 0
             as shares_are_known
""")
def u_subset(t):
    return union_sources([_outside(t, name) for name in ("geo_usage", "shares")]).agg(
        (F.count_if(F.col("name") == "geo_usage") == 0).alias("usage_is_known"),
        (F.count_if(F.col("name") == "shares") == 0).alias("shares_are_known"),
    )
