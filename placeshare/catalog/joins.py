"""Every join shape of the metrics and checks."""

from pyspark.sql import functions as F

from placeshare.catalog.core import query
from placeshare.operators import geo_usage, platform_gap, request_mix, vs_rest
from placeshare.operators.joins import mark_in
from placeshare.quality import checks, investigate
from placeshare.quality.invariants import rebuilt_parents
from placeshare.report.figures import with_names
from placeshare.sources.dimensions import dim_country


def _usage(t):
    return geo_usage.usage_rows(t.staged, t.d)


def _requests(t):
    return request_mix.request_rows(t.staged, t.d)


query("j_usage_country", """
    select geo_id, conversations, population from visit_use join dim_country on iso2 = geo_id
    where geo_level = 'country'
""", "conversations")(
    lambda t: _usage(t).filter(F.col("geo_level") == "country").join(
        t.inputs.countries, F.col("iso2") == F.col("geo_id")
    ).select("geo_id", "conversations", "population")
)

query("j_usage_province", """
    select geo_id, conversations, population from visit_use join dim_province using (geo_id)
    where geo_level = 'subregion'
""", "conversations")(
    lambda t: _usage(t).filter(F.col("geo_level") == "subregion").join(
        t.inputs.provinces, "geo_id"
    ).select("geo_id", "conversations", "population")
)

@query("j_known_totals", """
    select u.geo_id, u.conversations, k.known from visit_use u
    join (select 'country' as geo_level, sum(conversations) as known from visit_use
          where geo_level = 'country'
          union all
          select 'subregion', sum(conversations) from visit_use join dim_province using (geo_id)
          where geo_level = 'subregion') k using (geo_level)
""", "conversations known")
def j_known_totals(t):
    candidates = geo_usage.peer_candidates(
        t.staged, t.inputs.countries, t.inputs.provinces, t.d
    )
    totals = geo_usage.pool_totals(candidates)
    return candidates.join(totals, "geo_level").select(
        "geo_id", "conversations", F.col("known_conversations").alias("known")
    )


query("j_child_parent", """
    select c.source, c.metric, c.geo_id, p.geo_id as parent_id, p.x as parent_x, p.n as parent_n
    from m_shares c, m_shares p
    where p.source = c.source and p.metric = c.metric and c.geo_level <> 'global'
      and p.geo_id = case c.geo_level when 'country' then 'GLOBAL' else c.country_code end
""", "parent_x parent_n")(
    lambda t: vs_rest.with_parent(t.metrics["shares"], t.d).select(
        "source", "metric", "geo_id", "parent_id", "parent_x", "parent_n"
    )
)

query("j_req_total", "select source, geo_id, cluster, x, n from req_n", "x n")(
    lambda t: request_mix.with_totals(_requests(t), t.d).select(
        "source", "geo_id", "cluster", "x", "n"
    )
)

REQ_PAIR = """
    select s.geo_id, s.cluster, g.{what} as parent from req_n s
    join req_n g on g.source = s.source and g.cluster = s.cluster
      and g.geo_id = case s.geo_level when 'country' then 'GLOBAL' else s.country_code end
    where s.source = 'chat' and s.n >= 200 and g.x > s.x and g.n > s.n and (s.geo_level = 'country'
        or (s.geo_level = 'subregion' and s.geo_id in (select geo_id from dim_province)))
"""
for name, what, column in (
    ("j_req_parent", "x", "parent_x"), ("j_req_parent_total", "n", "parent_n")
):
    query(name, REQ_PAIR.format(what=what), "parent")(
        lambda t, column=column: request_mix.paired_with_parent(
            t.staged, t.inputs.provinces, t.d
        ).select("geo_id", "cluster", F.col(column).alias("parent"))
    )

query("j_semi_province", """
    select u.geo_id, u.conversations from visit_use u
    where exists (select 1 from dim_province p where p.geo_id = u.geo_id)
""", "conversations")(
    lambda t: _usage(t).join(t.inputs.provinces, "geo_id", "left_semi").select(
        "geo_id", "conversations"
    )
)

query("j_mark_lens", """
    select geo_id, count(*) filter (where cluster in (select cluster from lens)) as listed,
           count(*) filter (where cluster not in (select cluster from lens)) as unlisted
    from req group by geo_id
""")(
    lambda t: mark_in(_requests(t), "cluster", t.inputs.lens, "cluster", "hit")
    .groupBy("geo_id").agg(
        F.count_if("hit").alias("listed"), F.count_if(~F.col("hit")).alias("unlisted")
    )
)

query("j_platform", """
    select metric, a.share as chat_share, a.n as chat_n, b.share as api_share, b.n as api_n
    from m_shares a join m_shares b using (metric)
    where a.geo_id = 'GLOBAL' and b.geo_id = 'GLOBAL' and a.source = 'chat' and b.source = 'api'
""", "chat_share chat_n api_share api_n")(
    lambda t: platform_gap.both_sources(t.metrics["shares"], t.d)
)

query("j_soc", """
    select o.occ_code, g.name from occupations o
    join dim_occupation_group g on g.soc_group = left(o.occ_code, 2)
""")(
    lambda t: t.inputs.occupations.withColumn("soc_group", F.left("occ_code", F.lit(2))).join(
        t.inputs.occupation_groups, "soc_group"
    ).select("occ_code", "name")
)

query("j_using_5", """
    with c as (select source, geo_id, facet, level, cluster_name, value as n from facts
               where variable = facet || '_count' and facet in
                 ('use_case', 'collaboration', 'task_success', 'request')),
    t as (select source, geo_id, facet, level, sum(n) as total from c group by all),
    p as (select source, geo_id, facet, level, cluster_name, value as pct from facts
          where variable = facet || '_pct' and facet in
                 ('use_case', 'collaboration', 'task_success', 'request'))
    select * from c join t using (source, geo_id, facet, level)
    join p using (source, geo_id, facet, level, cluster_name)
""", "n total pct")(lambda t: checks.count_pct_pairs(t.facts, t.d))

query("j_rollup", "select parent, subregion_sum, country_count, territory_sum from gaps",
      "subregion_sum country_count territory_sum")(
    lambda t: investigate.rollup_gaps(t.facts, t.inputs.territories, t.d).select(
        "parent", "subregion_sum", "country_count", "territory_sum"
    )
)

query("j_territory", """
    select cc as parent, listed as territories, t as territory_sum from terr_use
""", "territory_sum")(
    lambda t: investigate.territory_sums(t.facts, t.inputs.territories, t.d)
)

# nothing is unknown in the full tables, so the anti joins look against a table with one row less
query("j_anti_country", """
    select distinct geo_id from facts where geography = 'country'
      and geo_id not in ('NONE', 'not_classified')
      and geo_id not in (select iso2 from dim_country where country <> 'NATION_5')
""")(
    lambda t: checks.unknown_places(
        t.facts, t.inputs.countries.filter(F.col("country") != "NATION_5"), t.d
    ).filter(F.col("geography") == "country").select("geo_id")
)

query("j_anti_prefix", """
    select distinct geo_id from facts where geography = 'country-state'
      and split_part(geo_id, '-', 1) not in
        (select iso2 from dim_country where country <> 'NATION_5')
""")(
    lambda t: checks.unknown_places(
        t.facts, t.inputs.countries.filter(F.col("country") != "NATION_5"), t.d
    ).filter(F.col("geography") == "country-state").select("geo_id")
)

query("j_anti_lens", """
    select name as cluster from dim_occupation_group where name not in
      (select cluster_name from facts where source = 'chat' and geo_id = 'GLOBAL'
       and facet = 'request' and level = 2 and variable = 'request_count')
""")(
    lambda t: checks.unknown_lens_clusters(
        t.facts, t.inputs.occupation_groups.select(F.col("name").alias("cluster")), t.d
    )
)

query("j_pop_missing", """
    select geo_id, value, population from facts join dim_country on iso2 = geo_id
    where source = 'chat' and geography = 'country' and facet = 'country'
      and variable = 'usage_count' and value >= 200 and population is null
""", "value")(
    lambda t: checks.countries_lacking_population(t.facts, t.inputs.countries, t.d)
)

@query("j_full_outer", """
    select metric, c.geo_id is not null as in_countries, g.geo_id is not null as in_subregions,
           count(*) as pairs
    from (select distinct metric, country_code as geo_id from m_shares
          where geo_level = 'country') c
    full join (select distinct metric, country_code as geo_id from m_shares
               where geo_level = 'subregion') g using (metric, geo_id)
    group by all
""")
def j_full_outer(t):
    def side(level, mark):
        return t.metrics["shares"].filter(F.col("geo_level") == level).select(
            "metric", F.col("country_code").alias("geo_id"), F.lit(True).alias(mark)
        ).distinct()

    joined = side("country", "in_countries").join(
        side("subregion", "in_subregions"), ["metric", "geo_id"], "full"
    )
    return joined.groupBy(
        "metric",
        F.coalesce("in_countries", F.lit(False)).alias("in_countries"),
        F.coalesce("in_subregions", F.lit(False)).alias("in_subregions"),
    ).agg(F.count(F.lit(1)).alias("pairs"))


query("j_inv_parent", """
    select v.source, v.geo_id, v.metric, (v.x + v.x_rest) / (v.n + v.n_rest) as rebuilt,
           s.share as parent_share
    from m_vs_rest v left join m_shares s
      on s.source = v.source and s.metric = v.metric and s.geo_id = v.parent_id
""", "rebuilt parent_share")(
    lambda t: rebuilt_parents(t.metrics["vs_rest"], t.metrics["shares"]).select(
        "source", "geo_id", "metric", "rebuilt", "parent_share"
    )
)

query("j_wb_left", "select iso2, population from dim_country")(
    lambda t: dim_country(
        t.inputs.countries, t.inputs.countries.filter(F.col("population").isNotNull())
    ).select("iso2", "population")
)

query("j_map_lookup", """
    select distinct geo_id, coalesce(place_name, geo_id) as name
    from m_shares left join named on named_id = geo_id
""")(
    lambda t: with_names(t.metrics["shares"].select("geo_id").distinct(), t.names).select(
        "geo_id", "name"
    )
)
