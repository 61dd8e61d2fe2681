"""Projections, filters and predicates, one rule each, over the whole fact table."""

from pyspark.sql import functions as F

from placeshare.catalog.core import query
from placeshare.functions import places
from placeshare.operators import geo_usage, request_mix, shares, vs_rest
from placeshare.operators.joins import mark_in

PLACE = "source, geo_id, facet, variable, cluster_name"


def _facts(t, name, column):
    return t.facts.select(
        "source", "geo_id", "facet", "variable", "cluster_name", column.alias(name)
    )


query("p_geo_level", f"""
    select {PLACE}, replace(geography, 'country-state', 'subregion') as geo_level from facts
""")(lambda t: _facts(t, "geo_level", places.geo_level(F.col("geography"))))

query("p_country_code", f"""
    select {PLACE}, case when geography <> 'global'
        then regexp_extract(geo_id, '^[^-]*') end as country_code from facts
""")(lambda t: _facts(
    t, "country_code", places.country_code(F.col("geography"), F.col("geo_id"))
))

query("p_unclassified", f"""
    select {PLACE}, geo_id in ('NONE', 'not_classified') or ends_with(geo_id, '-not_classified')
        as is_unclassified_geo from facts
""")(lambda t: _facts(
    t, "is_unclassified_geo", places.is_unclassified(F.col("geo_id"), t.d)
))

query("p_cluster_default", """
    select source, geo_id, facet, variable, case when cluster_name is null then ''
        else cluster_name end as cluster from facts
""")(lambda t: t.facts.select(
    "source", "geo_id", "facet", "variable",
    places.cluster_or_blank(F.col("cluster_name")).alias("cluster"),
))

query("f_usage", "select * from visit_use", "conversations")(
    lambda t: geo_usage.usage_rows(t.staged, t.d)
)

query("f_min_sample", """
    select geo_id, geo_level, conversations from visit_use where conversations >= 200
""", "conversations")(
    lambda t: geo_usage.usage_rows(t.staged, t.d).filter(
        F.col("conversations") >= t.d.min_usage
    )
)

query("f_population", "select iso2, population from dim_country where population > 0")(
    lambda t: t.inputs.countries.filter(F.col("population") > 0).select("iso2", "population")
)

query("f_min_rest", """
    select c.source, c.geo_id, c.metric, p.n - c.n as n_rest from m_shares c
    join m_shares p on p.source = c.source and p.metric = c.metric
      and p.geo_id = case c.geo_level when 'country' then 'GLOBAL' else c.country_code end
    where c.geo_level <> 'global' and p.n - c.n >= 200
""", "n_rest")(
    lambda t: vs_rest.with_parent(t.metrics["shares"], t.d)
    .withColumn("n_rest", F.col("parent_n") - F.col("n"))
    .filter(F.col("n_rest") >= t.d.min_rest)
    .select("source", "geo_id", "metric", "n_rest")
)

query("f_request", "select * from req", "x")(
    lambda t: request_mix.request_rows(t.staged, t.d)
)

query("f_scope_or_semi", """
    select source, geo_id, cluster, x, n,
           case geo_level when 'country' then 'GLOBAL' else country_code end as parent_id
    from req_n where source = 'chat' and n >= 200 and (geo_level = 'country'
        or (geo_level = 'subregion' and geo_id in (select geo_id from dim_province)))
""", "x n")(
    lambda t: request_mix.in_scope(
        request_mix.with_totals(request_mix.request_rows(t.staged, t.d), t.d),
        t.inputs.provinces, t.d,
    ).select("source", "geo_id", "cluster", "x", "n", "parent_id")
)

query("f_strict_parent", """
    select s.geo_id, s.cluster, s.x, g.x as parent_x from req_n s
    join req_n g on g.source = s.source and g.cluster = s.cluster
      and g.geo_id = case s.geo_level when 'country' then 'GLOBAL' else s.country_code end
    where s.source = 'chat' and s.n >= 200 and g.x > s.x and g.n > s.n and (s.geo_level = 'country'
        or (s.geo_level = 'subregion' and s.geo_id in (select geo_id from dim_province)))
""", "x parent_x")(
    lambda t: request_mix.paired_with_parent(t.staged, t.inputs.provinces, t.d).select(
        "geo_id", "cluster", "x", "parent_x"
    )
)

query("f_min_category", "select source, geo_id, cluster, x from req where x >= 30", "x")(
    lambda t: request_mix.request_rows(t.staged, t.d)
    .filter(F.col("x") >= t.d.min_category).select("source", "geo_id", "cluster", "x")
)

query("f_global_pair", """
    select source, metric, share from m_shares
    where geo_id = 'GLOBAL' and (source = 'chat' or source = 'api')
""", "share")(
    lambda t: t.metrics["shares"].filter(
        (F.col("geo_id") == "GLOBAL") & F.col("source").isin(t.d.chat_source, t.d.api_source)
    ).select("source", "metric", "share")
)

query("p_parent_id", """
    select distinct geo_id, case when geo_level = 'country' then 'GLOBAL'
        when geo_level = 'subregion' then country_code end as parent_id
    from stg where geo_level <> 'global'
""")(
    lambda t: t.staged.filter(F.col("geo_level") != "global").select(
        "geo_id",
        places.parent_id(F.col("geo_level"), F.col("country_code"), t.d).alias("parent_id"),
    ).distinct()
)

query("p_soc_group", "select occ_code, left(occ_code, 2) as soc_group from occupations")(
    lambda t: t.inputs.occupations.select(
        "occ_code", places.occupation_group(F.col("occ_code")).alias("soc_group")
    )
)

query("p_mark_lens", """
    select source, geo_id, cluster, cluster in (select cluster from lens) as is_finance_lens
    from req
""")(
    lambda t: mark_in(
        request_mix.request_rows(t.staged, t.d), "cluster", t.inputs.lens, "cluster",
        "is_finance_lens",
    ).select("source", "geo_id", "cluster", "is_finance_lens")
)

query("f_pattern_escape", r"""
    select source, geo_id, facet, variable, value from facts
    where variable like '%\_pct' escape '\' and variable not like '%histogram%'
""", "value")(
    lambda t: t.facts.filter(
        F.col("variable").endswith("_pct") & ~places.is_histogram(F.col("variable"))
    ).select("source", "geo_id", "facet", "variable", "value")
)

query("f_regex", """
    select occ_code, regexp_matches(occ_code, '^[0-9]{2}-[0-9]{4}$') as is_wellformed
    from occupations
""")(
    lambda t: t.inputs.occupations.select(
        "occ_code", F.col("occ_code").rlike("^[0-9]{2}-[0-9]{4}$").alias("is_wellformed")
    )
)

query("f_is_null_any", """
    select facet, count(*) filter (where value is null or geo_id is null or variable is null
        or cluster_name is null) as incomplete from facts group by facet
""")(
    lambda t: t.facts.groupBy("facet").agg(
        F.count_if(places.any_null(
            [F.col(c) for c in ("value", "geo_id", "variable", "cluster_name")]
        )).alias("incomplete")
    )
)

query("f_dynamic_variable", """
    select source, geo_id, facet, cluster_name, value from facts where variable = facet || '_pct'
""", "value")(
    lambda t: t.facts.filter(places.is_pct_of_facet(F.col("facet"), F.col("variable"))).select(
        "source", "geo_id", "facet", "cluster_name", "value"
    )
)

query("p_share_label_counts", """
    select source, geo_id, facet, cluster, value from stg
    where variable in ('use_case_count', 'collaboration_count', 'task_success_count')
      and not is_unclassified_geo
""", "value")(
    lambda t: shares.label_counts(t.staged, t.d).select(
        "source", "geo_id", "facet", "cluster", "value"
    )
)
