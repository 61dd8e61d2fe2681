"""Scalar and statistical functions over whole tables."""

from pyspark.sql import functions as F

from placeshare.catalog.core import query
from placeshare.functions import places, stats
from placeshare.operators import geo_usage, vs_rest

query("fn_string", """
    select distinct geo_id, split_part(geo_id, '-', 1) as prefix, left(geo_id, 2) as head,
           starts_with(geo_id, 'N0') as is_low, ends_with(geo_id, '-not_classified') as is_open,
           contains(geo_id, '-') as is_sub, 'source=' || source || '|geo_id=' || geo_id as key
    from facts
""")(
    lambda t: t.facts.select("source", "geo_id").distinct().select(
        "geo_id", places.place_prefix(F.col("geo_id")).alias("prefix"),
        F.left("geo_id", F.lit(2)).alias("head"), F.startswith("geo_id", F.lit("N0")).alias("is_low"),
        F.endswith("geo_id", F.lit("-not_classified")).alias("is_open"),
        F.contains("geo_id", F.lit("-")).alias("is_sub"),
        F.concat_ws("|", places.key_text("source", F.col("source"), False),
                    places.key_text("geo_id", F.col("geo_id"), False)).alias("key"),
    )
)

query("fn_math", """
    select source, geo_id, facet, cluster_name, sqrt(value) as root, ln(value) as log,
           exp(-value / 1e6) as decay, abs(value - 50e0) as distance, round(value / 3e0, 1) as shown
    from facts where variable = facet || '_count' and value > 0
""", "root log decay distance shown")(
    lambda t: t.facts.filter(
        places.is_count_of_facet(F.col("facet"), F.col("variable")) & (F.col("value") > 0)
    ).select(
        "source", "geo_id", "facet", "cluster_name", F.sqrt("value").alias("root"),
        F.ln("value").alias("log"), F.exp(-F.col("value") / 1e6).alias("decay"),
        F.abs(F.col("value") - 50.0).alias("distance"), F.round(F.col("value") / 3.0, 1).alias("shown"),
    )
)

query("fn_conditional", """
    select geo_id, coalesce(cluster_name, '') as cluster, coalesce(nullif(value, 0e0), 0e0) as value,
           case when value < 15 then 'small' when value < 200 then 'some' else 'many' end as size
    from facts
""", "value")(
    lambda t: t.facts.select(
        "geo_id", places.cluster_or_blank(F.col("cluster_name")).alias("cluster"),
        F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)).alias("value"),
        F.when(F.col("value") < 15, "small").when(F.col("value") < 200, "some")
        .otherwise("many").alias("size"),
    )
)

query("fn_date", """
    select source, geo_id, variable, cluster_name, date_end - date_start as days,
           date_start = cast('2026-02-05' as date) as starts_on_time from facts
""")(
    lambda t: t.facts.select(
        "source", "geo_id", "variable", "cluster_name",
        F.datediff("date_end", "date_start").cast("long").alias("days"),
        (F.col("date_start") == F.lit("2026-02-05").cast("date")).alias("starts_on_time"),
    )
)

query("fn_cast", """
    select source, geo_id, variable, cluster_name, cast(round_even(value, 0) as bigint) as whole,
           cast(level as varchar) as level_text, cast(level as double) as level_number from facts
""", "level_number")(
    lambda t: t.facts.select(
        "source", "geo_id", "variable", "cluster_name",
        F.bround("value").cast("long").alias("whole"),
        F.col("level").cast("string").alias("level_text"),
        F.col("level").cast("double").alias("level_number"),
    )
)

query("fn_compare", """
    select source, geo_id, metric,
           abs(x / n - share) <= 1e-9 + 1e-9 * abs(share) as same,
           abs(lo - share) <= 1e-9 + 1e-9 * abs(share) as degenerate from m_shares
""")(
    lambda t: t.metrics["shares"].select(
        "source", "geo_id", "metric",
        stats.is_close(F.col("x") / F.col("n"), F.col("share"), 1e-9, 1e-9).alias("same"),
        stats.is_close(F.col("lo"), F.col("share"), 1e-9, 1e-9).alias("degenerate"),
    )
)

WILSON = """
    select source, geo_id, metric, (p + 3.8416e0 / (2 * n) {sign} 1.96e0 * sqrt(p * (1 - p) / n
        + 3.8416e0 / (4 * n * n))) / (1 + 3.8416e0 / n) as bound
    from (select *, x / n as p from m_shares)
"""


def _wilson(t, name):
    stats.register_sql_functions(t.spark, t.d.z_wilson)
    return t.spark.sql(
        f"select source, geo_id, metric, {name}(x, n) as bound from {{shares}}",
        shares=t.metrics["shares"],
    )


query("wilson_lo", WILSON.format(sign="-"), "bound")(lambda t: _wilson(t, "wilson_lo"))
query("wilson_hi", WILSON.format(sign="+"), "bound")(lambda t: _wilson(t, "wilson_hi"))


@query("wald_diff_ci", """
    select a.geo_id, a.metric, a.share - b.share as diff,
           a.share - b.share - 1.96e0 * sqrt(a.share * (1 - a.share) / a.n
             + b.share * (1 - b.share) / b.n) as lo,
           a.share - b.share + 1.96e0 * sqrt(a.share * (1 - a.share) / a.n
             + b.share * (1 - b.share) / b.n) as hi
    from m_shares a join m_shares b on b.source = a.source and b.metric = a.metric
      and b.geo_id = case a.geo_level when 'country' then 'GLOBAL' else a.country_code end
    where a.geo_level <> 'global'
""", "diff lo hi")
def wald_diff_ci(t):
    pairs = vs_rest.with_parent(t.metrics["shares"], t.d)
    diff, low, high = stats.wald_diff_ci(
        F.col("share"), F.col("n"), stats.ratio(F.col("parent_x"), F.col("parent_n")),
        F.col("parent_n"), t.d.z_rest,
    )
    return pairs.select(
        "geo_id", "metric", diff.alias("diff"), low.alias("lo"), high.alias("hi")
    )


@query("log_ratio_ci", """
    select geo_id, cluster, exp(ln(lq) - half) as lo, exp(ln(lq) + half) as hi from (
        select *, 1.96e0 * sqrt(1e0 / x - 1e0 / n + 1e0 / x_rest - 1e0 / n_rest) as half
        from m_request_mix)
""", "lo hi")
def log_ratio_ci(t):
    low, high = stats.log_ratio_ci(
        F.col("lq"), F.col("x"), F.col("n"), F.col("x_rest"), F.col("n_rest"), t.d.z_mix
    )
    return t.metrics["request_mix"].select(
        "geo_id", "cluster", low.alias("lo"), high.alias("hi")
    )


query("location_quotient", """
    select geo_id, cluster, (x * n_rest) / (n * x_rest) as quotient from m_request_mix
""", "quotient")(
    lambda t: t.metrics["request_mix"].select(
        "geo_id", "cluster",
        stats.location_quotient(
            F.col("x"), F.col("n"), F.col("x_rest"), F.col("n_rest")
        ).alias("quotient"),
    )
)


def _pooled(t):
    candidates = geo_usage.peer_candidates(
        t.staged, t.inputs.countries, t.inputs.provinces, t.d
    )
    return candidates.filter("in_pool").join(geo_usage.pool_totals(candidates), "geo_level")


query("usage_index", "select geo_id, usage_index from m_geo_usage", "usage_index")(
    lambda t: _pooled(t).select("geo_id", stats.usage_index(
        F.col("conversations"), F.col("population"), F.col("pool_conversations"),
        F.col("pool_population"),
    ).alias("usage_index"))
)


@query("poisson_band", """
    select geo_id, usage_index * (1 - 1.96e0 / sqrt(conversations)) as lo,
           usage_index * (1 + 1.96e0 / sqrt(conversations)) as hi from m_geo_usage
""", "lo hi")
def poisson_band(t):
    low, high = stats.poisson_band(F.col("usage_index"), F.col("conversations"), t.d.z_index)
    return t.metrics["geo_usage"].select("geo_id", low.alias("lo"), high.alias("hi"))


query("per_100k", """
    select geo_id, conversations * 1e5 / population as per_100k from visit_use
    join dim_country on iso2 = geo_id where population > 0
""", "per_100k")(
    lambda t: geo_usage.usage_rows(t.staged, t.d).join(
        t.inputs.countries.select(F.col("iso2").alias("geo_id"), "population"), "geo_id"
    ).filter(F.col("population") > 0).select("geo_id", stats.per_residents(
        F.col("conversations"), F.col("population"), t.d.per_capita_base
    ).alias("per_100k"))
)

query("share_of_known", "select geo_id, share_of_known from m_geo_usage", "share_of_known")(
    lambda t: _pooled(t).select(
        "geo_id",
        stats.ratio(F.col("conversations"), F.col("known_conversations")).alias("share_of_known"),
    )
)


@query("rest_of_parent", """
    select c.geo_id, c.metric, p.x - c.x as x_rest, p.n - c.n as n_rest
    from m_shares c join m_shares p on p.source = c.source and p.metric = c.metric
      and p.geo_id = case c.geo_level when 'country' then 'GLOBAL' else c.country_code end
    where c.geo_level <> 'global'
""", "x_rest n_rest")
def rest_of_parent(t):
    x_rest, n_rest = stats.rest_of_parent(
        F.col("parent_x"), F.col("x"), F.col("parent_n"), F.col("n")
    )
    return vs_rest.with_parent(t.metrics["shares"], t.d).select(
        "geo_id", "metric", x_rest.alias("x_rest"), n_rest.alias("n_rest")
    )


query("relative_error_pct", """
    select geo_id, metric, case when share_rest <> 0 then
        100e0 * (share - share_rest) / abs(share_rest) end as error_pct from m_vs_rest
""", "error_pct")(
    lambda t: t.metrics["vs_rest"].select(
        "geo_id", "metric",
        stats.relative_error_pct(F.col("share"), F.col("share_rest")).alias("error_pct"),
    )
)
