"""Figures and table views for a report."""

from pyspark.sql import functions as F

from placeshare.catalog.core import query
from placeshare.report import figures, views

query("geo_names", "select * from names")(lambda t: t.names)


def _number(label: str, sql: str) -> str:
    return f"select '{label}' as label, cast(({sql}) as double) as value, null::varchar as text"


def _text(label: str, sql: str) -> str:
    return f"select '{label}' as label, null::double as value, cast(({sql}) as varchar) as text"


USE = "m_geo_usage left join named on named_id = geo_id"
COUNTRY, PROVINCE = "geo_level = 'country'", "geo_level = 'subregion'"
FOCUS = "geo_id = 'N03'"


def _top(column: str, where: str, order: str) -> str:
    return f"select {column} from {USE} where {where} order by usage_index {order}, geo_id limit 1"


def _rest(metric: str, column: str) -> str:
    return (f"select 100e0 * {column} from m_vs_rest where source = 'chat' and {FOCUS} "
            f"and metric = '{metric}'")


def _mix(column: str, direction: str) -> str:
    where, order = ("lq_lo > 1", "desc") if direction == "over" else ("lq_hi < 1", "")
    return (f"select {column} from m_request_mix where {FOCUS} and {where} "
            f"order by lq {order}, cluster limit 1")


def _lens(what: str, where: str = "true") -> str:
    return f"select {what} from m_request_mix where {FOCUS} and is_finance_lens and {where}"


def _gap(metric: str, source: str) -> str:
    return f"select 100e0 * {source}_share from m_platform_gap where metric = '{metric}'"


def _group(column: str) -> str:
    return f"select {column} from m_function_exposure where soc_group = '13'"


NAMES = "coalesce(string_agg(cluster, '; ' order by cluster), '')"
FIGURES = [
    _number("countries_in_index", f"select count(*) from m_geo_usage where {COUNTRY}"),
    _number("focus_rank", f"""select pos from (select geo_id, row_number() over
        (order by usage_index desc, geo_id) as pos from m_geo_usage where {COUNTRY})
        where {FOCUS}"""),
    *[_number(label, f"select {column} from m_geo_usage where {FOCUS}") for label, column in (
        ("focus_index", "usage_index"), ("focus_index_lo", "usage_index_lo"),
        ("focus_index_hi", "usage_index_hi"), ("focus_conversations", "conversations"))],
    _text("top_country", _top("place_name", COUNTRY, "desc")),
    _number("top_country_index", _top("usage_index", COUNTRY, "desc")),
    _text("best_province", _top("place_name", PROVINCE, "desc")),
    _number("best_province_index", _top("usage_index", PROVINCE, "desc")),
    _text("worst_province", _top("place_name", PROVINCE, "")),
    _number("worst_province_index", _top("usage_index", PROVINCE, "")),
    _number("worst_province_index_lo", _top("usage_index_lo", PROVINCE, "")),
    _number("worst_province_index_hi", _top("usage_index_hi", PROVINCE, "")),
    _number("province_spread",
            f"select max(usage_index) / min(usage_index) from m_geo_usage where {PROVINCE}"),
    *[_number(label, _rest(metric, column)) for label, metric, column in (
        ("focus_work_pct", "work_share", "share"),
        ("rest_work_pct", "work_share", "share_rest"),
        ("work_gap_points", "work_share", "diff"),
        ("work_gap_points_lo", "work_share", "diff_lo"),
        ("work_gap_points_hi", "work_share", "diff_hi"),
        ("coursework_gap_points", "coursework_share", "diff"),
        ("focus_automation_pct", "automation_share", "share"),
        ("rest_automation_pct", "automation_share", "share_rest"),
        ("focus_success_pct", "success_rate", "share"),
        ("rest_success_pct", "success_rate", "share_rest"),
        ("success_gap_points_lo", "success_rate", "diff_lo"),
        ("success_gap_points_hi", "success_rate", "diff_hi"))],
    *[_text(f"top_{way}_request", f"select coalesce(({_mix('cluster', way)}), 'none')")
      for way in ("over", "under")],
    *[_number(f"{way}_request_{column}", _mix(column, way))
      for way in ("over", "under") for column in ("lq", "lq_lo", "lq_hi")],
    _number("lens_categories", _lens("count(*)")),
    _number("lens_over", _lens("count(*)", "lq_lo > 1")),
    _number("lens_under", _lens("count(*)", "lq_hi < 1")),
    _text("lens_over_names", _lens(NAMES, "lq_lo > 1")),
    _text("lens_under_names", _lens(NAMES, "lq_hi < 1")),
    *[_number(f"global_{source}_{short}_pct", _gap(metric, source))
      for metric, short in (("work_share", "work"), ("automation_share", "automation"),
                            ("success_rate", "success"))
      for source in ("chat", "api")],
    _number("focus_group_rank", _group("rank_by_mean")),
    _number("occupation_groups", "select count(*) from m_function_exposure"),
    _number("focus_group_mean_exposure", _group("mean_exposure")),
    _number("focus_group_exposed_pct", _group("100e0 * share_with_exposure")),
    _text("focus_group_top_occupation", _group("most_exposed_occupation")),
    _number("focus_group_top_exposure", _group("max_exposure")),
    _text("top_group", """select soc_name from m_function_exposure
        order by rank_by_mean, soc_group limit 1"""),
]
BRIEF = " union all ".join(FIGURES)

query("brief_facts", BRIEF, "value")(
    lambda t: figures.brief_facts(t.metrics, t.names, t.d)
)

query("fact_usage", f"select * from ({BRIEF}) where label in ('focus_rank', 'focus_index', "
      "'top_country', 'best_province', 'worst_province', 'province_spread')", "value")(
    lambda t: figures.usage_figures(t.metrics["geo_usage"], t.names, t.d).filter(
        F.col("label").isin("focus_rank", "focus_index", "top_country", "best_province",
                            "worst_province", "province_spread")
    )
)

query("fact_vs_rest", f"select * from ({BRIEF}) where label like '%work_gap%' "
      "or label like 'success_gap%' or label in ('focus_work_pct', 'rest_work_pct', "
      "'focus_automation_pct', 'rest_automation_pct', 'focus_success_pct', 'rest_success_pct', "
      "'coursework_gap_points')", "value")(
    lambda t: figures.rest_figures(t.metrics["vs_rest"], t.d)
)

query("fact_requests", f"select * from ({BRIEF}) where label like '%\\_request%' escape '\\' "
      "or label like 'lens%'", "value")(
    lambda t: figures.request_figures(t.metrics["request_mix"], t.d)
)

query("gap", f"select * from ({BRIEF}) where label like 'global%'", "value")(
    lambda t: figures.gap_figures(t.metrics["platform_gap"], t.d)
)

query("fact_exposure", f"select * from ({BRIEF}) where label like 'focus_group%' "
      "or label in ('occupation_groups', 'top_group')", "value")(
    lambda t: figures.exposure_figures(t.metrics["function_exposure"], t.d)
)

query("top_country", f"select * from ({BRIEF}) where label like 'top_country%'", "value")(
    lambda t: figures.usage_figures(t.metrics["geo_usage"], t.names, t.d).filter(
        F.col("label").startswith("top_country")
    )
)

query("lens_count", f"select * from ({BRIEF}) where label like 'lens%'", "value")(
    lambda t: figures.request_figures(t.metrics["request_mix"], t.d).filter(
        F.col("label").startswith("lens")
    )
)

query("direction_flags", """
    select case when round(100e0 * max(diff) filter (where metric = 'work_share'), 1) < 0
                then 'lower' else 'higher' end as work_direction,
           case when round(100e0 * max(diff) filter (where metric = 'coursework_share'), 1) > 0
                then 'higher' else 'lower' end as coursework_direction,
           case when round(100e0 * max(share) filter (where metric = 'automation_share'), 1)
                   < round(100e0 * max(share_rest) filter (where metric = 'automation_share'), 1)
                then 'less' else 'more' end as automation_direction,
           coalesce(round(100e0 * max(diff_lo) filter (where metric = 'success_rate'), 1) > 0
                 or round(100e0 * max(diff_hi) filter (where metric = 'success_rate'), 1) < 0, false)
             as success_gap_is_clear
    from m_vs_rest where source = 'chat' and geo_id = 'N03'
""")(lambda t: figures.direction_flags(figures.rest_figures(t.metrics["vs_rest"], t.d)))

query("view_countries", f"""
    select geo_id, coalesce(place_name, geo_id) as name, usage_index,
           usage_index_hi - usage_index as error_up, usage_index - usage_index_lo as error_down,
           geo_id = 'N03' as is_focus
    from (select *, row_number() over (order by usage_index desc, geo_id) as pos
          from m_geo_usage where {COUNTRY}) left join named on named_id = geo_id
    where pos <= 15 or geo_id = 'N03'
""", "usage_index error_up error_down")(
    lambda t: views.view_countries(t.metrics["geo_usage"], t.names, 15, t.d)
)

query("view_provinces", f"""
    select geo_id, coalesce(place_name, geo_id) as name, conversations, population,
           share_of_known, per_100k, usage_index
    from {USE} where {PROVINCE}
""", "conversations share_of_known per_100k usage_index")(
    lambda t: views.view_provinces(t.metrics["geo_usage"], t.names)
)

LABEL = """case metric when 'work_share' then 'Use at work' when 'coursework_share'
    then 'Use for studies' when 'automation_share' then 'Handed over whole'
    else 'Rated a success' end as label"""

query("view_vs_rest", f"""
    select {LABEL}, 'the world' as parent, 100e0 * share as share_pct,
           100e0 * share_rest as rest_pct, 100e0 * diff as diff_points,
           100e0 * (diff_hi - diff) as error_up, 100e0 * (diff - diff_lo) as error_down, n, n_rest
    from m_vs_rest where source = 'chat' and geo_id = 'N03'
""", "share_pct rest_pct diff_points error_up error_down n n_rest")(
    lambda t: views.view_vs_rest(t.metrics["vs_rest"], t.names, t.d.focus_country, t.d)
)

query("view_request_mix", """
    select cluster, lq, lq_hi - lq as error_up, lq - lq_lo as error_down,
           100e0 * share as share_pct, 100e0 * share_rest as rest_pct, is_finance_lens
    from m_request_mix where geo_id = 'N03'
""", "lq error_up error_down share_pct rest_pct")(
    lambda t: views.view_request_mix(t.metrics["request_mix"], t.d.focus_country)
)

query("view_platform_gap", f"""
    select {LABEL}, 100e0 * chat_share as chat_share, 100e0 * api_share as api_share,
           100e0 * diff as diff, 100e0 * diff_lo as diff_lo, 100e0 * diff_hi as diff_hi
    from m_platform_gap
""", "chat_share api_share diff diff_lo diff_hi")(
    lambda t: views.view_platform_gap(t.metrics["platform_gap"], t.d)
)

query("view_group_occupations", """
    select * from occupations where starts_with(occ_code, '13-')
""", "observed_exposure")(
    lambda t: views.view_group_occupations(t.inputs.occupations, t.d.focus_group)
)


@query("view_defects")
def view_defects(t):
    from placeshare.catalog.tables import planted

    return views.view_defects(planted(t))
