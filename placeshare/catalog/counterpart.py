"""SQL counterparts: the base tables derived from the order tables, as common table expressions.

Written separately from the Spark jobs: every level is counted from the records themselves, with
window totals, where the jobs roll counters up and join.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from placeshare.plans.sqlmodels import MODELS, render
from placeshare.sources.orders import DEFINITION

TABLES: dict[str, str] = {
    "recs": """
        select case when l.l_suppkey % 4 = 0 then 'api' else 'chat' end as source,
               case when c.c_nationkey = 24 then 'not_classified'
                    else 'N' || lpad(cast(c.c_nationkey as varchar), cast(greatest(2, length(cast(c.c_nationkey as varchar))) as integer), '0') end as country,
               case when c.c_nationkey = 24 then null
                    when c.c_nationkey = 23 then 'N05-N23'
                    when c.c_nationkey = 3 and c.c_mktsegment = 'HOUSEHOLD' then 'N03-not_classified'
                    else 'N' || lpad(cast(c.c_nationkey as varchar), cast(greatest(2, length(cast(c.c_nationkey as varchar))) as integer), '0') || '-' || c.c_mktsegment
               end as subregion,
               case left(o.o_orderpriority, 1) when '1' then 'work' when '2' then 'work'
                    when '3' then 'personal' when '5' then 'coursework' else 'none' end as use_case,
               case l.l_linenumber when 1 then 'directive' when 2 then 'feedback loop'
                    when 3 then 'learning' when 4 then 'task iteration' when 5 then 'validation'
                    when 6 then 'none' when 7 then 'not_classified' end as collaboration,
               case l.l_returnflag when 'A' then 'yes' when 'N' then 'no'
                    else 'not_classified' end as task_success,
               case p.p_brand when 'Brand#25' then 'not_classified' else p.p_brand end as request
        from lineitem l
        join orders o on o.o_orderkey = l.l_orderkey
        join customer c on c.c_custkey = o.o_custkey
        join part p on p.p_partkey = l.l_partkey
    """,
    "visits": """
        select source, 'GLOBAL' as geo_id, 'global' as geography, use_case, collaboration,
               task_success, request from recs
        union all
        select source, country, 'country', use_case, collaboration, task_success, request
        from recs where source = 'chat'
        union all
        select source, subregion, 'country-state', use_case, collaboration, task_success, request
        from recs where source = 'chat' and subregion is not null
    """,
    "tallies": """
        select source, geo_id, geography, 'use_case' as facet, 0 as level, use_case as label,
               cast(count(*) as double) as n from visits group by all
        union all
        select source, geo_id, geography, 'collaboration', 0, collaboration,
               cast(count(*) as double) from visits group by all
        union all
        select source, geo_id, geography, 'task_success', 0, task_success,
               cast(count(*) as double) from visits group by all
        union all
        select source, geo_id, geography, 'request', 2, request,
               cast(count(*) as double) from visits group by all
    """,
    "volumes": """
        select v.source, v.geo_id, v.geography, cast(count(*) as double) as n,
               (select cast(count(*) as double) from visits w where w.source = v.source
                and w.geo_id = case v.geography when 'country' then 'GLOBAL'
                                                else split_part(v.geo_id, '-', 1) end) as whole
        from visits v where v.geography <> 'global' group by v.source, v.geo_id, v.geography
    """,
    "facts": """
        select source, geo_id, geography, date '2026-02-05' as date_start,
               date '2026-02-12' as date_end,
               case source when 'chat' then 'Chat' else 'API' end as platform_and_product,
               facet, level, facet || '_count' as variable, label as cluster_name, n as value
        from tallies
        union all
        select source, geo_id, geography, date '2026-02-05', date '2026-02-12',
               case source when 'chat' then 'Chat' else 'API' end, facet, level, facet || '_pct',
               label, 100e0 * n / sum(n) over (partition by source, geo_id, facet)
        from tallies
        union all
        select source, geo_id, geography, date '2026-02-05', date '2026-02-12', 'Chat', geography,
               0, 'usage_count', null, n from volumes
        union all
        select source, geo_id, geography, date '2026-02-05', date '2026-02-12', 'Chat', geography,
               0, 'usage_pct', null, 100e0 * n / whole from volumes
    """,
    "dim_country": """
        select 'N' || lpad(cast(n_nationkey as varchar), cast(greatest(2, length(cast(n_nationkey as varchar))) as integer), '0') as iso2,
               'XN' || lpad(cast(n_nationkey as varchar), cast(greatest(2, length(cast(n_nationkey as varchar))) as integer), '0') as iso3, n_name as country,
               case when n_nationkey <> 7 then
                 (select 1000 * count(*) from customer where c_nationkey = n_nationkey) end
                 as population,
               'R' || cast(n_regionkey as varchar) as continent
        from nation where n_nationkey <> 24
    """,
    "dim_province": """
        select 'N03-' || c_mktsegment as geo_id, c_mktsegment as name, 1000 * count(*) as population
        from customer where c_nationkey = 3 and c_mktsegment <> 'HOUSEHOLD' group by c_mktsegment
    """,
    "focus_population": """
        select 1000 * count(*) as population
        from customer where c_nationkey = 3 and c_mktsegment <> 'HOUSEHOLD'
    """,
    "occupations": """
        select brand || '-' || lpad(place, cast(greatest(4, length(place)) as integer), '0') as occ_code,
               p_name || ' ' || cast(p_partkey as varchar) as title,
               greatest(p_size - 20, 0) / 30e0 as observed_exposure
        from (
            select *, cast(row_number() over (partition by brand order by p_partkey) as varchar) as place
            from (select *, lpad(replace(p_brand, 'Brand#', ''),
                                 cast(greatest(2, length(replace(p_brand, 'Brand#', ''))) as integer), '0') as brand from part)
        )
    """,
    "dim_occupation_group": """
        select distinct lpad(replace(p_brand, 'Brand#', ''), cast(greatest(2, length(replace(p_brand, 'Brand#', ''))) as integer), '0') as soc_group, p_brand as name
        from part
    """,
    "lens": """
        select distinct p_brand as cluster from part
        where p_brand in ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4')
    """,
    "dim_territory": """
        select 'N05' as parent, 'N05-N23' as subregion, 'N23' as territory
        from nation where n_nationkey = 23
    """,
    "stg": """
        select source, geo_id, case geography when 'country-state' then 'subregion'
                                              else geography end as geo_level,
               case geography when 'country' then geo_id
                              when 'country-state' then split_part(geo_id, '-', 1) end
                 as country_code,
               geo_id = 'NONE' or geo_id = 'not_classified'
                 or suffix(geo_id, '-not_classified') as is_unclassified_geo,
               facet, level, variable, coalesce(cluster_name, '') as cluster, value
        from facts
    """,
    "visit_use": """
        select geo_id, geo_level, value as conversations from stg
        where source = 'chat' and variable = 'usage_count' and not is_unclassified_geo
          and facet in ('country', 'country-state')
    """,
    "req": """
        select source, geo_id, geo_level, country_code, cluster, value as x from stg
        where facet = 'request' and level = 2 and variable = 'request_count'
          and cluster <> 'not_classified' and not is_unclassified_geo
    """,
    "req_n": "select *, sum(x) over (partition by source, geo_id) as n from req",
    "names": """
        select iso2 as geo_id, country as name, iso3, 'country' as level from dim_country
        union all
        select geo_id, name, null, 'subregion' from dim_province
    """,
    "named": "select geo_id as named_id, name as place_name from names",
    **{f"m_{name}": render(model(DEFINITION)) for name, model in MODELS.items()},
    "country_use": """
        select geo_id as cc, value as v from facts where source = 'chat'
          and geography = 'country' and facet = 'country' and variable = 'usage_count'
    """,
    "sub_use": """
        select split_part(geo_id, '-', 1) as cc, sum(value) as s, count(*) as k from facts
        where source = 'chat' and geography = 'country-state' and facet = 'country-state'
          and variable = 'usage_count' group by 1
    """,
    "terr_use": """
        select parent as cc, sum(v) as t,
               string_agg(territory || '=' || cast(cast(v as bigint) as varchar), ', '
                          order by territory) as listed
        from dim_territory join country_use on cc = territory group by parent
    """,
    "gaps": """
        select cc as parent, k as subregions, v as country_count, s as subregion_sum,
               s - v as gap, listed as territories, t as territory_sum,
               (s - v) - coalesce(t, 0) as unexplained
        from sub_use join country_use using (cc) left join terr_use using (cc)
    """,
}


def _needed(text: str, found: list[str]) -> list[str]:
    for name, body in TABLES.items():
        if name not in found and re.search(rf"\b{name}\b", text):
            _needed(body, found)
            if name not in found:
                found.append(name)
    return found


def counterpart(body: str, doubles: Sequence[str], digits: int) -> str:
    """The body with the tables it uses in front, and its doubles rounded."""
    needed = _needed(body, [])
    ctes = ",\n".join(f"{name} as ({TABLES[name].strip()})" for name in needed)
    rounded = ", ".join(f'round("{c}", {digits}) + 0e0 as "{c}"' for c in doubles)
    star = f"* replace ({rounded})" if doubles else "*"
    prefix = f"with {ctes}\n" if ctes else ""
    return f"{prefix}select {star} from ({body.strip()}) as result"
