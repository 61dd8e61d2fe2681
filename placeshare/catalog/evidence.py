"""Reconciliation, invariants, drill-downs, defects, figures' verification and the gate."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeshare.catalog.checks import CHECKS_SQL
from placeshare.catalog.core import query
from placeshare.catalog.report import BRIEF
from placeshare.catalog.tables import gate, order_files, planted, published_digests
from placeshare.plans.pipeline import run_pipeline
from placeshare.quality import defects
from placeshare.quality.checks import run_checks
from placeshare.quality.investigate import rollup_report
from placeshare.quality.invariants import INVARIANTS, check_invariants
from placeshare.quality.reconcile import (
    normalize_frame, reconcile_all, reconcile_metric, reconcile_summary,
)
from placeshare.report.figures import brief_facts, figure_verification
from placeshare.sources import orders, sinks
from placeshare.sources.facts import source_row_counts
from placeshare.sources.manifest import source_manifest
from placeshare.sources.storage import new_path

query("normalize_frame", """
    select geo_id, cluster, x, case when is_finance_lens then 1e0 else 0e0 end as is_finance_lens
    from m_request_mix
""", "x is_finance_lens")(
    lambda t: normalize_frame(
        t.metrics["request_mix"].select("geo_id", "cluster", "x", "is_finance_lens")
    )
)


def _tampered(t):
    """Global rows lost, and one more hit in every country."""
    shares = t.metrics["shares"].filter(F.col("geo_level") != "global")
    return shares.withColumn(
        "x", F.when(F.col("geo_level") == "country", F.col("x") + 1).otherwise(F.col("x"))
    )


query("reconcile_metric", """
    select 'shares' as metric,
           'source=' || source || '|geo_id=' || geo_id || '|metric=' || metric as key,
           case when geo_level = 'country' then 'x' end as "column",
           case when geo_level = 'country' then x + 1e0 end as sut_value,
           case when geo_level = 'country' then x end as ref_value,
           null::varchar as sut_text, null::varchar as ref_text,
           case when geo_level = 'country' then 'value_mismatch' else 'row_missing_in_sql' end
             as kind
    from m_shares where geo_level in ('country', 'global')
""", "sut_value ref_value")(
    lambda t: reconcile_metric("shares", _tampered(t), t.metrics["shares"])
)

query("reconcile_all", """
    select metric, geo_id as key, '' as "column", 0e0 as sut_value, 0e0 as ref_value,
           '' as sut_text, '' as ref_text, '' as kind from m_shares where false
""")(lambda t: reconcile_all(*t.results))

SIZES = " union all ".join(
    f"""select '{name}' as metric, count(*) as rows_sql, count(*) as rows_reference,
        {width} * count(*) as cells_compared, 0::bigint as mismatches, 'match' as status
        from m_{name}"""
    for name, width in (
        ("geo_usage", 8), ("shares", 7), ("vs_rest", 10), ("request_mix", 11),
        ("platform_gap", 7), ("function_exposure", 8),
    )
)
query("reconcile_summary", SIZES)(lambda t: reconcile_summary(*t.results))

UNCLASSIFIED = "geo_id in ('NONE', 'not_classified') or ends_with(geo_id, '-not_classified')"
PROPERTIES = {
    "shares_within_unit_range": "select bool_and(share between 0 and 1) from m_shares",
    "share_inside_its_interval":
        "select bool_and(lo <= share + 1e-12 and share <= hi + 1e-12) from m_shares",
    "numerator_within_denominator": "select bool_and(x <= n) from m_shares",
    "index_positive_and_inside_its_band": """select bool_and(usage_index > 0
        and usage_index between usage_index_lo and usage_index_hi) from m_geo_usage""",
    "weighted_mean_index_is_one": """select bool_and(abs(w - 1) <= 1e-5) from (
        select sum(usage_index * population) / sum(population) as w from m_geo_usage
        group by geo_level)""",
    "known_usage_shares_within_one": """select bool_and(k <= 1 + 1e-9) from (
        select sum(share_of_known) as k from m_geo_usage group by geo_level)""",
    "rest_share_within_unit_range": "select bool_and(share_rest between 0 and 1) from m_vs_rest",
    "place_and_rest_rebuild_parent": """select bool_and(coalesce(
        abs((v.x + v.x_rest) / (v.n + v.n_rest) - s.share) <= 1e-9, false))
        from m_vs_rest v left join m_shares s on s.source = v.source and s.metric = v.metric
          and s.geo_id = v.parent_id""",
    "difference_inside_its_interval":
        "select bool_and(diff_lo <= diff + 1e-12 and diff <= diff_hi + 1e-12) from m_vs_rest",
    "quotient_positive_and_inside_its_band":
        "select bool_and(lq > 0 and lq_lo <= lq + 1e-12 and lq <= lq_hi + 1e-12) from m_request_mix",
    "category_meets_minimum": "select bool_and(x >= 30) from m_request_mix",
    "category_shares_within_one": """select bool_and(k <= 1 + 1e-9) from (
        select sum(share) as k from m_request_mix group by geo_id)""",
    "gap_is_api_minus_chat": """select bool_and(abs(diff - (api_share - chat_share)) <= 1e-8
        and diff between diff_lo and diff_hi) from m_platform_gap""",
    "exposure_in_range": """select bool_and(mean_exposure between 0 and 1
        and share_with_exposure between 0 and 1 and median_exposure <= max_exposure + 1e-12)
        from m_function_exposure""",
    "occupations_all_counted": """select sum(occupations) = (select count(*) from occupations)
        from m_function_exposure""",
    "ranks_start_at_one": "select min(rank_by_mean) = 1 from m_function_exposure",
    "no_unclassified_place": f"""select (select count(*) from m_geo_usage where {UNCLASSIFIED})
        + (select count(*) from m_shares where {UNCLASSIFIED})
        + (select count(*) from m_request_mix where {UNCLASSIFIED}) = 0""",
    "indexed_places_are_known":
        "select bool_and(geo_id in (select geo_id from names)) from m_geo_usage",
}


def _property_sql(name: str) -> str:
    text = INVARIANTS[name].replace("'", "''")
    return f"""
        select '{name}' as invariant, holds as passed,
               case when holds then '' else '{text}' end as detail
        from (select coalesce(({PROPERTIES[name]}), true) as holds)
    """


VERDICTS = " union all ".join(_property_sql(name) for name in PROPERTIES)
query("check_invariants", VERDICTS)(lambda t: check_invariants(t.results[0], t.inputs, t.d))

query("rollup_report", "select * from gaps where gap <> 0",
      "country_count subregion_sum gap territory_sum unexplained")(
    lambda t: rollup_report(t.facts, t.inputs.territories, t.d)
)


def _corpus(t):
    return defects.Corpus("order data", t.inputs, t.d, t.results[1])


query("defect_run")(lambda t: defects.defect_run(_corpus(t), *defects.DEFECTS))

query("defect_suite")(planted)


@query("override_sql", """
    select source, geo_id, metric, n from m_shares where n >= 1000
""", "n")
def override(t):
    from placeshare.plans.registry import build_metrics

    changed = t.d.replace(min_share_n=1000)
    return build_metrics(t.inputs, changed, ["shares"])["shares"].select(
        "source", "geo_id", "metric", "n"
    )


@query("defect_report", """
    with off as (
        select 'M06' as defect, 'geo_usage' as metric, 'geo_id=' || geo_id as key, 'per_100k' as "column",
               conversations * 1e6 / population as sut_value, conversations * 1e5 / population as ref_value
        from m_geo_usage
        union all
        select 'M21', 'platform_gap', 'metric=' || metric, 'diff', -diff, diff from m_platform_gap where diff <> 0
    ),
    ranked as (
        select *, 1e2 * (sut_value - ref_value) / abs(ref_value) as error_pct from off
    ),
    metrics as (select unnest(['geo_usage', 'shares', 'vs_rest', 'request_mix', 'platform_gap', 'function_exposure']) as metric),
    reports as (select unnest(['M06', 'M21']) as defect)
    select defect, 'cells' as part, metric, "column", count(*)::double as number from off group by all
    union all select distinct defect, 'moved', metric, null, null::double from off
    union all select defect, 'unmoved', m.metric, null, null from metrics m, reports r
        where not exists (from off where off.defect = r.defect and off.metric = m.metric)
    union all select distinct 'M21', 'broken', 'gap_is_api_minus_chat', null, null::double from m_platform_gap
        where abs(diff) > 1e-8
    union all (
        select defect, 'largest', metric, "column", error_pct from (
            select *, row_number() over (partition by defect order by abs(error_pct) desc, metric, key, "column") as r from ranked)
        where r <= 8
    )
""", "number")
def defect_reports(t):
    """Two defects in full: cells by column, the largest errors, metrics that moved or did not, invariants that they break."""
    none = F.lit(None)
    parts = []
    for name in ("M06", "M21"):
        report = defects.defect_report(_corpus(t), name)
        for part, frame, metric, column, number in (
            ("cells", report.cells, "metric", F.col("column"), F.col("cells")),
            ("moved", report.moved, "metric", none, none), ("unmoved", report.unmoved, "metric", none, none),
            ("broken", report.newly_broken, "invariant", none, none),
            ("largest", report.largest, "metric", F.col("column"), F.col("error_pct")),
        ):
            parts.append(frame.select(
                F.lit(name).alias("defect"), F.lit(part).alias("part"), F.col(metric).alias("metric"),
                column.cast("string").alias("column"), number.cast("double").alias("number"),
            ))
    return reduce(DataFrame.unionAll, parts)


def verification(t):
    return figure_verification(
        *[brief_facts(side, t.names, t.d) for side in t.results]
    )


query("figure_verification", f"""
    select label, value, value as ref_value, text, text as ref_text,
           coalesce(value = value, true) and coalesce(text = text, true) as match from ({BRIEF})
""", "value ref_value")(verification)

def _gate_sql(published: str) -> str:
    return f"""
    select *, sources_match_published_checksums and reconciled and figures_verified
              and invariants = invariants_passed and checks = checks_passed as all_gates_passed
    from (
        select {published} as sources_match_published_checksums,
               (select cast(sum(cells_compared) as bigint) from ({SIZES})) as cells_compared,
               true as reconciled,
               (select count(*) from ({VERDICTS})) as invariants,
               (select count(*) filter (where passed) from ({VERDICTS})) as invariants_passed,
               (select count(*) from ({CHECKS_SQL})) as checks,
               (select count(*) filter (where passed) from ({CHECKS_SQL})) as checks_passed,
               {len(defects.DEFECTS)}::bigint as defects, {len(defects.DEFECTS)}::bigint as defects_killed,
               (select count(*) from ({BRIEF})) as figures, true as figures_verified
    )
"""
query("run_gate", _gate_sql("false"))(gate)


@query("write_summary", _gate_sql("false"))
def write_summary(t):
    out = new_path(t.spark, "artifacts")
    summary, folder = gate(t), sinks.new_run(out)
    sinks.write_summary(summary, folder)
    sinks.publish(t.spark, out, folder)
    last = sinks.published(t.spark, out)
    return sinks.read_table(t.spark, f"{last}/qa/summary", summary.schema, "json")


NO_NUMBER, NO_FLAG = "cast(null as double)", "cast(null as boolean)"
QA = {  # artifact: key, number and flag of each of its rows
    "rollup_gaps": ("parent", "gap", NO_FLAG),
    "checks": ("check", "value", "passed"),
    "invariants": ("invariant", NO_NUMBER, "passed"),
    "figures": ("label", "value", "match"),
    "reconciliation": ("metric", "cells_compared", "status = 'match'"),
    "issues": ("key", "sut_value", NO_FLAG),
    "source_rows": ("source", "rows", NO_FLAG),
    "defects": ("id", "length(name)", "killed"),
}
DEFECT_ROWS = " union all ".join(
    f"select '{d.id}' as id, {len(d.name)} as n" for d in defects.DEFECTS
)


@query("write_qa", f"""
    select 'rollup_gaps' as artifact, parent as key, gap as number, null::boolean as flag from gaps where gap <> 0
    union all select 'checks', "check", value, passed from ({CHECKS_SQL})
    union all select 'invariants', invariant, null, passed from ({VERDICTS})
    union all select 'figures', label, value, coalesce(value = value, text = text, true) from ({BRIEF})
    union all select 'reconciliation', metric, cells_compared, rows_sql = rows_reference from ({SIZES})
    union all select 'source_rows', source, count(*), null from facts group by source
    union all select 'defects', id, n, n > 0 from ({DEFECT_ROWS})
""", "number")
def write_qa(t):
    """All evidence tables, written, published and read back."""
    out = new_path(t.spark, "artifacts")
    first, second = t.results
    issues = reconcile_all(first, second)
    frames = {
        "rollup_gaps": rollup_report(t.facts, t.inputs.territories, t.d),
        "checks": run_checks(t.inputs, t.d),
        "invariants": check_invariants(first, t.inputs, t.d),
        "figures": verification(t),
        "reconciliation": reconcile_summary(first, second, issues),
        "issues": issues,
        "source_rows": source_row_counts(t.facts),
        "defects": planted(t),
    }
    folder = sinks.new_run(out)
    sinks.write_qa(frames, folder)
    sinks.publish(t.spark, out, folder)
    last = sinks.published(t.spark, out)
    return reduce(DataFrame.unionAll, [
        sinks.read_table(t.spark, f"{last}/qa/{name}", frames[name].schema).selectExpr(
            f"'{name}' as artifact", f"{key} as key", f"cast({number} as double) as number", f"{flag} as flag"
        ) for name, (key, number, flag) in QA.items()
    ])


@query("run_pipeline", _gate_sql("true"))
def pipeline(t):
    """Everything, with all defects and artifacts; the summary is read back from the artifacts."""
    manifest = source_manifest(t.spark, order_files(t), published_digests(t))
    out = new_path(t.spark, "artifacts")
    run = run_pipeline(orders.order_inputs(t.spark, t.sf_dir), t.d, manifest, out)
    last = sinks.published(t.spark, out)
    return sinks.read_table(t.spark, f"{last}/qa/summary", run.summary.schema, "json")
