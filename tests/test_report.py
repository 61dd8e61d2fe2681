import pytest
from pyspark.sql import functions as F

from placeshare.plans.registry import build_metrics
from placeshare.report import figures, views


def both(golden, metrics):
    names = figures.geo_names(golden.inputs.countries, golden.inputs.provinces)
    return (
        figures.brief_facts(metrics, names, golden.d),
        figures.brief_facts(golden.reference, names, golden.d),
    )


def test_all_figures_are_verified_on_the_hand_made_data(golden):
    mine, other = both(golden, golden.metrics)
    rows = figures.figure_verification(mine, other).collect()
    assert len(rows) == 53 and all(r.match for r in rows)
    found = {r.label: r.value if r.text is None else r.text for r in rows}
    assert found["countries_in_index"] == 7 and found["top_country"] == "Land CA"
    assert found["best_province"] == "Large" and found["worst_province"] == "Above"
    assert found["focus_work_pct"] == pytest.approx(100 * 1105 / 1840) and found["lens_categories"] == 1
    assert found["top_over_request"] == "finance" and found["lens_over_names"] == "finance"
    assert found["focus_group_top_occupation"] == "Planning Z" and found["focus_group_rank"] == 2


def test_a_defective_metric_is_not_verified(golden):
    changed = build_metrics(golden.inputs, golden.d.replace(automation=("directive",)))
    mine, other = both(golden, changed)
    bad = figures.figure_verification(mine, other).filter("not match").collect()
    assert {r.label for r in bad} >= {"focus_automation_pct", "rest_automation_pct"}


def test_directions(golden):
    row = figures.direction_flags(figures.rest_figures(golden.metrics["vs_rest"], golden.d)).first()
    assert row.work_direction == "higher" and row.coursework_direction == "lower"
    assert row.automation_direction == "less" and row.success_gap_is_clear is False


def test_the_focus_country_is_pinned(golden):
    rows = views.top_n_pinned(golden.metrics["geo_usage"], 1, golden.d.replace(focus_country="S1"))
    assert {r.geo_id for r in rows.collect()} == {"CA", "S1"}


def test_views_are_named_and_ordered(golden):
    names = figures.geo_names(golden.inputs.countries, golden.inputs.provinces)
    rest = views.view_vs_rest(golden.metrics["vs_rest"], names, "CA", golden.d).collect()
    assert [r.label for r in rest] == list(views.METRIC_LABELS.values())
    assert {r.parent for r in rest} == {"the world"}
    gap = views.view_platform_gap(golden.metrics["platform_gap"], golden.d).collect()
    assert [r.label for r in gap] == list(views.METRIC_LABELS.values())
    jobs = views.view_group_occupations(golden.inputs.occupations, "35").collect()
    assert [r.title for r in jobs] == ["Analysis X", "Analysis Z", "Analysis W", "Analysis Y"]
    places = views.focus_first(golden.metrics["vs_rest"], names, golden.d).collect()
    assert places[0].geo_id == "CA"
    mix = views.view_request_mix(golden.metrics["request_mix"], "CA").collect()
    assert [r.lq for r in mix] == sorted(r.lq for r in mix)
    assert views.view_defects(
        golden.inputs.spark.createDataFrame(
            [("M1", "b", True, "x", "y")],
            "id string, bug string, killed boolean, detected_by string, caught_on string",
        )
    ).select(F.col("caught")).first().caught == "yes"
