"""Both formulations against the known answers, and each rule on both sides of its boundary."""

import pytest

from placeshare.functions.stats import register_sql_functions
from placeshare.plans.registry import METRICS, ordered_metrics
from placeshare.quality import golden as data
from placeshare.quality.reconcile import reconcile_metric


@pytest.mark.parametrize("side", ["metrics", "reference"])
@pytest.mark.parametrize("metric", METRICS)
def test_both_formulations_give_the_known_answers(golden, metric, side):
    frames = getattr(golden, side)
    assert reconcile_metric(metric, frames[metric], golden.expected[metric]).collect() == []


def places(golden, metric):
    return {row.geo_id for row in golden.metrics[metric].select("geo_id").distinct().collect()}


@pytest.mark.parametrize("metric", ["geo_usage", "shares", "request_mix"])
@pytest.mark.parametrize("step, stays", [("below", False), ("at", True), ("above", True)])
def test_minimum_samples_are_inclusive(golden, metric, step, stays):
    country = f"S{list(data.STEPS).index(step)}"
    assert (country in places(golden, metric)) == stays
    if metric == "geo_usage":
        assert (f"CA-{step}" in places(golden, metric)) == stays


@pytest.mark.parametrize("step, stays", [("below", False), ("at", True), ("above", True)])
def test_the_rest_of_the_parent_has_a_minimum(golden, step, stays):
    i = list(data.STEPS).index(step)
    part = golden.metrics["vs_rest"].filter(f"geo_id = 'R{i}-main' and metric = 'work_share'")
    assert part.count() == stays
    if stays:
        row = part.first()
        assert (row.parent_id, row.n_rest) == (f"R{i}", 200 + data.STEPS[step])


@pytest.mark.parametrize("label, step", list(zip(("writing", "finance", "cooking"), data.STEPS)))
def test_categories_have_a_minimum(golden, label, step):
    found = golden.metrics["request_mix"].filter(f"geo_id = 'UN' and cluster = '{label}'").collect()
    assert [row.x for row in found] == ([30 + data.STEPS[step]] if step != "below" else [])


@pytest.mark.parametrize("metric", METRICS)
def test_unclassified_places_reach_no_metric(golden, metric):
    if "geo_id" in golden.metrics[metric].columns:
        assert not [p for p in places(golden, metric) if p == "NONE" or p.endswith("not_classified")]
        assert {p for p in data.usage() if p == "NONE" or p.endswith("not_classified")}


def test_who_is_known_and_who_is_a_peer(golden):
    usage = {row.geo_id: row for row in golden.metrics["geo_usage"].collect()}
    assert "UN" not in usage and "UN" in places(golden, "shares")  # no population
    assert not [p for p in usage if p.startswith("R") and "-" in p]  # parts that no list has
    sizes = data.usage()
    known = sum(n for p, n in sizes.items() if "-" not in p and p not in ("NONE", "not_classified"))
    assert usage["BIG"].share_of_known == pytest.approx(sizes["BIG"] / known)


@pytest.mark.parametrize("metric, facet, left_out", [
    ("work_share", "use_case", ("none",)), ("automation_share", "collaboration", ("none", "not_classified")),
    ("success_rate", "task_success", ("not_classified",)),
])
def test_labels_outside_the_base_are_not_counted(golden, metric, facet, left_out):
    for place in ("GLOBAL", "CA", "BIG"):
        labels = data.counts()["chat", place, facet]
        row = golden.metrics["shares"].filter(f"source = 'chat' and geo_id = '{place}' and metric = '{metric}'").first()
        assert row.n == sum(n for label, n in labels.items() if label not in left_out)
    assert sum(data.counts()["chat", "GLOBAL", facet].get(label, 0) for label in left_out) > 0


def test_three_groups_share_a_rank_and_leave_a_gap(golden):
    rows = golden.metrics["function_exposure"].orderBy("soc_group").collect()
    assert [(row.soc_group, row.rank_by_mean) for row in rows] == [("13", 2), ("21", 2), ("35", 1), ("49", 2), ("55", 5)]
    assert [row.most_exposed_occupation for row in rows if row.soc_group in ("21", "55")] == ["Care Y", "Crafts Y"]


def test_the_registered_wilson_functions_match_the_textbook(spark):
    register_sql_functions(spark)
    row = spark.sql("select wilson_lo(50, 100) as lo, wilson_hi(50, 100) as hi").first()
    assert (round(row.lo, 4), round(row.hi, 4)) == (0.4038, 0.5962)


def test_output_is_ordered_by_a_unique_key(golden):
    assert set(golden.reference) == set(METRICS)
    for name, frame in ordered_metrics(golden.metrics).items():
        keys = [tuple(row) for row in frame.select(*METRICS[name].keys).collect()]
        assert keys == sorted(set(keys))
