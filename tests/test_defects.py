import pytest
from pyspark.sql import functions as F

from placeshare.definition import Definition, UnknownKnobError
from placeshare.plans.registry import affected_metrics
from placeshare.quality.defects import (
    DEFECTS, Defect, defect_report, defect_run, defect_suite, make_corpus, override,
)


def test_a_clean_run_raises_no_alarm(golden):
    nothing = Defect("M00", "nothing", "no defect", {})
    assert defect_run(golden.corpus, nothing).count() == 0


def test_every_defect_is_caught_and_leaves_no_error(golden, spark):
    rows = defect_suite(spark, [golden.corpus], metrics={golden.corpus.name: golden.metrics}
                        ).collect()
    assert len(rows) == 26
    assert [r.id for r in rows if not r.killed] == []
    assert {r.error for r in rows} == {None}
    by_id = {r.id: r for r in rows}
    assert by_id["M25"].metrics_affected == "function_exposure"
    assert by_id["M09"].metrics_affected == "platform_gap, shares, vs_rest"
    assert "invariants" in by_id["M14"].detected_by


def test_every_defect_changes_the_definition_and_some_metric():
    clean = Definition()
    assert len({defect.id for defect in DEFECTS}) == len(DEFECTS) == 26
    for defect in DEFECTS:
        changed = override(clean, defect)
        assert changed != clean and affected_metrics(changed, clean)


def test_unknown_or_idle_changes_are_refused():
    with pytest.raises(UnknownKnobError):
        Definition().replace(no_such_knob=1)
    with pytest.raises(UnknownKnobError):
        Definition().replace(min_share_n=200)


def test_an_error_is_recorded_and_does_not_count_as_caught(golden, spark):
    broken = Defect("E01", "broken", "cannot run", {"z_index": "wide"})
    row = defect_suite(spark, [golden.corpus], [broken]).first()
    assert not row.killed and row.error


def test_the_report_of_one_defect(golden):
    report = defect_report(golden.corpus, "m06")
    assert {(r.metric, r.column, r.cells) for r in report.cells.collect()} == {
        ("geo_usage", "per_100k", 10)
    }
    assert [r.metric for r in report.moved.collect()] == ["geo_usage"]
    assert report.unmoved.count() == 5
    assert report.largest.first().error_pct == pytest.approx(900)
    with pytest.raises(ValueError):
        defect_report(golden.corpus, "M99")


def test_a_report_tells_what_the_defect_breaks_from_what_was_broken(golden):
    odd = golden.inputs.replace(occupations=golden.inputs.occupations.withColumn(
        "observed_exposure", F.col("observed_exposure") + 1
    ))
    report = defect_report(make_corpus("odd", odd, golden.d), "M21")
    assert {r.invariant for r in report.broken.collect()} == {"exposure_in_range", "gap_is_api_minus_chat"}
    assert [r.invariant for r in report.newly_broken.collect()] == ["gap_is_api_minus_chat"]
