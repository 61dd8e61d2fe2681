import pytest
from pyspark.sql import functions as F

from placeshare.quality.reconcile import reconcile_all, reconcile_frames, reconcile_metric, reconcile_summary


def test_a_changed_cell_is_found_and_located(golden):
    shares = golden.metrics["shares"]
    hit = (F.col("geo_id") == "CA") & (F.col("metric") == "work_share")
    changed = shares.withColumn("x", F.when(hit, F.col("x") + 1).otherwise(F.col("x")))
    issues = reconcile_all({"shares": changed}, golden.reference).collect()
    assert [(i.metric, i.key, i.column, i.kind) for i in issues] == [
        ("shares", "source=chat|geo_id=CA|metric=work_share", "x", "value_mismatch")
    ]
    assert issues[0].sut_value == issues[0].ref_value + 1


def test_rows_on_one_side_only_are_reported(golden):
    usage = golden.metrics["geo_usage"]
    fewer = usage.filter("geo_id <> 'CA'")
    missing = reconcile_metric("geo_usage", fewer, usage).collect()
    extra = reconcile_metric("geo_usage", usage, fewer).collect()
    assert [(i.kind, i.key, i.column) for i in missing] == [
        ("row_missing_in_sql", "geo_id=CA", None)
    ]
    assert [i.kind for i in extra] == ["row_only_in_sql"]


def test_texts_and_missing_values_are_compared(golden):
    exposure = golden.metrics["function_exposure"]
    first = F.col("soc_group") == "13"
    renamed = exposure.withColumn(
        "most_exposed_occupation", F.when(~first, F.col("most_exposed_occupation"))
    ).withColumn("mean_exposure", F.when(~first, F.col("mean_exposure")))
    issues = reconcile_metric("function_exposure", renamed, exposure).collect()
    assert {i.column for i in issues} == {"most_exposed_occupation", "mean_exposure"}
    text = next(i for i in issues if i.column == "most_exposed_occupation")
    assert (text.sut_text, text.ref_text, text.sut_value) == (None, "Planning Z", None)
    both_missing = reconcile_metric("function_exposure", renamed, renamed)
    assert both_missing.count() == 0


def test_a_difference_within_tolerance_is_no_issue(golden):
    usage = golden.metrics["geo_usage"]
    close = usage.withColumn("per_100k", F.col("per_100k") * (1 + 1e-12))
    off = usage.withColumn("per_100k", F.col("per_100k") * (1 + 1e-6))
    assert reconcile_metric("geo_usage", close, usage).count() == 0
    assert reconcile_metric("geo_usage", off, usage).count() == 10


def test_a_missing_column_is_an_error(golden):
    usage = golden.metrics["geo_usage"]
    with pytest.raises(KeyError):
        reconcile_metric("geo_usage", usage, usage.drop("per_100k"))


def test_the_summary_counts_cells_and_mismatches(golden):
    summary = {r.metric: r for r in reconcile_summary(golden.metrics, golden.reference).collect()}
    assert {r.status for r in summary.values()} == {"match"}
    assert summary["geo_usage"].cells_compared == 10 * 8
    assert summary["platform_gap"].rows_reference == 4


def test_columns_with_odd_names_are_compared(spark):
    left = spark.createDataFrame([(1, 2.0, "x")], ["k", "a|b", "it's"])
    right = spark.createDataFrame([(1, 3.0, "y")], ["k", "a|b", "it's"])
    issues = {r.column: (r.sut_value, r.ref_value, r.sut_text, r.ref_text) for r in reconcile_frames("m", left, right, ["k"]).collect()}
    assert issues == {"a|b": (2.0, 3.0, None, None), "it's": (None, None, "x", "y")}
