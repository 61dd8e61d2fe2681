from pyspark.sql import functions as F

from placeshare.quality.invariants import INVARIANTS, check_invariants


def failed(golden, **changed):
    verdicts = check_invariants({**golden.metrics, **changed}, golden.inputs, golden.d)
    return {row.invariant: row.detail for row in verdicts.filter("not passed").collect()}


def test_all_hold_on_the_hand_made_data(golden):
    verdicts = check_invariants(golden.metrics, golden.inputs, golden.d).collect()
    assert {v.invariant for v in verdicts} == set(INVARIANTS) and len(verdicts) == 18
    assert all(v.passed and v.detail == "" for v in verdicts)


def test_a_share_above_one(golden):
    shares = golden.metrics["shares"].withColumn("share", F.lit(1.2))
    bad = failed(golden, shares=shares)
    assert bad["shares_within_unit_range"] == INVARIANTS["shares_within_unit_range"]


def test_a_missing_share_counts_as_failed(golden):
    shares = golden.metrics["shares"].withColumn("share", F.lit(None).cast("double"))
    assert "shares_within_unit_range" in failed(golden, shares=shares)


def test_an_index_that_does_not_average_to_one(golden):
    ca = F.col("geo_id") == "CA"
    usage = golden.metrics["geo_usage"].withColumn(
        "usage_index", F.when(ca, F.col("usage_index") * 1.5).otherwise(F.col("usage_index"))
    )
    assert "weighted_mean_index_is_one" in failed(golden, geo_usage=usage)


def test_a_rest_group_that_contains_the_place(golden):
    rest = golden.metrics["vs_rest"].withColumn("x_rest", F.col("x_rest") + F.col("x")).withColumn(
        "n_rest", F.col("n_rest") + F.col("n")
    )
    assert "place_and_rest_rebuild_parent" in failed(golden, vs_rest=rest)


def test_an_unclassified_place(golden):
    shares = golden.metrics["shares"].withColumn(
        "geo_id",
        F.when(F.col("geo_id") == "S1", "S1-not_classified").otherwise(F.col("geo_id")),
    )
    assert "no_unclassified_place" in failed(golden, shares=shares)


def test_a_lost_occupation(golden):
    exposure = golden.metrics["function_exposure"].withColumn(
        "occupations", F.col("occupations") - 1
    )
    assert "occupations_all_counted" in failed(golden, function_exposure=exposure)


def test_an_unknown_place_in_the_index(golden):
    usage = golden.metrics["geo_usage"].withColumn(
        "geo_id", F.when(F.col("geo_id") == "S1", "GX").otherwise(F.col("geo_id"))
    )
    assert set(failed(golden, geo_usage=usage)) == {"indexed_places_are_known"}


def test_verdicts_per_group(golden):
    tagged = {
        name: df.withColumn("defect", F.explode(F.array(F.lit("a"), F.lit("b"))))
        for name, df in golden.metrics.items()
    }
    worse = tagged["request_mix"].withColumn(
        "x", F.when(F.col("defect") == "b", 1.0).otherwise(F.col("x"))
    )
    verdicts = check_invariants(
        {**tagged, "request_mix": worse}, golden.inputs, golden.d, ("defect",)
    ).collect()
    assert len(verdicts) == 36
    assert [(v.defect, v.invariant) for v in verdicts if not v.passed] == [
        ("b", "category_meets_minimum")
    ]
