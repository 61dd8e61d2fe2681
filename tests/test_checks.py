import pytest
from pyspark.sql import functions as F

from placeshare.quality import golden as data
from placeshare.quality.checks import CHECKS, duplicate_keys, key_signature, run_check, run_checks


def value(golden, name, **tables):
    row = run_check(golden.inputs.replace(**tables), golden.d, name).first()
    return row.value, row.passed


def changed(golden, condition, column="value", to=None):
    """The facts with one column replaced where the condition holds."""
    facts = golden.inputs.facts
    return facts.withColumn(column, F.when(F.expr(condition), F.expr(to)).otherwise(F.col(column)))


CA_USE = "geo_id = 'CA' and variable = 'use_case_{}' and cluster_name = 'work'"

# check, condition on the facts, column, new value, value of the check afterwards
CORRUPTIONS = [
    ("null_values", CA_USE.format("count"), "value", "cast(null as double)", 1),
    ("negative_values", CA_USE.format("count"), "value", "-1D", 1),
    ("negative_ci_lower_bounds", CA_USE.format("pct"), "variable", "'x_ci_lower'", 0),
    ("percentages_out_of_range", CA_USE.format("pct"), "value", "150D", 1),
    ("period_is_one_week", CA_USE.format("pct"), "date_end",
     "date '2026-02-20'", 1),
    ("shares_sum_to_100", CA_USE.format("pct"), "value", "value + 5", 1),
    ("counts_agree_with_percentages", CA_USE.format("pct"), "value", "value + 5", 1),
    ("unknown_country_codes", "geo_id = 'S1'", "geo_id", "'ZQ'", 1),
    ("unknown_subregion_parents", "geo_id = 'R1-main'", "geo_id", "'ZQ-A'", 1),
    ("unexplained_rollup_gaps", "geo_id = 'CA-large' and variable = 'usage_count'", "value",
     "value + 7", 1),
    ("documented_rollup_gaps", "geo_id = 'CA-large' and variable = 'usage_count'", "value",
     "value + 7", 1),
]


@pytest.mark.parametrize("case", CORRUPTIONS, ids=lambda case: case[0])
def test_a_corrupted_fact_is_noticed(golden, case):
    name, condition, column, to, after = case
    assert value(golden, name) == (0.0, True)
    found, passed = value(golden, name, facts=changed(golden, condition, column, to))
    assert found == after
    assert passed == (after == 0 or CHECKS[name].severity == "info")


def test_a_negative_lower_bound_is_information_only(golden):
    facts = changed(golden, CA_USE.format("count"), "variable", "'use_case_ci_lower'")
    facts = facts.withColumn(
        "value", F.when(F.col("variable") == "use_case_ci_lower", -1.0).otherwise(F.col("value"))
    )
    assert value(golden, "negative_ci_lower_bounds", facts=facts) == (1.0, True)
    assert value(golden, "negative_values", facts=facts) == (0.0, True)


def test_a_repeated_row(golden):
    facts = golden.inputs.facts
    again = facts.filter("geo_id = 'BIG' and variable = 'usage_count'")
    assert value(golden, "duplicate_keys") == (0.0, True)
    assert value(golden, "duplicate_keys", facts=facts.unionAll(again)) == (1.0, False)


def test_a_missing_source(golden):
    assert value(golden, "both_sources_loaded") == (0.0, True)
    chat = golden.inputs.facts.filter("source = 'chat'")
    assert value(golden, "both_sources_loaded", facts=chat) == (1.0, False)


def test_a_territory_listed_twice_explains_the_gap(golden, spark):
    facts = golden.inputs.facts
    usage = F.col("variable") == "usage_count"
    inside = facts.filter((F.col("geo_id") == "CA-large") & usage)
    country = facts.filter((F.col("geo_id") == "S0") & usage)
    more = (
        facts
        .unionAll(inside.withColumn("geo_id", F.lit("CA-XT")).withColumn("value", F.lit(7.0)))
        .unionAll(country.withColumn("geo_id", F.lit("XT")).withColumn("value", F.lit(7.0)))
    )
    listed = spark.createDataFrame([("CA", "CA-XT", "XT")], golden.inputs.territories.schema)
    tables = {"facts": more, "territories": listed}
    assert value(golden, "documented_rollup_gaps", **tables) == (1.0, True)
    assert value(golden, "unexplained_rollup_gaps", **tables) == (0.0, True)


def small_cells():
    cells = [row[-1] for row in data.fact_rows() if row[-3].endswith("_count")]
    return sum(n < 15 for n in cells) / len(cells)


def test_coverage_values(golden):
    rows = {r.check: r for r in run_checks(golden.inputs, golden.d, ["coverage"]).collect()}
    assert set(rows) == {
        "countries_missing_from_sample_total", "unclassified_geography_share",
        "countries_without_population", "small_count_cells",
    }
    assert rows["countries_missing_from_sample_total"].value == pytest.approx(1 - 11_460 / 60_000)
    assert not rows["countries_missing_from_sample_total"].passed
    assert rows["unclassified_geography_share"].value == pytest.approx(180 / 60_000)
    assert (rows["countries_without_population"].value,
            rows["countries_without_population"].passed) == (1.0, True)
    assert rows["small_count_cells"].value == pytest.approx(small_cells())


def test_nothing_to_divide_is_no_finding(golden):
    empty = golden.inputs.facts.filter("source = 'api'")
    found = value(golden, "countries_missing_from_sample_total", facts=empty)
    assert found == (0.0, True)


def test_an_unknown_lens_category(golden, spark):
    lens = spark.createDataFrame([("finance",), ("no such thing",), (None,)], "cluster string")
    assert value(golden, "finance_lens_clusters_exist") == (0.0, True)
    assert value(golden, "finance_lens_clusters_exist", lens=lens) == (1.0, False)


def test_bad_occupations(golden, spark):
    jobs = golden.inputs.occupations
    bad = spark.createDataFrame(
        [("13-1000", "again", 0.1), ("1-2", "code", 0.1), ("99-0001", "score", 1.7)], jobs.schema
    )
    assert value(golden, "job_exposure_contract") == (0.0, True)
    assert value(golden, "job_exposure_contract", occupations=jobs.unionAll(bad)) == (3.0, False)


def test_a_province_total_that_is_off(golden):
    off = golden.inputs.focus_population.selectExpr("population + 1 as population")
    assert value(golden, "province_population_adds_up") == (0.0, True)
    assert value(golden, "province_population_adds_up", focus_population=off) == (1.0, False)


def test_there_are_twenty_and_only_the_sample_total_fails(golden):
    rows = run_checks(golden.inputs, golden.d).collect()
    assert len(rows) == 20 and {r.check for r in rows} == set(CHECKS)
    assert [r.check for r in rows if not r.passed] == ["countries_missing_from_sample_total"]
    with pytest.raises(ValueError):
        run_checks(golden.inputs, golden.d, ["no such layer"])


def test_signatures_that_collide_are_no_duplicates(golden):
    facts = golden.inputs.facts
    again = facts.unionAll(facts.filter("geo_id in ('BIG', 'S1') and variable = 'usage_count'"))
    for signature in (key_signature, lambda columns: F.lit(1), lambda columns: F.length(columns[1])):
        assert duplicate_keys(facts, signature).first().duplicate_keys == 0
        assert duplicate_keys(again, signature).first().duplicate_keys == 2
    shifted = facts.limit(1).selectExpr(*[f"cast(null as string) as {c}" if c == "facet" else c for c in facts.columns])
    moved = shifted.selectExpr(*[{"facet": "variable", "variable": "cast(null as string)"}.get(c, c) + f" as {c}" for c in facts.columns])
    hashes = shifted.unionAll(moved).select(key_signature([F.col("facet"), F.col("variable")]).alias("h"))
    assert hashes.distinct().count() == 2
