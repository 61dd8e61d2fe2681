"""The rollup and the helpers under it, against plain counting on a skewed fixture."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from placeshare.operators.joins import join_parent, mark_in
from placeshare.operators.numbering import number_rows, number_within
from placeshare.operators.rollup import RollupSpec, leaf_counts, rollup_facts

SPEC = RollupSpec(
    facets={"tone": 0, "topic": 2}, place_sources=("chat",),
    platforms={"chat": "Chat", "api": "API"}, date_start="2026-02-05", date_end="2026-02-12",
)


def sample():
    """A third of the records share one place and label; some have no subregion or topic."""
    draw = random.Random(7)
    rows = [("chat", "AA", "AA-1", "plain", "x")] * 400
    for _ in range(800):
        country = draw.choice(["AA", "BB", "not_classified"])
        inside = None if country == "not_classified" else f"{country}-{draw.randint(1, 3)}"
        rows.append((draw.choice(["chat", "api"]), country, inside,
                     draw.choice(["plain", "formal"]), draw.choice(["x", "y", None])))
    return rows


@pytest.fixture(scope="module")
def rolled(spark):
    records = spark.createDataFrame(
        sample(), "source string, country string, subregion string, tone string, topic string"
    )
    return records, rollup_facts(records, SPEC).collect()


def test_counts_and_percentages_match_plain_counting(rolled):
    expected, totals, usage = Counter(), Counter(), Counter()
    for source, country, subregion, *labels in sample():
        places = ["GLOBAL"] + ([country, subregion] if source == "chat" else [])
        for place in filter(None, places):
            usage[source, place] += 1
            for facet, label in zip(("tone", "topic"), labels):
                totals[source, place, facet] += 1
                if label is not None:
                    expected[source, place, facet, label] += 1
    counts = {
        (r.source, r.geo_id, r.facet, r.cluster_name): r.value
        for r in rolled[1] if r.variable in ("tone_count", "topic_count")
    }
    assert counts == {key: float(n) for key, n in expected.items()}
    for r in rolled[1]:
        if r.variable in ("tone_pct", "topic_pct"):
            whole = totals[r.source, r.geo_id, r.facet]
            n = expected[r.source, r.geo_id, r.facet, r.cluster_name]
            assert r.value == pytest.approx(100 * n / whole)
        if r.variable == "usage_count":
            assert r.value == usage[r.source, r.geo_id]
        if r.variable == "usage_pct":
            parent = r.geo_id.split("-")[0] if "-" in r.geo_id else "GLOBAL"
            assert r.value == pytest.approx(100 * usage["chat", r.geo_id] / usage["chat", parent])


def test_sources_without_places_are_global_only(rolled):
    assert {r.geo_id for r in rolled[1] if r.source == "api"} == {"GLOBAL"}
    assert not [r for r in rolled[1] if r.geo_id is None]


def test_the_raw_records_are_aggregated_before_the_shuffle(rolled):
    plan = leaf_counts(rolled[0], SPEC)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_count" in plan


def test_numbering_within_a_hot_group(spark):
    keys = [("hot", k) for k in random.Random(1).sample(range(10_000), 700)]
    keys += [("cold", 5), ("cold", 90), ("cold", 9000)]
    got = number_within(
        spark.createDataFrame(keys, "g string, k long"), "g", "k", "pos", width=64
    ).collect()
    for group in ("hot", "cold"):
        ordered = sorted(k for g, k in keys if g == group)
        assert {r.k: r.pos for r in got if r.g == group} == {
            k: i for i, k in enumerate(ordered, 1)
        }


@pytest.mark.parametrize("broadcast", ["-1", "10MB"])
def test_parent_lookup_with_one_hot_parent(spark, broadcast):
    children = [(f"c{i}", "GLOBAL" if i % 3 else f"p{i % 5}") for i in range(900)]
    parents = [("GLOBAL", 1.0), *[(f"p{i}", 2.0 + i) for i in range(4)]]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        joined = join_parent(
            spark.createDataFrame(children, "id string, parent string"),
            spark.createDataFrame(parents, "parent string, v double"),
            ["parent"], ["id"], 8,
        ).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    value = dict(parents)
    assert sorted((r.id, r.v) for r in joined) == sorted(
        (i, value[p]) for i, p in children if p in value
    )


def test_marking_is_not_multiplied_by_repeated_values(spark):
    values = spark.createDataFrame([("a",), ("a",), (None,)], "label string")
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    marked = mark_in(rows, "k", values, "label", "hit").orderBy(F.asc_nulls_last("k")).collect()
    assert [(r.k, r.hit) for r in marked] == [("a", True), ("b", False), (None, False)]


@pytest.mark.parametrize("ranges", [1, 3, 8, 40])
def test_numbers_over_any_order_with_ties(spark, ranges):
    rng = random.Random(ranges)
    rows = [("hot", rng.choice([1.0, 2.0, 2.0, 3.5, None]), f"t{rng.randrange(30)}", i) for i in range(400)]
    rows += [("tied", 7.0, "same", i) for i in range(150)] + [(None, 1.0, "a", 0), ("one", None, None, 1)]
    df = spark.createDataFrame(rows, "g string, score double, title string, id long")
    names = {"row_number": "pos", "rank": "place", "dense_rank": "dense"}
    for by in (["g"], []):
        order = [(F.col("score"), True), (F.col("title"), False)]
        got = number_rows(df, order, by, names, ranges).collect()
        assert len(got) == len(rows)
        groups = {}
        for r in got:
            groups.setdefault(r.g if by else None, []).append(r)
        for members in groups.values():
            key = lambda r: (r.score is None, -(r.score or 0), r.title is None, r.title or "")
            keys = sorted(map(key, members))
            distinct = sorted(set(keys))
            assert sorted(r.pos for r in members) == list(range(1, len(members) + 1))
            for r in members:
                assert r.place == keys.index(key(r)) + 1 and r.dense == distinct.index(key(r)) + 1
                assert key(r) == keys[r.pos - 1]


def test_numbering_has_no_window_over_a_whole_table(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "id")
    plan = number_rows(df, [(F.col("k"), True)], names={"rank": "r"})._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("__range" in line.split("], [")[1] for line in windows)
    assert number_rows(df.limit(0), [(F.col("k"), True)]).count() == 0
