"""Exact quantiles and the incremental rollup, against plain counting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeshare.operators.incremental import CellStore
from placeshare.operators.quantiles import grouped_quantile
from placeshare.operators.rollup import rollup_facts
from tests.test_rollup import SPEC, sample


@pytest.mark.parametrize("cells, q", [(256, 0.5), (3, 0.5), (4, 0.25), (16, 0.9), (256, 0.0), (256, 1.0)])
def test_quantiles_of_skewed_groups(spark, cells, q):
    rng = random.Random(cells)
    rows = [("hot", rng.choice([rng.random(), 10 ** rng.uniform(-30, 30), -rng.random(), 5.0]), rng.randrange(1, 4)) for _ in range(400)]
    rows += [("even", float(i), 1) for i in range(10)] + [("one", 3.0, 7), ("none", None, 2), ("nan", float("nan"), 2), (None, 2.0, 1), (None, 4.0, 1)]
    rows += [("far", v, 1) for v in (-1.7e308, 1.7e308, 0.0, -0.0, 5e-324)]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    got = {r.g: r.quantile for r in grouped_quantile(df, ["g"], "v", "w", q, cells=cells).collect()}
    want = {}
    for g, v, w in rows:
        want.setdefault(g, []).extend([] if v is None or v != v else [v] * w)
    assert set(got) == set(want)
    for g, values in want.items():
        if not values:
            assert got[g] is None
        else:
            place = (len(values) - 1) * q
            low, high = sorted(values)[int(np.floor(place))], sorted(values)[int(np.ceil(place))]
            assert got[g] == pytest.approx(low + (high - low) * (place - int(place)), rel=1e-12)
    plain = grouped_quantile(df.filter("g = 'even'"), ["g"], "v").first()
    assert plain.quantile == 4.5


def test_no_task_gets_a_hot_group(spark):
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, 'hot', string(id % 500)) as g", "rand(1) as v")
    exact = {r.g: r.m for r in df.groupBy("g").agg(F.expr("median(v)").alias("m")).collect()}
    got = {r.g: r.quantile for r in grouped_quantile(df, ["g"], "v").collect()}
    assert got == pytest.approx(exact, rel=1e-12)


def test_batches_add_up_and_replays_do_nothing(spark, tmp_path):
    df = spark.createDataFrame(
        sample(), "source string, country string, subregion string, tone string, topic string"
    )
    store = CellStore(spark, str(tmp_path / "cells"), SPEC, buckets=8)
    assert store.facts() is None and store.batches() == []
    part = F.pmod(F.xxhash64(*df.columns), F.lit(3))
    columns = ["source", "geo_id", "geography", "facet", "level", "variable", "cluster_name", "value"]
    rows = lambda facts: sorted((tuple(r) for r in facts.select(*columns).collect()), key=str)
    for batch in (0, 1):
        assert store.add(f"b{batch}", df.filter(part == batch))
    half = rows(store.facts())
    assert not store.add("b1", df) and rows(store.facts()) == half
    assert half == rows(rollup_facts(df.filter(part < 2), SPEC))
    assert store.add("nothing", df.limit(0)) and rows(store.facts()) == half
    before = {row["run"]: row["buckets"] for row in store._ledger()}
    one = df.filter((part == 2) & (F.col("source") == "api"))
    assert store.add("api", one)
    touched = store._ledger()[-1]["buckets"]
    assert 0 < len(touched) < 8 and len(before) == 3  # the others stay where they are
    assert store.add("rest", df.filter((part == 2) & (F.col("source") != "api")))
    assert rows(store.facts()) == rows(rollup_facts(df, SPEC))
    # files of a batch that stopped before its row in the ledger are not seen
    df.limit(5).write.parquet(str(tmp_path / "cells" / "cells" / "stopped"))
    assert rows(store.facts()) == rows(rollup_facts(df, SPEC))
