"""Named queries against their SQL on the smallest data; ``agreement.py`` runs all of them."""

import threading
from pathlib import Path

import pytest

import __spark_entry__ as entry
from placeshare.catalog import tables
from placeshare.plans import jobs, pipeline
from placeshare.sources import orders
from tests.agreement import connection, disagreement

SF_DIR = "/root/testdata/sf0.001"
SOME = [
    "rollup_facts", "m_geo_usage", "m_shares", "m_vs_rest", "m_platform_gap",
    "m_function_exposure", "scan_facts_csv", "header_contract", "j_using_5", "w_row_number",
    "a_string_agg", "run_checks", "fn_string", "u_subset", "view_countries",
]


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", SOME)
def test_spark_and_sql_agree(spark, con, name):
    assert disagreement(spark, con, name, SF_DIR) is None


def test_what_the_data_breaks_is_not_what_a_defect_breaks(spark, tmp_path):
    for table in Path(SF_DIR).glob("*.parquet"):
        if table.name != "part.parquet":
            (tmp_path / table.name).symlink_to(table)
    parts = spark.read.parquet(f"{SF_DIR}/part.parquet")  # mean exposures above 1
    parts.withColumn("p_size", parts.p_size + 50).write.parquet(str(tmp_path / "part.parquet"))
    con = connection(SF_DIR)
    con.execute(f"create or replace view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    verdicts = con.execute(entry.oracle_sql()["check_invariants"]).fetchall()
    assert [name for name, passed, _ in verdicts if not passed] == ["exposure_in_range"]
    for name in ("check_invariants", "defect_report"):
        assert disagreement(spark, con, name, str(tmp_path)) is None


def test_the_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_counterpart_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) >= 165


def test_the_gate_hashes_files_and_builds_the_hand_made_data_beside_the_counting(spark, monkeypatch):
    together = threading.Barrier(3, timeout=20)

    class Reached(Exception):
        pass

    class Base:
        sf_dir, d = "/none", None

        @property
        def results(self):
            together.wait()
            return {}, {}

    def hand_made(spark):
        together.wait()
        raise Reached

    base = Base()
    base.spark = spark
    monkeypatch.setattr(tables, "published_digests", lambda t: together.wait() and {} or {})
    monkeypatch.setattr(pipeline, "golden_corpus", hand_made)
    with pytest.raises(Reached):
        tables.gate(base)


def test_dimensions_are_written_beside_the_facts(spark):
    together = threading.Barrier(2, timeout=20)
    builders = orders.order_builders(spark, SF_DIR)

    def waiting(name):
        together.wait()
        return builders[name]()

    slow = {name: lambda n=name: waiting(n) for name in ("facts", "occupations")}
    inputs = jobs.materialized_from(spark, {**builders, **slow})
    plain = orders.order_inputs(spark, SF_DIR)
    for name in ("facts", "occupations", "countries"):
        mine, theirs = (sorted(map(str, getattr(side, name).collect())) for side in (inputs, plain))
        assert mine == theirs and mine
