import gzip
import hashlib
import os

import pytest

from placeshare.definition import FACT_COLUMNS
from placeshare.inputs import FACT_SCHEMA, typed
from placeshare.sources import dimensions, facts, sinks, storage
from placeshare.sources.manifest import READ_BYTES, source_manifest
from placeshare.sources.storage import shared_dir, written

HEADER = ",".join(FACT_COLUMNS)
ROWS = [
    "NA,country,2026-02-05,2026-02-12,API,country,0,usage_count,,12.0",
    'GLOBAL,global,2026-02-05,2026-02-12,API,request,2,request_count,"a, ""b""",7.5',
]


@pytest.fixture()
def good(tmp_path):
    path = tmp_path / "api.csv"
    path.write_text("\n".join([HEADER, *ROWS]) + "\n")
    return path


def test_a_fact_file_is_scanned_with_its_types(spark, good):
    frame = facts.scan_facts_csv(spark, str(good), "api")
    assert frame.schema.simpleString() == FACT_SCHEMA.simpleString()
    rows = {r.geo_id: r for r in frame.collect()}
    assert rows["NA"].cluster_name is None and rows["NA"].source == "api"
    assert rows["NA"].date_start.isoformat() == "2026-02-05"
    assert rows["GLOBAL"].cluster_name == 'a, "b"' and rows["GLOBAL"].level == 2


@pytest.mark.parametrize("header", [
    HEADER.replace("variable", "metric"), HEADER.replace("geo_id,geography", "geography,geo_id"),
])
def test_another_layout_is_refused_before_any_row_is_read(spark, tmp_path, good, header):
    bad = tmp_path / "changed.csv"
    bad.write_text("\n".join([header, *ROWS]) + "\n")
    with pytest.raises(facts.SchemaError):
        facts.scan_facts_csv(spark, str(bad), "api")
    with pytest.raises(facts.SchemaError):
        facts.scan_facts_csv(spark, [str(good), str(bad)], "api")


def test_files_in_nested_folders_are_checked_with_exact_names(spark, tmp_path):
    folder = tmp_path / "facts"
    nested = folder / "week=1" / "day=2"
    nested.mkdir(parents=True)
    (folder / "_notes").mkdir()
    (folder / "_notes" / "other.csv").write_text("not,facts\n")
    (nested / "good.csv").write_text("\n".join([HEADER, *ROWS]) + "\n")
    assert facts.header_violations(spark, str(folder)) == []
    for name, header in (("renamed.csv", HEADER.replace("variable", "metric")), ("padded.csv", " " + HEADER)):
        (nested / name).write_text("\n".join([header, *ROWS]) + "\n")
    found = facts.header_violations(spark, str(folder))
    assert sorted(file.rsplit("/", 1)[-1] for file, _ in found) == ["padded.csv", "renamed.csv"]


def test_a_malformed_number_fails_the_scan(spark, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_text("\n".join([HEADER, ROWS[0].replace("12.0", "many")]) + "\n")
    with pytest.raises(Exception, match="MALFORMED|BAD|CANNOT"):
        facts.scan_facts_csv(spark, str(bad), "api").collect()


def test_sources_are_loaded_together_or_not_at_all(spark, tmp_path, good):
    both = {"chat": str(good), "api": str(good)}
    loaded = facts.load_facts(spark, both)
    assert {(r.source, r.rows) for r in facts.source_row_counts(loaded).collect()} == {
        ("chat", 2), ("api", 2)
    }
    absent = {**both, "chat": str(tmp_path / "nothing.csv")}
    assert facts.missing_sources(spark, absent) == ["chat"]
    with pytest.raises(FileNotFoundError):
        facts.load_facts(spark, absent)


def test_missing_numbers_become_null(spark):
    row = ("s", "g", "country", None, None, "p", "f", 0, "v", None, float("nan"))
    frame = typed(spark.createDataFrame([row], FACT_SCHEMA), FACT_SCHEMA)
    assert frame.first().value is None


def test_the_country_list_skips_comments_and_takes_short_rows(spark, tmp_path):
    path = tmp_path / "countries.txt"
    fields = ["NA", "NAM", "516", "WA", "Namibia", "Windhoek", "825418", "2448255", "AF"]
    no_population = ["XX", "XXX", "1", "X", "Xland", "", "", "", "EU"] + [""] * 10
    path.write_text(
        "# comment\n#ISO\tISO3\n\n" + "\t".join(fields) + "\n" + "\t".join(no_population) + "\n"
    )
    rows = {r.iso2: r for r in dimensions.scan_geonames_tsv(spark, str(path)).collect()}
    assert set(rows) == {"NA", "XX"}
    assert rows["NA"].country == "Namibia" and rows["NA"].population == 2448255
    assert rows["XX"].population is None and rows["XX"].continent == "EU"


def test_the_published_population_replaces_the_stale_one(spark):
    listed = spark.createDataFrame(
        [("CA", "CAN", "Canada", 1, "NA"), ("TW", "TWN", "Taiwan", 2, "AS")],
        "iso2 string, iso3 string, country string, population long, continent string",
    )
    published = spark.createDataFrame([("CAN", 41)], "iso3 string, population long")
    rows = {r.iso2: r.population for r in dimensions.dim_country(listed, published).collect()}
    assert rows == {"CA": 41, "TW": None}


def test_codes_stay_text(spark, tmp_path):
    path = tmp_path / "groups.csv"
    path.write_text("soc_group,name\n13,Business\n")
    assert dimensions.scan_csv(
        spark, str(path), dimensions.GROUP_SCHEMA).first().soc_group == "13"


def test_the_manifest_compares_digests(spark, good):
    digest = hashlib.sha256(good.read_bytes()).hexdigest()
    row = source_manifest(spark, {"api": str(good)}, {"api": digest}).first()
    assert (row.bytes, row.sha256, row.matches_published_sha256) == (
        good.stat().st_size, digest, True
    )
    assert not source_manifest(spark, {"api": str(good)}, {}).first().matches_published_sha256


def test_stored_bytes_are_digested_in_several_reads(spark, tmp_path):
    packed = tmp_path / "two words.csv.gz"
    packed.write_bytes(gzip.compress(bytes(range(256)) * 40_000, compresslevel=0))
    empty = tmp_path / "empty.csv"
    empty.write_bytes(b"")
    assert packed.stat().st_size > 2 * READ_BYTES
    found = source_manifest(spark, {"a": str(packed), "b": str(empty)}, {}).collect()
    digest = hashlib.sha256(packed.read_bytes()).hexdigest()
    assert sorted(tuple(r) for r in found) == [
        ("a", "two words.csv.gz", packed.stat().st_size, digest, False),
        ("b", "empty.csv", 0, None, False),
    ]


def test_artifacts_are_read_back_and_may_be_absent(spark, golden, tmp_path):
    exposure = golden.metrics["function_exposure"]
    for form in ("parquet", "csv"):
        out = str(tmp_path / form)
        sinks.write_gold({"function_exposure": exposure}, out, form)
        back = sinks.read_gold(
            spark, out, {"function_exposure": exposure.schema, "other": exposure.schema}, form
        )
        assert sorted(back["function_exposure"].collect()) == sorted(exposure.collect())
        assert back["other"] is None


def test_tables_are_written_under_the_shared_folder(spark, golden):
    frame = written(golden.inputs.facts, "facts", ("source", "facet"))
    assert all(shared_dir(spark) in path for path in frame.inputFiles())
    assert sorted(map(str, frame.collect())) == sorted(map(str, golden.inputs.facts.collect()))


def test_codes_stay_whole_above_9999_parts_and_99_brands(spark):
    from placeshare.sources import orders

    parts = spark.range(1, 12_101).selectExpr(
        "id as p_partkey", "concat('part ', id) as p_name", "cast(id % 50 as int) as p_size",
        "concat('Brand#', if(id <= 12000, 7, id - 12000 + 20)) as p_brand",
    )
    codes = orders.occupations({"part": parts}).select("occ_code").collect()
    assert len({r.occ_code for r in codes}) == 12_100
    groups = {r.soc_group for r in orders.occupation_groups({"part": parts}).collect()}
    assert {r.occ_code.split("-")[0] for r in codes} == groups and {"07", "21", "120"} <= groups
    assert {"07-0001", "07-12000", "120-0001"} <= {r.occ_code for r in codes}


def test_a_run_that_stops_leaves_the_tables_of_the_run_before(spark, tmp_path):
    out = str(tmp_path / "artifacts")
    assert sinks.published(spark, out) is None

    def run(value, stops=False):
        folder = sinks.new_run(out)
        sinks.write_gold({"a": spark.sql(f"select {value} as v")}, folder)
        if stops:
            return
        sinks.write_gold({"b": spark.sql(f"select {value} as v")}, folder)
        sinks.publish(spark, out, folder)

    def seen():
        last = sinks.published(spark, out)
        schema = spark.sql("select 1 as v").schema
        return [r.v for df in sinks.read_gold(spark, last, {"a": schema, "b": schema}).values() for r in df.collect()]

    run(1)
    assert seen() == [1, 1]
    run(2, stops=True)
    assert seen() == [1, 1]
    run(3)
    assert seen() == [3, 3]


def test_intermediate_tables_can_be_removed(spark, monkeypatch):
    monkeypatch.setattr(storage, "_written", {})  # leaves those of other tests alone
    table = written(spark.range(5), "some")
    folder = os.path.dirname(os.path.dirname(table.inputFiles()[0])).removeprefix("file:")
    assert table.count() == 5 and os.path.isdir(folder.replace("//", "/"))
    assert storage.remove_intermediate(spark) == 1 and not os.path.exists(folder.replace("//", "/"))
    assert storage.remove_intermediate(spark) == 0
