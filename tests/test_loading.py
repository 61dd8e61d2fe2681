import dataclasses
import hashlib
import json

import pytest

from placeshare.__main__ import main
from placeshare.definition import FACT_COLUMNS
from placeshare.inputs import SCHEMAS
from placeshare.plans.pipeline import run_from_files
from placeshare.sources import sinks
from placeshare.sources.loading import ReferenceFiles, load_inputs, load_reference

REFERENCE = ("occupation_groups", "occupations", "lens", "territories")


@pytest.fixture(scope="module")
def files(golden, tmp_path_factory):
    """The hand-made tables as the files that a run starts from."""
    folder = tmp_path_factory.mktemp("files")
    facts = {}
    for source in ("chat", "api"):
        facts[source] = str(folder / f"{source}.csv")
        golden.inputs.facts.filter(f"source = '{source}'").select(*FACT_COLUMNS).toPandas().to_csv(
            facts[source], index=False
        )
    reference = ReferenceFiles.in_folder(str(folder))
    blank = [""] * 19
    lines = ["# a comment"]
    for row in golden.inputs.countries.collect():
        fields = list(blank)
        fields[0], fields[1], fields[4], fields[7], fields[8] = (
            row.iso2 or "", row.iso3 or "", row.country or "", "1", row.continent or "")
        lines.append("\t".join(fields))
    (folder / "countries.tsv").write_text("\n".join(lines) + "\n")
    people = [r for r in golden.inputs.countries.collect() if r.population is not None]
    (folder / "populations.csv").write_text("iso3,wb_name,year,population\n" + "".join(
        f'{r.iso3},"{r.country}",2024,{r.population}\n' for r in people))
    total = golden.inputs.focus_population.first().population
    (folder / "regions.csv").write_text("geo_id,name,level,population,as_of,source\n" + "".join(
        f'{r.geo_id},"{r.name}",province,{r.population},2026,made\n'
        for r in golden.inputs.provinces.collect()) + f"CA,all,country,{total},2026,made\n")
    for name in REFERENCE:
        getattr(golden.inputs, name).toPandas().to_csv(getattr(reference, name), index=False)
    return folder, facts, reference


def rows(frame):
    return sorted(map(repr, map(tuple, frame.collect())))


def test_files_give_the_tables_that_were_written(spark, golden, files):
    _, facts, reference = files
    loaded = load_inputs(spark, facts, reference)
    for name in SCHEMAS:
        assert rows(getattr(loaded, name)) == rows(getattr(golden.inputs, name)), name


def test_one_missing_file_stops_the_run(spark, golden, files, tmp_path):
    _, facts, reference = files
    gone = dataclasses.replace(reference, lens=str(tmp_path / "lens.csv"))
    with pytest.raises(FileNotFoundError, match="lens.csv"):
        load_reference(spark, gone)
    with pytest.raises(FileNotFoundError):
        run_from_files(spark, {"chat": str(tmp_path / "none.csv")}, reference, {}, golden.d)


@pytest.mark.parametrize("more", ["", "CA,again,country,5,2026,made\nCA,third,country,,2026,made\n"])
def test_the_focus_country_needs_exactly_one_row(spark, files, tmp_path, more):
    _, _, reference = files
    path = tmp_path / "regions.csv"
    path.write_text("geo_id,name,level,population,as_of,source\nCA-ON,Ontario,province,1,2026,made\n" + more)
    tables = load_reference(spark, dataclasses.replace(reference, regions=str(path)))
    with pytest.raises(Exception, match="exactly|expected one row"):
        tables["focus_population"].collect()


def test_the_exit_status_is_the_verdict(spark, files, tmp_path):
    folder, facts, reference = files
    digests = {
        name: hashlib.sha256(open(path, "rb").read()).hexdigest()
        for name, path in {**facts, **reference.paths()}.items()
    }
    published, out = tmp_path / "published.json", tmp_path / "out"
    published.write_text(json.dumps(digests))
    status = main(
        [*[f"--facts={k}={v}" for k, v in facts.items()], "--reference", str(folder),
         "--published", str(published), "--out", str(out), "--skip-defects"], spark,
    )
    summary = spark.read.json(f"{sinks.published(spark, str(out))}/qa/summary").first()
    assert summary.sources_match_published_checksums
    assert status == (0 if summary.all_gates_passed else 1)
    # one check fails on the hand-made data, by design
    assert (status, summary.checks - summary.checks_passed) == (1, 1)
