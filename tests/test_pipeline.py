from placeshare.plans.pipeline import gate_passed, run_pipeline
from placeshare.quality.defects import DEFECTS
from placeshare.sources.manifest import source_manifest


def test_a_run_writes_its_artifacts_and_the_gate_needs_matching_digests(golden, spark, tmp_path):
    source = tmp_path / "chat.csv"
    source.write_text("geo_id\n")
    manifest = source_manifest(spark, {"chat": str(source)}, {"chat": "published"})
    out = tmp_path / "out"
    run = run_pipeline(
        golden.inputs, golden.d, manifest, str(out),
        [defect for defect in DEFECTS if defect.id in ("M06", "M25")],
    )
    row = run.summary.first()
    assert not gate_passed(run) and not row.sources_match_published_checksums
    assert row.reconciled and row.figures_verified
    assert (row.invariants, row.invariants_passed) == (18, 18)
    assert (row.defects, row.defects_killed) == (2, 2)
    assert (row.checks, row.checks_passed) == (20, 19)
    for table in ("geo_usage", "request_mix", "geo_names"):
        assert list((out / "gold" / table).glob("*.parquet"))
    for table in ("checks", "invariants", "figures", "reconciliation", "issues", "rollup_gaps",
                  "defects", "manifest"):
        assert list((out / "qa" / table).glob("*.parquet"))
    assert spark.read.json(str(out / "qa" / "summary")).first().figures == 53
