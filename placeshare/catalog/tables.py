"""Sources and sinks: every query writes files derived from the given tables and scans them back."""

from pyspark.sql import functions as F

from placeshare.catalog.core import query
from placeshare.catalog.metrics import ESTIMATES, estimates
from placeshare.definition import FACT_COLUMNS
from placeshare.inputs import SCHEMAS, SQL_TABLES, register_frames, sql_query
from placeshare.operators.incremental import CellStore
from placeshare.operators.rollup import rollup_facts
from placeshare.plans.gate import gate_parts, run_gate
from placeshare.plans.jobs import written_all
from placeshare.plans.registry import build_metrics
from placeshare.quality.checks import run_checks
from placeshare.quality.defects import Corpus, defect_suite
from placeshare.quality.invariants import check_invariants
from placeshare.quality.reconcile import reconcile_summary
from placeshare.report.figures import brief_facts, figure_verification
from placeshare.sources import dimensions, facts as fact_files, orders, sinks
from placeshare.sources.concurrent import concurrently
from placeshare.sources.loading import ReferenceFiles, load_inputs
from placeshare.sources.manifest import source_manifest
from placeshare.sources.storage import new_path

ALL_FACTS = """
    select source, geo_id, geography, cast(date_start as varchar) as date_start,
           cast(date_end as varchar) as date_end, platform_and_product, facet, level, variable,
           cluster_name, value from facts
"""


def _fact_files(t) -> dict[str, str]:
    """The facts as one CSV folder per source, in the agreed layout."""
    folder = new_path(t.spark, "csv")
    files = {}
    for source in ("chat", "api"):
        rows = t.facts.filter(F.col("source") == source).select(*FACT_COLUMNS)
        files[source] = f"{folder}/{source}"
        rows.write.csv(files[source], header=True, escape='"')
    return files


@query("scan_facts_csv", ALL_FACTS, "value")
def scan_facts_csv(t):
    return fact_files.load_facts(t.spark, _fact_files(t))


@query("header_contract", """
    select source, source = 'chat' as is_accepted from facts group by source
""")
def header_contract(t):
    folder = new_path(t.spark, "csv")
    for source in ("chat", "api"):
        rows = t.facts.filter(F.col("source") == source).select(*FACT_COLUMNS)
        if source == "api":
            rows = rows.withColumnRenamed("variable", "metric")
        rows.write.csv(f"{folder}/{source}", header=True, escape='"')
    accepted = F.lit(None).cast("boolean")
    for source in ("chat", "api"):
        clean = not fact_files.header_violations(t.spark, f"{folder}/{source}")
        accepted = F.when(F.col("source") == source, clean).otherwise(accepted)
    return t.facts.select("source").distinct().withColumn("is_accepted", accepted)


query("tag_source", """
    select source, geo_id, facet, variable, cluster_name, value from facts
""", "value")(
    lambda t: fact_files.union_sources([
        fact_files.tag_source(
            t.facts.filter(F.col("source") == source)
            .select("geo_id", "facet", "variable", "cluster_name", "value"),
            source,
        )
        for source in ("chat", "api")
    ])
)

query("union_sources", ALL_FACTS, "value")(
    lambda t: fact_files.union_sources([
        t.facts.filter(F.col("source") == source) for source in ("chat", "api")
    ])
)


def _country_list(t, path: str) -> None:
    fields = [F.lit("")] * dimensions.COUNTRY_FILE_WIDTH
    for name, position in dimensions.COUNTRY_FIELDS.items():
        fields[position] = F.coalesce(F.col(name).cast("string"), F.lit(""))
    line = F.concat_ws("\t", *fields)
    comment = F.concat(F.lit("# "), F.col("country"))
    t.inputs.countries.select(
        F.concat(comment, F.lit("\n"), line, F.lit("\n")).alias("value")
    ).write.text(path)


@query("scan_geonames_tsv", "select * from dim_country")
def scan_geonames_tsv(t):
    path = new_path(t.spark, "countries")
    _country_list(t, path)
    return dimensions.scan_geonames_tsv(t.spark, path)


@query("dim_country", "select iso2, iso3, country, population, continent from dim_country")
def dim_country(t):
    stale = t.inputs.countries.withColumn("population", F.lit(1).cast("long"))
    published = t.inputs.countries.filter(F.col("population").isNotNull())
    return dimensions.dim_country(stale, published)


def _regions(t):
    provinces = t.inputs.provinces.withColumn("level", F.lit("province"))
    return provinces.unionByName(
        t.inputs.focus_population.select(
            F.lit(t.d.focus_country).alias("geo_id"), F.lit("focus").alias("name"),
            F.lit("country").alias("level"), "population",
        )
    )


query("dim_province", "select geo_id, name, population from dim_province")(
    lambda t: dimensions.dim_province(_regions(t))
)

query("country_population_scalar", "select population from focus_population")(
    lambda t: dimensions.country_population(_regions(t))
)


@query("scan_reference_csvs", """
    select 'groups' as file, soc_group as code, name as text, null::double as score
    from dim_occupation_group
    union all select 'occupations', occ_code, title, observed_exposure from occupations
    union all select 'lens', cluster, null, null from lens
    union all select 'territories', parent, subregion || '=' || territory, null from dim_territory
""", "score")
def scan_reference_csvs(t):
    folder = new_path(t.spark, "reference")
    for name in ("occupation_groups", "occupations", "lens", "territories"):
        sinks.write_table(getattr(t.inputs, name), f"{folder}/{name}", "csv")
    read = dimensions.scan_reference_csvs(
        t.spark, f"{folder}/occupation_groups", f"{folder}/occupations", f"{folder}/lens",
        f"{folder}/territories",
    )
    none, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    return (
        read["occupation_groups"].select(
            F.lit("groups").alias("file"), F.col("soc_group").alias("code"),
            F.col("name").alias("text"), none.alias("score"),
        )
        .union(read["occupations"].select(
            F.lit("occupations"), "occ_code", "title", "observed_exposure"))
        .union(read["lens"].select(F.lit("lens"), "cluster", no_text, none))
        .union(read["territories"].select(
            F.lit("territories"), "parent", F.concat_ws("=", "subregion", "territory"), none))
    )


@query("typed_tables", " union all ".join(
    f"select '{table}' as name, count(*) as row_count from {table}" for table in SQL_TABLES
))
def typed_tables(t):
    counts = [
        getattr(t.inputs, attribute).select(F.lit(table).alias("name"))
        for table, attribute in SQL_TABLES.items()
    ]
    return fact_files.union_sources(counts).groupBy("name").agg(
        F.count(F.lit(1)).alias("row_count")
    )


@query("register_frames", """
    select geography, count(*) as row_count, count(distinct geo_id) as places from facts
    group by geography
""")
def registered(t):
    register_frames(t.inputs, "placeshare_")
    return t.spark.sql("""
        select geography, count(*) as row_count, count(distinct geo_id) as places
        from placeshare_facts group by geography
    """)


AD_HOC = """
    select f.source, c.country, sum(f.value) as value from {facts} f
    join {dim_country} c on c.iso2 = f.geo_id where f.variable = 'usage_count'
    group by f.source, c.country
"""
query("sql_query", AD_HOC.format(facts="facts", dim_country="dim_country"), "value")(
    lambda t: sql_query(t.inputs, AD_HOC)
)


ORDER_FILES = ("lineitem", "orders", "customer", "part", "nation")


def order_files(t) -> dict[str, str]:
    return {name: f"{t.sf_dir}/{name}.parquet" for name in ORDER_FILES}


def published_digests(t) -> dict[str, str]:
    """One digest per order table, as a publisher would list them."""
    return {
        row.source: row.sha256
        for row in source_manifest(t.spark, order_files(t), {}).collect()
    }


@query("source_manifest")
def manifest(t):
    return source_manifest(t.spark, order_files(t), {})


@query("manifest_matches", " union all ".join(
    f"""select '{name}' as source, '{name}.parquet' as file, {str(name != "part").lower()}
        as matches_published_sha256"""
    for name in ORDER_FILES
))
def manifest_matches(t):
    """Against digests published before, of which one has changed since."""
    published = published_digests(t) | {"part": "0" * 64}
    return source_manifest(t.spark, order_files(t), published).select(
        "source", "file", "matches_published_sha256"
    )


@query("missing_sources", "select distinct source from facts where source = 'api'")
def missing(t):
    folder = new_path(t.spark, "csv")
    t.facts.filter(F.col("source") == "chat").select(*FACT_COLUMNS).write.csv(
        f"{folder}/chat", header=True
    )
    return fact_files.absent_sources(t.spark, t.facts.select("source").distinct(), folder)


query("source_row_counts", """
    select source, count(*) as "rows" from facts group by source
""")(lambda t: fact_files.source_row_counts(t.facts))


def _rewritten(t, form: str):
    out = new_path(t.spark, "artifacts")
    folder = sinks.new_run(out)
    sinks.write_gold(t.metrics, folder, form)
    sinks.publish(t.spark, out, folder)
    wanted = {name: df.schema for name, df in t.metrics.items()}
    return sinks.read_gold(t.spark, sinks.published(t.spark, out), {**wanted, "not_written": wanted["shares"]}, form)


@query("write_gold", ESTIMATES, "estimate")
def write_gold(t):
    read = _rewritten(t, "parquet")
    return estimates({name: read[name] for name in t.metrics})


@query("read_gold", f"""
    select *, true as is_written from ({ESTIMATES})
    union all select 'not_written', null, null, false
""", "estimate")
def read_gold(t):
    read = _rewritten(t, "csv")
    found = {name: df for name, df in read.items() if df is not None}
    absent = [name for name in read if name not in found]
    none = t.spark.createDataFrame(
        [(name, None, None, False) for name in absent],
        "metric string, key string, estimate double, is_written boolean",
    )
    return estimates(found).withColumn("is_written", F.lit(True)).unionByName(none)


@query("load_inputs", ESTIMATES, "estimate")
def loaded_from_files(t):
    """The six metrics from nothing but files."""
    folder = new_path(t.spark, "reference")
    files = ReferenceFiles.in_folder(folder)
    _country_list(t, files.countries)
    countries = t.inputs.countries
    sinks.write_table(
        countries.filter(F.col("population").isNotNull()).select(
            "iso3", F.col("country").alias("wb_name"), F.lit(2024).alias("year"), "population"
        ), files.populations, "csv",
    )
    sinks.write_table(
        _regions(t).select(
            "geo_id", "name", "level", "population", F.lit("2026-01-01").alias("as_of"),
            F.lit("orders").alias("source"),
        ), files.regions, "csv",
    )
    for name in ("occupation_groups", "occupations", "lens", "territories"):
        sinks.write_table(getattr(t.inputs, name), getattr(files, name), "csv")
    return estimates(build_metrics(load_inputs(t.spark, _fact_files(t), files), t.d))


def order_corpora(t) -> list[Corpus]:
    from placeshare.plans import pipeline

    results, golden = concurrently(t.spark, [lambda: t.results, lambda: pipeline.golden_corpus(t.spark)])
    return [Corpus("order data", t.inputs, t.d, results[1]), golden]


def planted(t, corpora: list[Corpus] | None = None):
    """All defects on the order tables and on the hand-made ones."""
    return defect_suite(t.spark, corpora or order_corpora(t), metrics={"order data": t.results[0]})


def gate(t):
    """The verdict. What does not need the counted records runs beside them, and the evidence side by side."""
    digests, corpora = concurrently(t.spark, [lambda: published_digests(t), lambda: order_corpora(t)])
    evidence, defects = concurrently(t.spark, [
        lambda: written_all(t.spark, {
            "manifest": lambda: source_manifest(
                t.spark, order_files(t), digests | {"lineitem": "not published"}
            ),
            "reconciliation": lambda: reconcile_summary(*t.results),
            "invariants": lambda: check_invariants(t.results[0], t.inputs, t.d),
            "checks": lambda: run_checks(t.inputs, t.d),
            "figures": lambda: figure_verification(
                *[brief_facts(side, t.names, t.d) for side in t.results]
            ),
        }),
        lambda: planted(t, corpora),
    ])
    return run_gate(gate_parts(
        evidence["manifest"], evidence["reconciliation"], evidence["invariants"],
        evidence["checks"], evidence["figures"], defects,
    ))


@query("rollup_batches", ALL_FACTS, "value")
def rollup_batches(t):
    """The order lines in three batches, one of them sent twice."""
    store = CellStore(t.spark, new_path(t.spark, "cells"), orders.SPEC)
    for batch in (0, 1, 1, 2, 0):
        part = orders.OrderTables(t.spark, t.sf_dir).only(
            "lineitem", F.col("l_orderkey") % 3 == batch
        )
        store.add(f"lines {batch}", orders.records(part))
    return store.facts()


query("rollup_facts", ALL_FACTS, "value")(
    lambda t: rollup_facts(orders.records(orders.OrderTables(t.spark, t.sf_dir)), orders.SPEC)
)

assert set(SQL_TABLES.values()) < set(SCHEMAS)
