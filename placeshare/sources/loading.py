"""From fact files and a folder of reference files to the tables of a run."""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from placeshare.inputs import Inputs, typed_inputs
from placeshare.sources import dimensions
from placeshare.sources.facts import load_facts, require_sources


@dataclass(frozen=True)
class ReferenceFiles:
    """Where each reference table is: a file or a folder of part files."""

    countries: str
    populations: str
    regions: str
    occupation_groups: str
    occupations: str
    lens: str
    territories: str

    @classmethod
    def in_folder(cls, folder: str) -> "ReferenceFiles":
        """Each table under its own name: the country list as ``.tsv``, the others as ``.csv``."""
        names = [field.name for field in dataclasses.fields(cls)]
        return cls(**{
            name: f"{folder.rstrip('/')}/{name}.{'tsv' if name == 'countries' else 'csv'}"
            for name in names
        })

    def paths(self) -> dict[str, str]:
        return dataclasses.asdict(self)


def load_reference(spark: SparkSession, files: ReferenceFiles) -> dict[str, DataFrame]:
    """All tables but the facts; refuses to start if one of the files is missing."""
    require_sources(spark, files.paths())
    regions = dimensions.scan_regions(spark, files.regions)
    return {
        "countries": dimensions.dim_country(
            dimensions.scan_geonames_tsv(spark, files.countries),
            dimensions.scan_populations(spark, files.populations),
        ),
        "provinces": dimensions.dim_province(regions),
        "focus_population": dimensions.country_population(regions),
        **dimensions.scan_reference_csvs(
            spark, files.occupation_groups, files.occupations, files.lens, files.territories
        ),
    }


def load_inputs(
    spark: SparkSession, facts: Mapping[str, str], reference: ReferenceFiles
) -> Inputs:
    return typed_inputs(facts=load_facts(spark, facts), **load_reference(spark, reference))
