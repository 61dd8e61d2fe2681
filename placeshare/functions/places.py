"""Row-wise rules on place ids, labels and variables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeshare.definition import GLOBAL_ID, Definition


def geo_level(geography: Column) -> Column:
    return F.when(geography == "country-state", F.lit("subregion")).otherwise(geography)


def place_prefix(geo_id: Column) -> Column:
    return F.split_part(geo_id, F.lit("-"), F.lit(1))


def country_code(geography: Column, geo_id: Column) -> Column:
    return (
        F.when(geography == "country-state", place_prefix(geo_id))
        .when(geography == "country", geo_id)
    )


def is_unclassified(geo_id: Column, d: Definition) -> Column:
    return matches_place_rule(geo_id, (True, d.unclassified_ids, d.unclassified_suffix))


def place_rule(d: Definition) -> tuple:
    """Which places a definition leaves out."""
    return d.exclude_unclassified, d.unclassified_ids, d.unclassified_suffix


def matches_place_rule(geo_id: Column, rule: tuple) -> Column:
    excluded, ids, suffix = rule
    return geo_id.isin(*ids) | geo_id.endswith(suffix) if excluded else F.lit(False)


def place_flags(d: Definition) -> dict[tuple, str]:
    """The staged column for each distinct rule on places."""
    rules = d.distinct(place_rule)
    return {rule: "is_unclassified_geo" + (f"_{i}" if i else "") for i, rule in enumerate(rules)}


def left_out_always(d: Definition) -> Column:
    """Left out under each rule."""
    out = F.lit(True)
    for name in place_flags(d).values():
        out = out & F.col(name)
    return out


def kept_place(d: Definition, prefix: str = "") -> Column:
    flags = place_flags(d)
    return d.choose(place_rule, lambda rule: ~F.col(prefix + flags[rule]))


def cluster_or_blank(cluster_name: Column) -> Column:
    return F.coalesce(cluster_name, F.lit(""))


def parent_id(level: Column, country: Column, d: Definition) -> Column:
    return d.choose(
        lambda d: d.subregion_parent,
        lambda parent: F.lit(GLOBAL_ID) if parent == "global" else country_or_global(level, country),
    )


def country_or_global(level: Column, country: Column) -> Column:
    return F.when(level == "country", F.lit(GLOBAL_ID)).otherwise(country)


def occupation_group(occ_code: Column) -> Column:
    """The first two characters of the code."""
    return F.left(occ_code, F.lit(2))


def padded(value: Column, width: int) -> Column:
    """Zeros in front up to ``width``; a longer value stays whole."""
    return F.lpad(value, F.greatest(F.lit(width), F.length(value)), F.lit("0"))


def is_count_of_facet(facet: Column, variable: Column) -> Column:
    return variable == F.concat(facet, F.lit("_count"))


def is_pct_of_facet(facet: Column, variable: Column) -> Column:
    return variable == F.concat(facet, F.lit("_pct"))


def is_histogram(variable: Column) -> Column:
    return variable.contains("histogram")


def any_null(columns: Iterable[Column]) -> Column:
    found = F.lit(False)
    for column in columns:
        found = found | column.isNull()
    return found


def key_text(name: str, value: Column, numeric: bool) -> Column:
    """``name=value``, with a whole number shown without its fraction."""
    shown = value.cast("string")
    if numeric:
        number = value.cast("double")
        shown = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(shown)
    return F.concat(F.lit(f"{name}="), F.coalesce(shown, F.lit("null")))
