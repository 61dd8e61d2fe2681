"""Metric name -> how it is built, its key, and which knobs it reads."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from placeshare.definition import Definition
from placeshare.inputs import Inputs
from placeshare.operators.function_exposure import function_exposure
from placeshare.operators.geo_usage import geo_usage
from placeshare.operators.platform_gap import platform_gap
from placeshare.operators.request_mix import request_mix
from placeshare.operators.shares import shares
from placeshare.operators.staging import stage_facts
from placeshare.operators.vs_rest import vs_rest

Metrics = Mapping[str, DataFrame]

_STAGING = {"exclude_unclassified", "unclassified_ids", "unclassified_suffix"}
_SHARE_COUNTS = _STAGING | {
    "min_share_n", "work", "coursework", "use_case_base", "automation",
    "collaboration_base", "success", "success_base",
}


@dataclass(frozen=True)
class Metric:
    name: str
    keys: tuple[str, ...]
    build: Callable[[Inputs, DataFrame, DataFrame, Definition], DataFrame]
    reads: frozenset[str]


METRICS: dict[str, Metric] = {
    m.name: m
    for m in (
        Metric(
            "geo_usage", ("geo_id",),
            lambda i, staged, _, d: geo_usage(staged, i.countries, i.provinces, d),
            frozenset(_STAGING | {
                "chat_source", "min_usage", "require_population", "per_capita_base",
                "province_total_scope", "z_index",
            }),
        ),
        Metric(
            "shares", ("source", "geo_id", "metric"),
            lambda i, staged, share_rows, d: share_rows,
            frozenset(_SHARE_COUNTS | {"z_wilson", "wilson_lo_centred"}),
        ),
        Metric(
            "vs_rest", ("source", "geo_id", "metric"),
            lambda i, staged, share_rows, d: vs_rest(share_rows, d),
            frozenset(_SHARE_COUNTS | {
                "min_rest", "z_rest", "rest_excludes_self", "subregion_parent",
                "rest_two_sample",
            }),
        ),
        Metric(
            "request_mix", ("source", "geo_id", "cluster"),
            lambda i, staged, _, d: request_mix(staged, i.provinces, i.lens, d),
            frozenset(_STAGING | {
                "chat_source", "request_level", "min_request_n", "min_category", "z_mix",
                "unclassified_categories", "mix_rest_excludes_self", "mix_two_sample",
            }),
        ),
        Metric(
            "platform_gap", ("metric",),
            lambda i, staged, share_rows, d: platform_gap(share_rows, d),
            frozenset(_SHARE_COUNTS | {
                "chat_source", "api_source", "z_gap", "gap_sign", "gap_two_sample",
            }),
        ),
        Metric(
            "function_exposure", ("soc_group",),
            lambda i, staged, _, d: function_exposure(i.occupations, i.occupation_groups, d),
            frozenset({"mean_over", "median", "ranking"}),
        ),
    )
}


def affected_metrics(changed: Definition, clean: Definition) -> list[str]:
    """Metrics whose definition reads a changed knob."""
    knobs = changed.differs_in(clean)
    return [name for name, metric in METRICS.items() if knobs & metric.reads]


def build_metrics(
    inputs: Inputs,
    d: Definition,
    names: list[str] | None = None,
    staged: DataFrame | None = None,
    share_rows: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The metrics as lazy, unordered frames.

    ``d`` may also be ``Versions``: then each frame has all of them, told apart by its key.
    ``staged`` and ``share_rows`` let a caller pass in persisted frames that several metrics use.
    """
    staged = stage_facts(inputs.facts, d) if staged is None else staged
    names = list(names if names is not None else METRICS)
    if share_rows is None and {"shares", "vs_rest", "platform_gap"} & set(names):
        share_rows = shares(staged, d)
    return {name: METRICS[name].build(inputs, staged, share_rows, d) for name in names}


def ordered_metrics(metrics: Metrics) -> dict[str, DataFrame]:
    """Each metric in key order: for output only."""
    return {name: df.orderBy(*METRICS[name].keys) for name, df in metrics.items()}
