"""Everything a metric definition can vary, in one frozen object.

A run uses ``Definition()``. A planted defect is ``definition.replace(knob=value)``;
there is no SQL text to patch and no shared state to restore afterwards.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

# The column layout of a fact file, in file order.
FACT_COLUMNS = (
    "geo_id", "geography", "date_start", "date_end", "platform_and_product",
    "facet", "level", "variable", "cluster_name", "value",
)

# Facets whose labels carry counts and percentages.
CHECKED_FACETS = (
    "use_case", "collaboration", "task_success", "human_only_ability", "multitasking", "request",
)

# The four share metrics, in report order.
METRIC_ORDER = ("work_share", "coursework_share", "automation_share", "success_rate")

GLOBAL_ID = "GLOBAL"


class UnknownKnobError(ValueError):
    """A change names a field the definition does not have, or changes nothing."""


@dataclass(frozen=True)
class Definition:
    # scope
    focus_country: str = "CA"
    focus_group: str = "13"
    chat_source: str = "chat"
    api_source: str = "api"
    request_level: int = 2

    # places without a usable location
    exclude_unclassified: bool = True
    unclassified_ids: tuple[str, ...] = ("NONE", "not_classified")
    unclassified_suffix: str = "-not_classified"

    # minimum samples
    min_usage: float = 200
    min_share_n: float = 200
    min_rest: float = 200
    min_request_n: float = 200
    min_category: float = 30

    # intervals
    z_wilson: float = 1.96
    z_index: float = 1.96
    z_rest: float = 1.96
    z_mix: float = 1.96
    z_gap: float = 1.96
    wilson_lo_centred: bool = True

    # usage per resident
    require_population: bool = True
    per_capita_base: float = 100_000.0
    province_total_scope: str = "dimension"  # or "all"

    # shares: which labels count, and towards what
    work: tuple[str, ...] = ("work",)
    coursework: tuple[str, ...] = ("coursework",)
    use_case_base: tuple[str, ...] = ("work", "personal", "coursework")
    automation: tuple[str, ...] = ("directive", "feedback loop")
    augmentation: tuple[str, ...] = ("learning", "task iteration", "validation")
    collaboration_base: tuple[str, ...] = (
        "directive", "feedback loop", "learning", "task iteration", "validation",
    )
    success: tuple[str, ...] = ("yes",)
    success_base: tuple[str, ...] = ("yes", "no")

    # comparison with the rest of the parent
    rest_excludes_self: bool = True
    subregion_parent: str = "country"  # or "global"
    rest_two_sample: bool = True

    # request mix
    unclassified_categories: tuple[str, ...] = ("not_classified",)
    mix_rest_excludes_self: bool = True
    mix_two_sample: bool = True

    # platform gap
    gap_sign: float = 1.0
    gap_two_sample: bool = True

    # exposure by occupation group
    mean_over: str = "all"  # or "exposed"
    median: str = "median"  # or "mean"
    ranking: str = "rank"  # or "dense_rank"

    # how many ways the few, hot parent rows are copied in a parent lookup
    salts: int = 8

    def __post_init__(self):
        if self.salts < 1:
            raise ValueError("salts must be at least 1")

    # one version of itself: see plans/versions.py
    keys = ()

    def distinct(self, read) -> list:
        return [read(self)]

    def tagged(self, df):
        return df

    def choose(self, read, make):
        return make(read(self))

    def replace(self, **changes) -> "Definition":
        known = {f.name for f in dataclasses.fields(self)}
        unknown = sorted(set(changes) - known)
        if unknown:
            raise UnknownKnobError(f"no such knob: {', '.join(unknown)}")
        changed = dataclasses.replace(self, **changes)
        if changes and changed == self:
            raise UnknownKnobError(f"change leaves the definition as it is: {changes}")
        return changed

    def differs_in(self, other: "Definition") -> set[str]:
        return {
            f.name for f in dataclasses.fields(self)
            if getattr(self, f.name) != getattr(other, f.name)
        }
