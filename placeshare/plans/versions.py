"""Many definitions evaluated by one plan: a table of parameters and one counter per distinct rule.

An operator is written against a definition by ``distinct`` (which rules must be counted),
``tagged`` (from here on there is a row per version) and ``choose`` (the expression of a version's
rule). ``Definition`` itself answers for one version and adds nothing to the plan; ``Versions`` adds
the column ``defect``, and what differs is picked by it. Facts are read and folded before rows are
tagged, so a scan costs the same whatever the number of versions.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeshare.definition import Definition


class Versions:
    """Definitions by id. Settings that all share read like those of one definition."""

    def __init__(self, of: Mapping[str, Definition], key: str = "defect"):
        self.of = dict(of)
        self.keys = (key,)

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        values = self.distinct(lambda d: getattr(d, name))
        if len(values) != 1:
            raise AttributeError(f"{name} differs between versions")
        return values[0]

    def distinct(self, read: Callable[[Definition], Hashable]) -> list:
        return list(dict.fromkeys(read(d) for d in self.of.values()))

    def tagged(self, df: DataFrame) -> DataFrame:
        """Each row once per version: for rows that are folded already."""
        ids = F.array(*[F.lit(i) for i in self.of])
        return df.withColumn(self.keys[0], F.explode(ids))

    def choose(self, read: Callable[[Definition], Hashable], make: Callable[..., Column]) -> Column:
        """On tagged rows: what ``make`` gives for the version's rule, one branch per distinct rule."""
        ids: dict[Hashable, list[str]] = {}
        for i, d in self.of.items():
            ids.setdefault(read(d), []).append(i)
        *others, (usual, _) = sorted(ids.items(), key=lambda item: len(item[1]))
        out = make(usual)
        for value, some in others:
            out = F.when(F.col(self.keys[0]).isin(*some), make(value)).otherwise(out)
        return out
