"""Usage metrics for sampled records, with their checks, as Spark jobs."""

from placeshare.definition import Definition
from placeshare.inputs import Inputs

__all__ = ["Definition", "Inputs"]
