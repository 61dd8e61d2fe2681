"""Every operator as a named query over the order tables, with its SQL counterpart."""

from placeshare.catalog import (  # noqa: F401
    aggregates, checks, evidence, functions, joins, metrics, ordering, report, rows, tables,
)
from placeshare.catalog.core import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
