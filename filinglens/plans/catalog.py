"""All registered queries."""

from __future__ import annotations

from . import (  # noqa: F401
    catalog_graph, catalog_joins, catalog_learning, catalog_links, catalog_reads, catalog_sources, catalog_streams,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
