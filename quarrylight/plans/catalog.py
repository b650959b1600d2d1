"""Named queries over the fixture tables, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics, ingestion, listings, records, retrieval, rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (listings, rules, retrieval, records, ingestion, analytics):
    QUERIES |= _module.registry.queries
    ORACLES |= _module.registry.oracles
