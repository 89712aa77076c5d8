"""The registered queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagequern.plans import change_queries, dom_queries, manifest_queries, markup_queries, page_queries, snapshot_queries, state_queries, text_queries

_MODULES = [page_queries, text_queries, state_queries, snapshot_queries, dom_queries, manifest_queries, markup_queries, change_queries]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
