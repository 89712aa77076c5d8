"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagequern.llm import boilerplate, chunking, leakage, mojibake, repeated_lines, residue, tokenize, truncation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _m in (mojibake, boilerplate, residue, repeated_lines, chunking, tokenize, leakage, truncation):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
