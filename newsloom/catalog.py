"""All registered queries of the knowledge-graph operators, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

GROUPS = ("ingest", "temporal", "graph", "quality", "resolve", "sources")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for group in GROUPS:
    module = import_module(f"newsloom.plans.{group}")
    QUERIES |= module.QUERIES
    ORACLE |= module.ORACLE
