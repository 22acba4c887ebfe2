"""All queries by name. Those of the llm subpackage join in only if it is there."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = [
    "core_queries",
    "ingest_queries",
    "graph_queries",
    "entity_queries",
    "pattern_queries",
    "risk_queries",
    "fusion_queries",
    "model_queries",
    "synth_queries"
]


def _sources() -> list:
    found = [importlib.import_module(f"{__package__}.{m}") for m in _MODULES]
    try:
        found.append(importlib.import_module(f"{__package__.rpartition('.')[0]}.llm.queries"))
    except ImportError:  # the subpackage, or something that it needs, is not there
        pass
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _sources() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _sources() for name, sql in m.SQL.items()}
