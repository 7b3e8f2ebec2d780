"""All registered queries with their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES: tuple[str, ...] = ("quality", "partitions", "rebuild", "lineage", "ledger", "observe", "streams")

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _load() -> None:
    for name in MODULES:
        module = import_module(f"tablewarden.plans.{name}")
        for key in module.QUERIES:
            if key in QUERIES:
                raise ValueError(f"{key} is registered twice")
        QUERIES.update(module.QUERIES)
        ORACLES.update(module.ORACLES)


_load()
