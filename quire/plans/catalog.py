"""All registered queries and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import base

FAMILIES = ("text", "rule", "score", "pack", "layer", "style", "source", "registry", "history", "stream")


def _load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"quire.plans.{family}_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: base.expand(sql) for name, sql in base.RAW_SQL.items()}
