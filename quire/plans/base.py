"""Registry of runnable queries: each has a Spark job and, where SQL can say it, an equivalent SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
RAW_SQL: dict[str, str] = {}
CTES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            RAW_SQL[name] = sql
        return fn

    return register


def ctes(**named: str) -> None:
    CTES.update(named)


_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _needed(sql: str, seen: list[str], own: str | None = None) -> None:
    for word in dict.fromkeys(_IDENT.findall(sql)):
        if word in CTES and word not in seen and word != own:
            _needed(CTES[word], seen, word)
            if word not in seen:
                seen.append(word)


def expand(sql: str) -> str:
    """Prefix a SQL text with the shared relations it names, in dependency order."""
    order: list[str] = []
    _needed(sql, order)
    if not order:
        return sql
    recursive = "RECURSIVE " if any("UNION ALL -- step" in CTES[n] for n in order) else ""
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    own = sql.lstrip()
    if own.upper().startswith("WITH "):
        return f"WITH {recursive}{head},\n{own[5:]}"
    return f"WITH {recursive}{head}\n{sql}"
