"""Every query over the driver's tables, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Registers the function below as ``key``; ``sql`` is its oracle, if SQL can say it."""

    def register(f):
        if key in QUERIES:
            raise ValueError(f"{key} is registered already")
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = sql
        return f

    return register


# The modules register their queries when they are imported.
from . import access, catalog, commands, content, durability, inout, relational, scalars, usage  # noqa: E402, F401
