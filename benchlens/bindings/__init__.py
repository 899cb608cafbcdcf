"""Bindings of every operator to the driver tables.

Each binding is a callable ``(spark, sf_dir) -> DataFrame`` that applies the
library operator to a driver table playing a role (measurement log, result
document, file list, ...), next to the equivalent DuckDB SQL used as oracle.
"""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return deco


def load_all():
    from . import (documents, files, grid, joins, measurements, metrics,  # noqa: F401
                   report, sweep)
    return QUERIES, SQL
