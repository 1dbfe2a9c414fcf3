"""The library's queries by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .projections import SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, tables: str = "") -> Callable[[Query], Query]:
    """Register a query; ``tables`` names the projections that its SQL reads, in the order they need."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            names = tables.split()
            recursive = "RECURSIVE " if "RECURSIVE" in sql else ""
            body = sql.replace("WITH RECURSIVE ", "WITH ").strip()
            views = ",\n".join(f"{t} AS ({SQL[t]})" for t in names)
            if views and body.startswith("WITH "):
                body = f"WITH {recursive}{views},\n{body[5:]}"
            elif views:
                body = f"WITH {views}\n{body}"
            elif recursive:
                body = body.replace("WITH ", "WITH RECURSIVE ", 1)
            ORACLES[name] = body
        return function

    return add
