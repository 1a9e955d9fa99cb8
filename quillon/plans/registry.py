"""Registered queries: name -> (function of session and folder, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.listings import LISTINGS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name. In sql, L is the derived listings table."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        assert key not in QUERIES, key
        QUERIES[key] = f
        if sql is not None:
            body = sql.strip()
            if "{L}" in body or " L " in f" {body} " or "FROM L" in body:
                body = f"WITH RECURSIVE L AS ({LISTINGS_SQL})" + (", " + body[5:] if body[:5].upper() == "WITH " else " " + body)
            SQL[key] = body
        return f

    return add
