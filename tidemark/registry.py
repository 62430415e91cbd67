"""The catalogue of operators: key, function of the tables, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.views import CTES, Tables

OPERATORS: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}
RAW: dict[str, str] = {}  # before the views are put in front


def op(key: str, sql: str | None = None):
    """Register a function of Tables under key."""

    def add(f):
        if key in OPERATORS:
            raise ValueError(f"{key} is registered twice")
        OPERATORS[key] = f
        if sql is not None:
            RAW[key], SQL[key] = sql, with_views(sql)
        return f

    return add


def with_views(sql: str) -> str:
    """sql after the definitions of the domain views it names, in dependency order."""
    used: set[str] = set()

    def need(text: str) -> None:
        for name in CTES:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                need(CTES[name])

    need(sql)
    views = [f"{name} AS ({body})" for name, body in CTES.items() if name in used]
    body = sql.strip()
    if not views:
        return body
    if m := re.match(r"WITH RECURSIVE\s+", body):
        return "WITH RECURSIVE " + ", ".join(views) + ", " + body[m.end() :]
    if m := re.match(r"WITH\s+", body):
        return "WITH " + ", ".join(views) + ", " + body[m.end() :]
    return "WITH " + ", ".join(views) + " " + body


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for k, f in OPERATORS.items()}
