"""Queries by name, and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.queries.fixtures import FIXTURES, in_duckdb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def with_fixtures(sql: str) -> str:
    """sql with the fixtures it names in front, as common table expressions."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bfx_\w+\b", text):
            if name in FIXTURES and name not in need:
                visit(FIXTURES[name])
                need.append(name)

    visit(sql)
    if not need:
        return sql
    ctes = ", ".join(f"{n} as ({in_duckdb(FIXTURES[n])})" for n in need)
    body = sql.strip()
    head = re.match(r"with(\s+recursive)?\s", body, re.I)
    return f"with{head[1] or ''} {ctes}, {body[head.end():]}" if head else f"with {ctes} {body}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_fixtures(sql)
        return f

    return add
