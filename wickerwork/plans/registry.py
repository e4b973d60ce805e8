"""Registered queries: a Spark plan over the tables of a folder, and where SQL can say it, the SQL for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wickerwork.plans.tables import CTES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, tuple[list[str], str]] = {}


def query(name: str, sql: str | None = None, ctes: str = "") -> Callable:
    """Register ``plan(tables)`` under a name. ``ctes`` names the shared bindings the SQL reads."""

    def register(plan: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: plan(Tables(spark, folder))
        if sql is not None:
            _SQL[name] = (ctes.split(), sql)
        return plan

    return register


def oracle() -> dict[str, str]:
    """The SQL of every query that has one, with the bindings it reads."""
    return {name: with_ctes(ctes, sql) for name, (ctes, sql) in _SQL.items()}


def with_ctes(names: list[str], sql: str) -> str:
    """Prefix the bindings a statement reads, and those they read."""
    order: list[str] = []

    def need(name: str) -> None:
        needs, _ = CTES[name]
        for other in needs:
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    if not order:
        return sql.strip()
    heads = ", ".join(f"{name} AS ({CTES[name][1].strip()})" for name in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads}, {body[len('WITH RECURSIVE'):].lstrip()}"
    if body.upper().startswith("WITH"):
        return f"WITH {heads}, {body[4:].lstrip()}"
    return f"WITH {heads} {body}"


def r6(x: Column) -> Column:
    """Six decimals, on both sides of a comparison."""
    return F.round(x.cast("double"), 6)
