"""Registered queries: a Spark plan, the survey rows it covers, and its SQL check where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from marketloom.plans import views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[views.Views], DataFrame]
    covers: tuple[str, ...]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(covers: str, using: str = "", sql: str | None = None):
    """Register a plan under its function name.

    ``using`` names the view definitions the SQL check starts from.
    """

    def register(build):
        name = build.__name__
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        text = views.with_views(using, sql) if sql else None
        REGISTRY[name] = Query(name, build, tuple(covers.split()), text)
        return build

    return register


def r(expression: str, digits: int) -> str:
    """SQL text that rounds a double on its decimal digits, halves away from zero."""
    return f"cast(round(cast({expression} as decimal(28,10)), {digits}) as double)"
