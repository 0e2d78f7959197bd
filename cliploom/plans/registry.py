"""Named queries over a folder of tables, and the SQL they are checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cliploom.plans.views import Views

Plan = Callable[[Views], DataFrame]
PLANS: dict[str, Plan] = {}
CHECKS: dict[str, str] = {}
_PARTS: dict[str, str] = {}


def plan(name: str, check: str | None = None) -> Callable[[Plan], Plan]:
    """Register a query; ``check`` is the equivalent SQL over the same tables."""

    def add(function: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"two plans are named {name}")
        PLANS[name] = function
        if check is not None:
            CHECKS[name] = check
        return function

    return add


def part(name: str, sql: str) -> None:
    """A named piece of SQL that checks may refer to."""
    _PARTS[name] = sql


def full_sql(check: str) -> str:
    """The check with every piece it needs in front of it, in definition order."""
    needed: set[str] = set()
    open_texts = [check]
    while open_texts:
        text = open_texts.pop()
        for name in set(re.findall(r"\bq_\w+", text)) & _PARTS.keys() - needed:
            needed.add(name)
            open_texts.append(_PARTS[name])
    if not needed:
        return check
    pieces = ",\n".join(
        f"{name} AS {'' if ' UNION ALL ' in sql and name.endswith('_steps') else 'MATERIALIZED '}"
        f"({sql})" for name, sql in _PARTS.items() if name in needed
    )
    return f"WITH RECURSIVE {pieces}\n{check}"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(function: Plan) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: function(Views(spark, folder))

    return {name: bind(function) for name, function in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: full_sql(check) for name, check in CHECKS.items()}
