"""Strict reading of JSON text with the built-in parser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRICT = {"allowSingleQuotes": "false"}


def shape_problem(text: Column) -> Column:
    """"not_json", "not_object" or NULL.

    Inside brackets exactly one value may stand: anything after the document breaks the list.
    """
    single = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", STRICT)
    return (
        F.when(F.coalesce(F.size(single), F.lit(-1)) != 1, F.lit("not_json"))
        .when(~F.ltrim(F.regexp_replace(text, r"\A\s+", "")).startswith("{"), F.lit("not_object"))
    )


def object_keys(text: Column) -> Column:
    return F.array_distinct(F.json_object_keys(text))


def starts_list(text: Column, name: str) -> Column:
    """Whether the first field is ``name`` and holds a list."""
    return text.rlike(rf'\A\s*\{{\s*"{name}"\s*:\s*\[')
