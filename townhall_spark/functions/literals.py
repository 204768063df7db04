"""Constant arrays and maps, each built in one call however many entries it has."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(value: str) -> str:
    """SQL string literal of a value."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def text_array(values: Sequence[str]) -> Column:
    """Constant ``array<string>``."""
    if not values:
        return F.expr("cast(array() AS array<string>)")
    return F.expr(f"array({', '.join(quoted(v) for v in values)})")


def text_map(table: Mapping[str, str]) -> Column:
    """Constant ``map<string, string>``."""
    entries = ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in table.items())
    return F.expr(f"map({entries})")
