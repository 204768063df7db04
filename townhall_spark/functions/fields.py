"""Declarative field mapping: each spec compiles once to a Column.

A spec is a one-key mapping, as written in a source file:
``copy``, ``const``, ``template``, ``state_abbrev``, ``meeting_type_from_govt``,
``parse_date`` (``column``, ``format`` iso or mmddyyyy) and
``clean_text`` (``column``, ``missing``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from string import Formatter
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from townhall_spark.functions.regions import STATE_CODES, lookup
from townhall_spark.functions.text import let, ustrip

# Governing-body words, tested in this order on the upper-cased label.
COMMITTEE_WORDS = ("PLAN", "ZON")
COUNCIL_WORDS = ("COUNCIL", "COMMISSION", "COUNTY", "BOARD OF SUPERVISORS")


def _text(name: str, schema: T.StructType) -> Column:
    """A raw column as text; a column the source does not have is null."""
    if name not in schema.names:
        return F.lit(None).cast("string")
    return F.col(name).cast("string")


def _contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def meeting_type_from_govt(label: Column) -> Column:
    """Meeting type of a governing-body label, null for bodies out of scope."""
    upper = F.upper(label)
    return (F.when(_contains_any(upper, COMMITTEE_WORDS), "committee")
            .when(_contains_any(upper, COUNCIL_WORDS), "council_full"))


# Shapes a date text must have; year 0 is not a year.
ISO_SHAPE = r"^(?!0000)[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"
MMDDYYYY_SHAPE = r"^[0-9]{4}(?!0000)[0-9]{4}\z"


def parse_date(text: Column, fmt: str = "iso") -> Column:
    """DATE, or null when the text is not a calendar date of year 1 or later."""
    if fmt == "mmddyyyy":
        return F.when(text.rlike(MMDDYYYY_SHAPE), F.try_to_date(text, "MMddyyyy"))
    head = F.substring(text, 1, 10)
    return F.when(head.rlike(ISO_SHAPE), F.try_to_date(head, "yyyy-M-d"))


def clean_text(text: Column, missing: str = "") -> Column:
    """Stripped text; null when empty or equal to the ``missing`` marker in any case."""
    sentinel = missing.lower()

    def keep(stripped: Column) -> Column:
        # One character more than the marker decides equality without lowering
        # a whole transcript.
        head = F.lower(F.substring(stripped, 1, len(sentinel) + 1))
        return F.when((stripped != "") & (head != sentinel), stripped)

    return let(ustrip(text), keep)


def fill_template(template: str, schema: T.StructType) -> Column:
    """Text with ``{column}`` holes; null, empty, zero and false values fill as ``""``."""
    parts: list[Column] = []
    for literal, name, spec, conversion in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is None:
            continue
        if spec or conversion:
            raise ValueError(f"template formats are not supported: {template}")
        if name not in schema.names:
            return F.lit("")
        value = F.col(name)
        filled = F.coalesce(value.cast("string"), F.lit(""))
        if isinstance(schema[name].dataType, T.NumericType):
            filled = F.when(value == 0, "").otherwise(filled)
        elif isinstance(schema[name].dataType, T.BooleanType):
            filled = F.when(~value, "").otherwise(filled)
        parts.append(filled)
    return F.concat(*parts) if parts else F.lit("")


TRANSFORMS: dict[str, Callable[[Any, T.StructType], Column]] = {
    "copy": lambda arg, schema: ustrip(_text(arg, schema)),
    "const": lambda arg, schema: F.lit(arg),
    "template": fill_template,
    "state_abbrev": lambda arg, schema: lookup(STATE_CODES, ustrip(_text(arg, schema)), ""),
    "meeting_type_from_govt": lambda arg, schema: meeting_type_from_govt(_text(arg, schema)),
    "parse_date": lambda arg, schema: parse_date(
        _text(arg["column"], schema), arg.get("format", "iso")),
    "clean_text": lambda arg, schema: clean_text(
        _text(arg["column"], schema), arg.get("missing", "")),
}


def compile_spec(spec: Mapping[str, Any], schema: T.StructType) -> Column:
    """The Column of one field spec; ``ValueError`` for an unknown spec."""
    for name, build in TRANSFORMS.items():
        if name in spec:
            return build(spec[name], schema)
    raise ValueError(f"unknown transform spec: {dict(spec)}")


def compile_map(field_map: Mapping[str, Mapping[str, Any]], schema: T.StructType
                ) -> dict[str, Column]:
    """Columns of a whole field map."""
    return {field: compile_spec(spec, schema) for field, spec in field_map.items()}
