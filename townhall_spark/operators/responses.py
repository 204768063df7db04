"""Model responses (JSON text prepared elsewhere) into actions and rejects.

Responses are parsed as VARIANT: unlike a declared struct, one malformed item
does not null the whole list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townhall_spark.functions.text import let, ustrip
from townhall_spark.schemas import ACTION_CATEGORIES, HAZARD_TYPES

NOT_JSON = "not_json"
ACTIONS_NOT_ARRAY = "actions_not_array"


def _confidence(item: Column) -> Column:
    """Number or numeric text clamped to [0, 1]; anything else is 0."""
    value = F.try_variant_get(item, "$.confidence", "double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))


def _member(item: Column, path: str, domain: tuple[str, ...]) -> Column:
    """Text at ``path`` when it is in the domain, else null."""
    value = F.try_variant_get(item, path, "string")
    return F.when(value.isin(*domain), value)


def _reason(v: Column) -> Column:
    listed = F.try_variant_get(v, "$.actions", "array<variant>")
    present = F.try_variant_get(v, "$.actions", "variant").isNotNull()
    return (F.when(v.isNull(), NOT_JSON)
            .when(present & listed.isNull(), ACTIONS_NOT_ARRAY))


def response_rejects(responses: DataFrame) -> DataFrame:
    """(canonical_id, reason) of responses that yield nothing because they are broken."""
    reason = let(F.try_parse_json("raw"), _reason)
    # An exploded array instead of a filter: a filter would parse every response twice.
    return responses.select(
        "canonical_id", F.explode(F.array_compact(F.array(reason))).alias("reason"))


def _action(item: Column) -> Column:
    """Fields of an item that is an object, else null."""
    return F.when(F.schema_of_variant(item).startswith("OBJECT"), F.struct(
        ustrip(F.try_variant_get(item, "$.action_text", "string")).alias("action_text"),
        _member(item, "$.action_category", ACTION_CATEGORIES).alias("action_category"),
        _member(item, "$.hazard_type", HAZARD_TYPES).alias("hazard_type"),
        _confidence(item).alias("confidence")))


def parse_responses(responses: DataFrame, version: str) -> DataFrame:
    """Actions of the well-formed items of every response."""
    items = F.try_variant_get(F.try_parse_json("raw"), "$.actions", "array<variant>")
    actions = F.filter(F.transform(items, _action), lambda a: (
        (a.action_text != "") & a.action_category.isNotNull()))
    return (responses.select("canonical_id", F.explode(actions).alias("a"))
            .select("canonical_id", "a.*", F.lit(version).alias("model_version")))


def parse_label_response(raw: Column) -> Column:
    """``struct<category, hazard, confidence>`` of a one-excerpt response.

    Anything unusable is ``(unrelated, none, 0.0)``.
    """
    def label(v: Column) -> Column:
        category = _member(v, "$.action_category", ACTION_CATEGORIES)
        usable = category.isNotNull()
        return F.struct(
            F.coalesce(category, F.lit("unrelated")).alias("category"),
            F.coalesce(F.when(usable, _member(v, "$.hazard_type", HAZARD_TYPES)),
                       F.lit("none")).alias("hazard"),
            F.when(usable, _confidence(v)).otherwise(F.lit(0.0)).alias("confidence"))

    return let(F.try_parse_json(raw), label)
