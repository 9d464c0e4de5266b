"""Reply validation as column expressions (first failure wins).

The reply is parsed once, to a variant; checks look at the JSON types of its parts.  What counts as
an integer or a number follows the reply's consumers: numbers and truth values always do
(an integer is cut from a fraction), texts if they spell one, nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"(?i)^\s*[+-]?([0-9]+\.?[0-9]*(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"
_BLANK = r"(?U)^\s*$"


def _part(v: Column, name: str) -> Column:
    """A member of an object; SQL null if it is not there, a variant null if it is null."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def _type(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _is(v: Column, pattern: str) -> Column:
    kind = _type(v)
    number = kind.isin("BIGINT", "BOOLEAN", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.coalesce(number | ((kind == "STRING") & _text(v).rlike(pattern)), F.lit(False))


def _blank(v: Column) -> Column:
    return (_type(v) == "STRING") & _text(v).rlike(_BLANK)


def _given(v: Column) -> Column:
    return v.isNotNull() & ~F.is_variant_null(v)


def candidate_error(c: Column) -> Column:
    room, probability = _part(c, "room_id"), _part(c, "probability")
    return (
        F.when(~_type(c).startswith("OBJECT"), F.lit("candidate_not_object"))
        .when(room.isNull() | probability.isNull(), F.lit("candidate_missing_keys"))
        .when(_blank(room), F.lit("candidate_empty_room"))
        .when(~_is(probability, _NUMBER), F.lit("candidate_bad_probability"))
    )


def payload_error(p: Column) -> Column:
    """``ok`` or the code of the first failed check of a localisation reply; null and broken JSON are no object."""
    v = F.try_parse_json(p)
    floor, room, listed, building = (_part(v, k) for k in ("floor", "room_id", "candidates", "building"))
    bad_confidence = F.lit(False)
    for name in ("confidence_room", "confidence_floor"):
        c = _part(v, name)
        bad_confidence = bad_confidence | (_given(c) & ~_is(c, _NUMBER))
    errors = F.transform(F.try_variant_get(v, "$.candidates", "array<variant>"), candidate_error)
    first_bad = F.try_element_at(F.filter(errors, lambda e: e.isNotNull()), F.lit(1))
    return (
        F.when(v.isNull() | ~_type(v).startswith("OBJECT"), F.lit("not_object"))
        .when(floor.isNull() | room.isNull() | listed.isNull(), F.lit("missing_keys"))
        .when(~_is(floor, _INTEGER), F.lit("bad_floor"))
        .when(_blank(room), F.lit("empty_room"))
        .when(~_type(listed).startswith("ARRAY"), F.lit("candidates_not_list"))
        .when(first_bad.isNotNull(), first_bad)
        .when(_given(building) & ~_is(building, _INTEGER), F.lit("bad_building"))
        .when(bad_confidence, F.lit("bad_confidence"))
        .otherwise(F.lit("ok"))
    )
