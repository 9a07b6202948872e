"""JSON text as columns: rosters, counts, first values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEMBER = "array<struct<name string, position string, role string, gender string, is_independent string, is_executive string, is_board_member string>>"
FEMALE = ["female", "nữ", "nu"]
YES = ["true", "1", "yes", "y", "co", "có"]


def present(text: Column) -> Column:
    """JSON text, the stored literal null read as null."""
    return F.when(F.trim(text) != "null", text)


def members(details: Column) -> Column:
    """A roster as an array; null, bad JSON and the literal null as empty."""
    return F.coalesce(F.from_json(F.coalesce(present(details), F.lit("[]")), MEMBER), F.array().cast(MEMBER))


def count_where(details: Column, field: str, values: list[str]) -> Column:
    """Members whose field, trimmed and small, is one of the values."""
    return F.size(F.filter(members(details), lambda m: F.lower(F.trim(F.coalesce(m[field], F.lit("")))).isin(values))).cast("long")


def array_size(details: Column) -> Column:
    return F.coalesce(F.json_array_length(F.coalesce(present(details), F.lit("[]"))), F.lit(0)).cast("long")


def first_value(text: Column, *paths: str) -> Column:
    return F.coalesce(*[F.get_json_object(text, p) for p in paths])


def safe_size(text: Column) -> Column:
    """Items of a list, fields of an object, 1 for another value, 0 for bad or no JSON."""
    value = F.try_parse_json(text)
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (kind == "VOID"), 0)
        .when(kind.startswith("ARRAY"), F.coalesce(F.json_array_length(text), F.lit(0)))
        .when(kind.startswith("OBJECT"), F.coalesce(F.size(F.json_object_keys(text)), F.lit(0)))
        .otherwise(1)
    )


def list_or_text(text: Column) -> Column:
    """A JSON list of strings, or the raw text as the only item."""
    parsed = F.from_json(text, "array<string>")
    is_list = F.trim(text).startswith("[") & parsed.isNotNull()
    return F.when(text.isNull() | (F.trim(text) == ""), F.array().cast("array<string>")).when(is_list, parsed).otherwise(F.array(text))


def batch_content(response: Column) -> Column:
    """The answer text of a chat batch response line, empty where there is none."""
    return F.coalesce(F.get_json_object(response, "$.response.body.choices[0].message.content"), F.lit(""))
