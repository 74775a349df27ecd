"""Typed access to provider JSON held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def kind_of(value: Column, path: str = "$") -> Column:
    """``STRING``, ``BIGINT``, ``BOOLEAN``, ``VOID``, ``OBJECT<...>``, ... or null if absent."""
    return F.schema_of_variant(get(value, path, "variant"))


def text_at(value: Column, path: str) -> Column:
    """A JSON string, else null."""
    return F.when(kind_of(value, path) == "STRING", get(value, path, "string"))


def scalar_at(value: Column, path: str) -> Column:
    """A JSON string or number as text, else null."""
    kind = kind_of(value, path)
    is_container = kind.startswith("OBJECT") | kind.startswith("ARRAY") | kind.isin("VOID", "BOOLEAN")
    return F.when(~is_container, get(value, path, "string"))


def positive_int_at(value: Column, path: str) -> Column:
    """A JSON integer above zero, else null."""
    number = get(value, path, "bigint")
    return F.when((kind_of(value, path) == "BIGINT") & (number > 0), number)


def bool_at(value: Column, path: str) -> Column:
    return F.when(kind_of(value, path) == "BOOLEAN", get(value, path, "boolean"))


def list_at(value: Column, path: str) -> Column:
    """A JSON list as an array of variants, else null."""
    return F.when(kind_of(value, path).startswith("ARRAY"), get(value, path, "array<variant>"))


def is_object(value: Column, path: str = "$", field: str | None = None) -> Column:
    """Whether there is an object; one with ``field`` is known without describing it whole."""
    described = F.coalesce(kind_of(value, path).startswith("OBJECT"), F.lit(False))
    if field is None:
        return described
    return F.when(get(value, f"{path}.{field}", "variant").isNotNull(), True).otherwise(described)
