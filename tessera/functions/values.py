"""Presence and shape of values in semi-structured documents (VARIANT)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .versions import trim_all


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def listed(v: Column) -> Column:
    """The elements of a variant that is an array, else NULL."""
    return F.try_variant_get(v, "$", "array<variant>")


def mapped(v: Column) -> Column:
    """The keys and values of a variant that is an object, else NULL."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def items(v: Column) -> Column:
    """The elements of a variant that is an array, else an empty array."""
    return F.coalesce(listed(v), F.array().cast("array<variant>"))


def _shape(v: Column, kind: str) -> Column:
    """A value as a container of empty structs: tells its kind and size without a copy of what is in it."""
    return F.try_variant_get(v, "$", kind)


def is_list(v: Column) -> Column:
    return _shape(v, "array<struct<>>").isNotNull()


def is_object(v: Column) -> Column:
    return _shape(v, "struct<>").isNotNull()


def members(v: Column) -> Column:
    """The values of a variant that is an object, else an empty array."""
    return F.coalesce(F.map_values(mapped(v)), F.array().cast("array<variant>"))


def _scalar_type(v: Column) -> Column:
    """STRING, VOID (null), BIGINT and so on of a scalar; the whole of a container is not looked at."""
    return F.when(is_list(v), "ARRAY").when(is_object(v), "OBJECT").otherwise(F.schema_of_variant(v))


def is_null(v: Column) -> Column:
    """Is it there, with a null?"""
    return F.is_variant_null(v)


def text(v: Column) -> Column:
    """The string of a variant that is a string, else NULL."""
    return let(v, lambda x: F.when(_scalar_type(x) == "STRING", F.try_variant_get(x, "$", "string")))


def child(v: Column, key: str) -> Column:
    """The value of a key: NULL if the key is missing or ``v`` is no object, a null variant if it is null."""
    quoted = key.replace("'", "\\'")
    return F.try_variant_get(v, f"$['{quoted}']", "variant")


def clean(c: Column) -> Column:
    """Does a string say something? Empty text, NOASSERTION and NONE (as written) do not."""
    t = trim_all(c)
    return F.coalesce(~t.isin("", "NOASSERTION", "NONE", "NOASSERTION."), F.lit(False))


def truthy(v: Column) -> Column:
    """Does a variant count as present? Null, blank, NOASSERTION in any case and empty containers do not; 0 and false do."""

    def scalar(x: Column) -> Column:
        said = trim_all(F.try_variant_get(x, "$", "string"))
        return let(F.schema_of_variant(x), lambda kind: F.when(kind == "VOID", False).when(kind == "STRING", (said != "") & (F.upper(said) != "NOASSERTION")).otherwise(True))

    whole = lambda x: F.when(x.isNull(), False).when(is_list(x), F.size(_shape(x, "array<struct<>>")) > 0).when(is_object(x), F.size(_shape(x, "map<string,struct<>>")) > 0).otherwise(scalar(x))
    return F.coalesce(let(v, whole), F.lit(False))
