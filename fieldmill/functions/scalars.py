"""Strictly typed readings of variants. A reading is null unless the value has exactly that kind; nothing is converted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import access

I64_MAX = 2**63 - 1
U64 = 2**64


def kind(x: Column) -> Column:
    """str, int, float, bool, list, map or none (a JSON null); SQL NULL where there is no value."""
    t = F.schema_of_variant(x)
    return (
        F.when(t == "STRING", "str").when(t == "BIGINT", "int").when(t == "BOOLEAN", "bool").when(t == "VOID", "none")
        .when(_wide(t) & _fits_u64(x), "int").when(t.startswith("DECIMAL") | (t == "DOUBLE") | (t == "FLOAT"), "float")
        .when(t.startswith("ARRAY"), "list").when(t.startswith("OBJECT"), "map")
    )


def _wide(t: Column) -> Column:
    return t.isin("DECIMAL(19,0)", "DECIMAL(20,0)")


def _decimal(x: Column) -> Column:
    return F.try_variant_get(x, "$", "decimal(38,0)")


def _fits_u64(x: Column) -> Column:
    return (_decimal(x) > F.lit(I64_MAX).cast("decimal(38,0)")) & (_decimal(x) < F.lit(str(U64)).cast("decimal(38,0)"))


def string(x: Column) -> Column:
    return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))


def boolean(x: Column) -> Column:
    return F.when(F.schema_of_variant(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))


def bigint(x: Column) -> Column:
    """Whole numbers. Those above the largest bigint and below 2**64 wrap around to negative ones."""
    t = F.schema_of_variant(x)
    wrapped = (_decimal(x) - F.lit(str(U64)).cast("decimal(38,0)")).cast("bigint")
    return F.when(t == "BIGINT", F.try_variant_get(x, "$", "bigint")).when(_wide(t) & _fits_u64(x), wrapped)


def double(x: Column) -> Column:
    """Numbers written with a point or exponent, and whole numbers beyond 2**64."""
    t = F.schema_of_variant(x)
    real = (t == "DOUBLE") | (t == "FLOAT") | (t.startswith("DECIMAL") & ~(_wide(t) & F.coalesce(_fits_u64(x), F.lit(False))))
    return F.when(real, F.try_variant_get(x, "$", "double"))


def numeric(x: Column) -> Column:
    """Any number, as a double."""
    return F.coalesce(bigint(x).cast("double"), double(x))


def scalar_text(x: Column) -> Column:
    """A scalar as text; null for lists, maps and JSON nulls."""
    return F.when(F.coalesce(kind(x), F.lit("none")).isin("str", "int", "float", "bool"), F.coalesce(bigint(x).cast("string"), F.try_variant_get(x, "$", "string")))


def has(v: Column, path: str) -> Column:
    return access(v, path).isNotNull()


def length(v: Column, path: str) -> Column:
    """Elements of a list, bytes of a string; null for anything else."""
    x = access(v, path)
    return F.when(kind(x) == "list", F.size(F.try_variant_get(x, "$", "array<variant>"))).otherwise(F.octet_length(string(x)))


def _is_scalar(x: Column) -> Column:
    return F.coalesce(kind(x).isin("str", "int", "float", "bool"), F.lit(False))


def get_list(v: Column, path: str) -> Column:
    """The scalars of a list as variants, others dropped; null if there is no list."""
    return F.filter(F.try_variant_get(access(v, path), "$", "array<variant>"), _is_scalar)


def string_list(v: Column, path: str) -> Column:
    """The scalars of a list as text. A list of strings, perhaps with nulls, is told by its type at once."""
    x = access(v, path)
    return F.when(F.schema_of_variant(x) == "ARRAY<STRING>", F.array_compact(F.try_variant_get(x, "$", "array<string>"))).otherwise(F.transform(get_list(v, path), scalar_text))


def get_map(v: Column, path: str) -> Column:
    """The scalar entries of an object, as text by key; null if there is no object."""
    entries = F.try_variant_get(access(v, path), "$", "map<string,variant>")
    return F.transform_values(F.map_filter(entries, lambda _, x: _is_scalar(x)), lambda _, x: scalar_text(x))


def keys(v: Column, path: str) -> Column:
    """The sorted keys of an object, those of nulls and nested values too; an empty list if there is no object."""
    return F.coalesce(F.array_sort(F.map_keys(F.try_variant_get(access(v, path), "$", "map<string,variant>"))), F.array().cast("array<string>"))
