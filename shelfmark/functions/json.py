"""Typed access to JSON documents held as VARIANT.

Provider responses are schemaless (provider A) or decoded strictly against a
fixed shape (provider B). ``from_json`` coerces types (7 -> "7"), so the
checks below look at the JSON type of each value instead.

Cost notes: ``schema_of_variant`` walks the whole value, so containers are
tested with casts (``struct<>`` succeeds only for objects) and arrays are
checked through the merged element type Spark reports for the whole array
(``ARRAY<STRING>``; mixed kinds merge to ``VARIANT``). Higher-order lambdas
run interpreted, so they are the fallback, used only when the merged type
cannot decide a case exactly (nested objects, quoted keys).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .._util import col

_NUMBER_KINDS = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE")
_INTEGER_KINDS = ("TINYINT", "SMALLINT", "INT", "BIGINT")
# An array of flat objects (no nested containers, no quoted keys).
_FLAT_OBJECTS = r"\AARRAY<OBJECT<[^<>`]*>>\z"
_EMPTY_OR_NULLS = "ARRAY<VOID>"


def kind(v) -> Column:
    """JSON type name of a VARIANT: STRING, BIGINT, DECIMAL(p,s), DOUBLE,
    BOOLEAN, OBJECT<..>, ARRAY<..>, VOID (JSON null); NULL when absent."""
    return F.schema_of_variant(col(v))


def get(v, path: str) -> Column:
    return F.try_variant_get(col(v), path, "variant")


def is_object(v) -> Column:
    return F.try_variant_get(col(v), "$", "struct<>").isNotNull()


def elements(v) -> Column:
    """ARRAY<VARIANT> of a JSON array (NULL if not an array)."""
    return F.try_variant_get(col(v), "$", "array<variant>")


def is_array(v) -> Column:
    return elements(v).isNotNull()


def is_string(v) -> Column:
    return F.coalesce(kind(v) == "STRING", F.lit(False))


def is_number(v) -> Column:
    k = kind(v)
    return F.coalesce(k.isin(*_NUMBER_KINDS) | k.startswith("DECIMAL"), F.lit(False))


def is_integer(v) -> Column:
    """A JSON integer literal that fits 64 bits (what decodes into a Go int)."""
    return F.coalesce(kind(v).isin(*_INTEGER_KINDS), F.lit(False))


def is_absent(v) -> Column:
    """Missing member or JSON null: both leave a Go field at its zero value."""
    return col(v).isNull() | F.coalesce(F.is_variant_null(col(v)), F.lit(False))


def string_or_blank(v) -> Column:
    """The value if it is a JSON string, else ''."""
    return F.when(is_string(v), F.try_variant_get(col(v), "$", "string")).otherwise(F.lit(""))


def strict(v, allowed) -> Column:
    """True if `v` is absent/null or its JSON type passes `allowed(v)`."""
    return is_absent(v) | allowed(v)


def strict_array(v, element_ok) -> Column:
    """Absent/null, or an array whose every element is null or passes
    `element_ok` (per-element lambda: the exact, slow path)."""
    return is_absent(v) | (is_array(v) & F.forall(elements(v), lambda e: is_absent(e) | element_ok(e)))


def strict_string_array(v) -> Column:
    """Absent/null, or an array of strings and nulls (merged type, exact)."""
    return is_absent(v) | F.coalesce(kind(v).isin("ARRAY<STRING>", _EMPTY_OR_NULLS), F.lit(False))


def string_fields_ok(k: Column, names: tuple[str, ...]) -> Column:
    """On the merged type ``k`` of an array of flat objects: every member
    named in ``names`` is a string wherever it occurs."""
    bad = r"(<|, )(" + "|".join(names) + r"): (?!STRING[,>])"
    return ~k.rlike(bad)


def strict_object_array(v, names: tuple[str, ...], element_ok) -> Column:
    """Absent/null, or an array of objects/nulls whose members ``names`` are
    strings. Decided on the merged type when the objects are flat; else the
    per-element lambda ``element_ok``."""
    k = kind(v)
    flat = k.rlike(_FLAT_OBJECTS)
    decided = (k == _EMPTY_OR_NULLS) | (flat & string_fields_ok(k, names))
    return is_absent(v) | F.when((k == _EMPTY_OR_NULLS) | flat, decided).otherwise(
        F.coalesce(strict_array(v, element_ok), F.lit(False)))


def object_names(v) -> Column:
    """Names of the array elements that are objects with a string `name`,
    in array order; NULL when none (an empty Go slice stays nil).

    Fast path (flat objects whose `name` is always a string or missing): a
    cast to ``array<struct<name: string>>`` and a field projection, then
    nulls removed. Anything else takes the per-element lambda.
    """
    k = kind(v)
    fast = (k == _EMPTY_OR_NULLS) | (k.rlike(_FLAT_OBJECTS) & string_fields_ok(k, ("name",)))
    cast = F.try_variant_get(col(v), "$", "array<struct<name: string>>")
    quick = F.array_compact(cast.getField("name"))
    named = F.filter(elements(v), lambda e: is_object(e) & is_string(get(e, "$.name")))
    slow = F.transform(named, lambda e: F.try_variant_get(e, "$.name", "string"))
    names = F.when(fast, quick).otherwise(slow)
    return F.when(F.size(names) > 0, names)
