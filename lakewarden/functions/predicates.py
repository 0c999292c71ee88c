"""Rule conditions compiled to two-valued Columns.

A select is a mapping ``field[_op] -> value``, all of which must hold; an assertion is
``{"field", "op", "value"}``. Compiled predicates never yield null, so they can be
negated and counted, and they stay plain Columns, so they reach the scan as filters.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the suffixes of a select key, longest first, and the operators of an assertion
SELECT_OPS = ("not_matches", "matches_all", "not_in", "present", "absent", "matches", "in")
ASSERT_OPS = ("present", "absent", "equals", "not_equals", "in", "not_in", "matches", "not_matches", "matches_all", "matches_none", "gte", "lte")


def truthy(c: Column, kind: T.DataType) -> Column:
    """Null and false are false; text and lists are true unless empty; numbers unless zero."""
    if isinstance(kind, T.StringType):
        found = F.length(c) > 0
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        found = F.size(c) > 0
    elif isinstance(kind, T.BooleanType):
        found = c
    elif isinstance(kind, T.NumericType):
        found = c != 0
    else:
        found = c.isNotNull()
    return F.coalesce(found, F.lit(False))


def as_text(c: Column, kind: T.DataType) -> Column:
    """Null is empty; lists are joined by ", "; booleans are True and False."""
    if isinstance(kind, T.ArrayType):
        c = F.array_join(c, ", ")
    elif isinstance(kind, T.BooleanType):
        c = F.when(c, "True").when(~c, "False")
    return F.coalesce(c.cast("string"), F.lit(""))


def _member(c: Column, values: list) -> Column:
    plain = [v for v in values if v is not None]
    found = F.coalesce(c.isin(plain), F.lit(False)) if plain else F.lit(False)
    return found | c.isNull() if None in values else found


def _search(c: Column, kind: T.DataType, pattern: str) -> Column:
    # \w and \d cover all of Unicode
    return as_text(c, kind).rlike(f"(?U){pattern}")


def _number(c: Column, field: str) -> Column:
    n = c.cast("double")
    return F.when(n.isNull(), F.raise_error(F.lit(f"{field} is not a number")).cast("double")).otherwise(n)


def split_key(key: str, schema: T.StructType) -> tuple[str, str]:
    """(field, op) of a select key; the longest suffix that leaves a field wins."""
    if key in schema.names:
        return key, "equals"
    for op in SELECT_OPS:
        if key.endswith("_" + op) and key[: -len(op) - 1] in schema.names:
            return key[: -len(op) - 1], op
    raise ValueError(f"no field for {key!r}")


def condition(field: str, op: str, value: Any, schema: T.StructType) -> Column:
    c, kind = F.col(f"`{field}`"), schema[field].dataType
    match op:
        case "equals":
            return c.eqNullSafe(F.lit(value))
        case "not_equals":
            return ~c.eqNullSafe(F.lit(value))
        case "present":
            return truthy(c, kind)
        case "absent":
            return ~truthy(c, kind)
        case "in":
            return _member(c, value or [])
        case "not_in":
            return ~_member(c, value or [])
        case "matches":
            return _search(c, kind, value)
        case "not_matches":
            return ~_search(c, kind, value)
        case "matches_all":
            return reduce(Column.__and__, (_search(c, kind, v) for v in value)) if value else F.lit(False)
        case "matches_none":
            return ~reduce(Column.__or__, (_search(c, kind, v) for v in value)) if value else F.lit(True)
        case "gte" | "lte":
            n = _number(c, field)
            held = n >= F.lit(float(value)) if op == "gte" else n <= F.lit(float(value))
            return held & ~F.isnan(n)
    raise ValueError(f"unknown operator {op!r}")


def selection(select: dict[str, Any] | None, schema: T.StructType) -> Column:
    """All conditions hold; an empty select takes every row."""
    found = F.lit(True)
    for key, value in (select or {}).items():
        field, op = split_key(key, schema)
        if op in ("present", "absent"):
            held = condition(field, op, None, schema)
            held = held if value else ~held
        elif op == "matches_all" and not value:
            held = F.lit(True)
        else:
            held = condition(field, op, value, schema)
        found = found & held
    return found


def assertion(a: dict[str, Any], schema: T.StructType) -> Column:
    return condition(a["field"], a["op"], a.get("value"), schema)


def render(template: str, schema: T.StructType) -> Column:
    """``{field}`` becomes the row's value as text."""
    import re

    out: list[Column] = []
    for i, part in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            out.append(as_text(F.col(f"`{part}`"), schema[part].dataType) if part in schema.names else F.lit("{" + part + "}"))
        elif part:
            out.append(F.lit(part))
    return F.concat(*out) if out else F.lit("")
