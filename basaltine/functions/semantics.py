"""Widening aggregates, containment and the unsigned 64-bit type, as Columns."""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UINT8_MAX = (1 << 64) - 1
UINT8 = T.DecimalType(20, 0)
MONEY = T.DecimalType(19, 2)


def pg_sum(column: str | Column, kind: T.DataType) -> Column:
    """sum() that widens: small and plain integers to bigint, bigint to numeric; null without input."""
    c = F.col(column) if isinstance(column, str) else column
    if isinstance(kind, T.LongType):
        return F.sum(c.cast("decimal(38,0)"))
    if kind == MONEY:
        return F.sum(c).cast(MONEY)
    return F.sum(c)


def pg_avg(column: str | Column, kind: T.DataType, scale: int = 16) -> Column:
    """avg() of integers as an exact numeric quotient; doubles stay doubles."""
    c = F.col(column) if isinstance(column, str) else column
    if isinstance(kind, T.FloatType | T.DoubleType):
        return F.avg(c.cast("double"))
    if kind == MONEY:
        raise TypeError("money has no avg")
    total = F.sum(c.cast("decimal(22,0)") if isinstance(kind, T.IntegralType) else c)
    return (total.cast(f"decimal(38,{scale})") / F.count(c).cast("decimal(20,0)")).cast(f"decimal(38,{scale})")


def uint8(column: str | Column) -> Column:
    """Text or numeric to unsigned 64-bit; fractions, negatives and overflow raise."""
    given = F.col(column) if isinstance(column, str) else column
    c = given.cast("decimal(38,10)")
    # The cast rounds to ten digits: what is whole must be so as written, too. 1e3 and 5.000 are whole.
    text = F.trim(given.cast("string"))
    exact = F.when(text.rlike("[eE]"), given.cast("double") == c.cast("double")).otherwise(~text.rlike("[.][0-9]*[1-9]"))
    good = exact & (c == F.floor(c)) & (c >= 0) & (c <= F.lit(str(UINT8_MAX)).cast("decimal(38,0)"))
    return F.when(c.isNull(), F.lit(None)).when(good, c.cast(UINT8)).otherwise(F.raise_error(F.concat(F.lit("out of range for uint8: "), c.cast("string"))).cast(UINT8))


def uint8_from_bigint(column: str | Column) -> Column:
    """The same 64 bits, read as unsigned."""
    c = (F.col(column) if isinstance(column, str) else column).cast("decimal(21,0)")
    return F.when(c < 0, c + F.lit(str(1 << 64)).cast("decimal(21,0)")).otherwise(c).cast(UINT8)


def uint8_to_bigint(column: str | Column) -> Column:
    """The same 64 bits, read as signed."""
    c = (F.col(column) if isinstance(column, str) else column).cast("decimal(21,0)")
    return F.when(c >= F.lit(str(1 << 63)).cast("decimal(21,0)"), c - F.lit(str(1 << 64)).cast("decimal(21,0)")).otherwise(c).cast("long")


def uint8_send(column: str | Column) -> Column:
    """Eight bytes, big endian."""
    return F.unhex(F.lpad(F.hex(uint8_to_bigint(column)), 16, "0"))


def uint8_recv(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.conv(F.hex(c), 16, 10).cast(UINT8)


def array_contains_all(column: str | Column, values: list) -> Column:
    """``array @> values``; a null among the values is contained by nothing."""
    c = F.col(column) if isinstance(column, str) else column
    if any(v is None for v in values):
        return F.when(c.isNull(), F.lit(None)).otherwise(F.lit(False))
    if not values:
        return F.when(c.isNull(), F.lit(None)).otherwise(F.lit(True))
    return F.size(F.array_except(F.array(*(F.lit(v) for v in values)), c)) == 0


def _element_contains(value):
    return lambda x: _contains(x, value, "$")


def _step(path: str, key: str) -> str:
    """A path to a key, quoted by whichever quote it lacks."""
    if "'" not in key:
        return f"{path}['{key}']"
    if '"' not in key:
        return f'{path}["{key}"]'
    raise ValueError(f"a key with both quotes can't be looked up: {key!r}")


def _contains(c: Column, value, path: str) -> Column:
    # The kind, whose text is dear, is asked last: of what holds the value already.
    kind = F.schema_of_variant(F.try_variant_get(c, path, "variant"))
    if isinstance(value, dict):
        out = None  # a path to a key leads through objects only
        for k, v in value.items():
            one = _contains(c, v, _step(path, k))
            out = one if out is None else out & one
        return F.coalesce(kind.startswith("OBJECT"), F.lit(False)) if out is None else out
    if isinstance(value, list):
        items = F.try_variant_get(c, path, "array<variant>")
        out = items.isNotNull()
        for v in value:
            out = out & F.exists(items, _element_contains(v))
        return F.coalesce(out, F.lit(False))
    if value is None:
        return F.coalesce(kind == "VOID", F.lit(False))
    if isinstance(value, bool):
        return F.coalesce((F.try_variant_get(c, path, "boolean") == value) & (kind == "BOOLEAN"), F.lit(False))
    if isinstance(value, int | float):
        same = F.try_variant_get(c, path, "double") == float(value)
        number, double = Decimal(repr(value)), kind.isin("DOUBLE", "FLOAT")
        if abs(number) < 10**27 and number == int(number):  # whole numbers are compared by all their digits
            exact = double | (F.try_variant_get(c, path, "decimal(38,10)") == F.lit(str(int(number))).cast("decimal(38,10)"))
        else:
            exact = F.lit(True)
        return F.coalesce(same & (kind.startswith("DECIMAL") | double | kind.isin("BIGINT", "INT")) & exact, F.lit(False))
    return F.coalesce((F.try_variant_get(c, path, "string") == value) & (kind == "STRING"), F.lit(False))


def jsonb_contains(column: str | Column, value: str | dict | list) -> Column:
    """``jsonb @> value``: objects contain their keys' values, arrays some element for each, numbers by value. Null in, null out.

    An array at the top also contains a scalar that is one of its elements.
    """
    c = F.try_parse_json(column if isinstance(column, str) else column)
    value = json.loads(value) if isinstance(value, str) else value
    out = _contains(c, value, "$")
    if not isinstance(value, dict | list):
        out = out | F.coalesce(F.exists(F.try_variant_get(c, "$", "array<variant>"), _element_contains(value)), F.lit(False))
    return F.when(c.isNull(), F.lit(None)).otherwise(out)


def jsonb_exists(column: str | Column, key: str) -> Column:
    """``jsonb ? key``: a top-level key, also one with a null value."""
    return F.array_contains(F.json_object_keys(column if isinstance(column, str) else column), key)
