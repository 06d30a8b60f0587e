"""Range values as structs (lower, upper, lower_inc, upper_inc, empty), and enums by declaration order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make_range(lower, upper, bounds: str = "[)") -> Column:
    """A range; a null bound is infinite. Lower above upper raises; equal bounds that aren't both closed are empty."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (lower, upper))
    open_low, open_high = bounds[0] == "(", bounds[1] == ")"
    empty = F.coalesce((low == high) & F.lit(open_low or open_high), F.lit(False))
    checked = F.when(low > high, F.raise_error(F.lit("range lower bound must be less than or equal to range upper bound")).cast("boolean")).otherwise(empty)
    return F.struct(
        F.when(~empty, low).alias("lower"),
        F.when(~empty, high).alias("upper"),
        (~empty & low.isNotNull() & F.lit(not open_low)).alias("lower_inc"),
        (~empty & high.isNotNull() & F.lit(not open_high)).alias("upper_inc"),
        checked.alias("empty"),
    )


def range_contains(r: Column, value) -> Column:
    v = value if isinstance(value, Column) else F.lit(value)
    above = r["lower"].isNull() | (v > r["lower"]) | (r["lower_inc"] & (v == r["lower"]))
    below = r["upper"].isNull() | (v < r["upper"]) | (r["upper_inc"] & (v == r["upper"]))
    return ~r["empty"] & above & below


def range_overlaps(a: Column, b: Column) -> Column:
    def before(x: Column, y: Column) -> Column:
        """x ends before y begins."""
        return F.coalesce((x["upper"] < y["lower"]) | ((x["upper"] == y["lower"]) & ~(x["upper_inc"] & y["lower_inc"])), F.lit(False))

    return ~a["empty"] & ~b["empty"] & ~before(a, b) & ~before(b, a)


def range_order(r: Column) -> Column:
    """A sort key: empty ranges first, infinite lower bounds next, then by lower and upper bound, closed before open below and open before closed above."""
    return F.struct(~r["empty"], r["lower"].isNotNull(), r["lower"], ~r["lower_inc"], r["upper"].isNull(), r["upper"], r["upper_inc"])


def enum_ordinal(column: str | Column, labels: list[str]) -> Column:
    """The place of a label in its enum's declaration; unknown labels raise."""
    c = F.col(column) if isinstance(column, str) else column
    place = F.array_position(F.array(*(F.lit(x) for x in labels)), c)
    return F.when(c.isNull(), F.lit(None)).when(place > 0, place).otherwise(F.raise_error(F.concat(F.lit("invalid enum value: "), c)).cast("long"))
