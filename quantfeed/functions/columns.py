"""Column helpers with the rule that missing stays missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and infinities become null; NaN counts as the largest value, so one comparison tells both."""
    return F.when(F.abs(x) < float("inf"), x)


def divide(a: Column, b: Column) -> Column:
    """a / b; null for a zero or missing divisor."""
    return finite(F.try_divide(a, b))


def clip(x: Column) -> Column:
    """x within 0..100; null stays null."""
    return F.when(x < 0, F.lit(0.0)).when(x > 100, F.lit(100.0)).otherwise(x)


def scale(v: Column, center: float, span: float, invert: bool = False) -> Column:
    """A reading as a 0..100 score: 50 at the center, one span away is an end; 50 if the span is 0."""
    if span == 0:
        return F.when(v.isNotNull(), F.lit(50.0))
    sign = -50.0 if invert else 50.0
    return clip(50.0 + sign * (v - center) / span)


def mean_of(*parts: Column) -> Column:
    """Mean of the parts that aren't null; null if none is."""
    begin = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    add = lambda a, x: F.struct((a["s"] + F.coalesce(x, F.lit(0.0))).alias("s"), (a["n"] + x.isNotNull().cast("int")).alias("n"))
    # One pass names each part once, so that means of means stay small expressions.
    return F.aggregate(F.array(*parts), begin, add, lambda a: F.when(a["n"] > 0, a["s"] / a["n"]))


def rounded_half_up(x: Column, digits: int) -> Column:
    """What F.round gives for a double, without decimal numbers unless it is large or close to a tie.

    Below 1e12 the product is off by under 1e-3, so further than that from a tie its integer is the right one, and the
    quotient of two exact doubles is the double closest to that decimal.
    """
    y = x * 10.0**digits
    k = F.rint(y)
    return F.when((F.abs(y) < 1e12) & (F.abs(y - k) < 0.499), k / 10.0**digits + 0.0).otherwise(F.round(x, digits))


def number(text: Column) -> Column:
    """Loose number: null, empty, ``-`` and anything unparsable give null."""
    return finite(F.trim(text).try_cast("double"))
