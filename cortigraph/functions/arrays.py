"""Array expressions over one signal per row: all built-in, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once per row.

    A column that is used inside a lambda may be inlined there by the optimizer
    and computed again for every element; a bound value is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def mean(v: Column) -> Column:
    return let(v, lambda x: F.try_divide(total(x), F.size(x)))


def variance(v: Column) -> Column:
    """Population variance in two passes."""
    squares = lambda x, m: F.aggregate(x, F.lit(0.0), lambda s, y: s + (y - m) * (y - m))
    return let(v, lambda x: let(mean(x), lambda m: F.try_divide(squares(x, m), F.size(x))))


def deviation(v: Column) -> Column:
    return F.sqrt(variance(v))


def quantile(v: Column, q: float) -> Column:
    """Quantile with linear interpolation."""

    def of(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(q)
        lo = F.floor(at).cast("int")
        a, b = F.get(s, lo), F.get(s, F.least(lo + 1, F.size(s) - 1))
        return a + (b - a) * (at - lo)

    return let(F.array_sort(v), of)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def at_least(x: Column, floor: float, instead: float) -> Column:
    return F.when(x < floor, F.lit(instead)).otherwise(x)


def linspace(lo: Column, hi: Column, k: int, i: Column) -> Column:
    return lo + (hi - lo) * i / F.lit(max(1, k - 1))


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def cleaned(v: Column, instead: float = 0.0) -> Column:
    """Null, NaN and infinite values replaced."""
    return F.transform(v, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(instead)).otherwise(x))


def unit_hash(*c: Column) -> Column:
    """Uniform number in (0, 1) that depends on the values alone, not on partitioning."""
    return (F.shiftrightunsigned(F.xxhash64(*c), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def normal_hash(*c: Column) -> Column:
    """Standard normal number by Box-Muller from two hashes."""
    return F.sqrt(-2 * F.log(unit_hash(*c, F.lit(1)))) * F.cos(2 * 3.141592653589793 * unit_hash(*c, F.lit(2)))
