"""Scalar semantics that Spark does not have built in, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest 32-bit float, and the tolerance of float comparison.
FLT_MAX = 3.4028234663852886e38
EPSILON = 1e-6
TEXT_BYTES = 4096


def div_sat(a: Column, b: Column) -> Column:
    """Division that saturates at FLT_MAX where the divisor is within EPSILON of zero."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(F.abs(b) < EPSILON, F.lit(FLT_MAX)).otherwise(F.try_divide(a, b))


def div_null(a: Column, b: Column) -> Column:
    """Division that is null where the divisor is zero, for predicates."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def eps_eq(a: Column, b: Column) -> Column:
    """Float equality within EPSILON; not for join keys, as it is not transitive."""
    return F.abs(a.cast("double") - b.cast("double")) < EPSILON


def str_to_num(s: Column) -> Column:
    """Number from the longest numeric prefix; 0 where there is none."""
    head = F.regexp_extract(s, r"^\s*([+-]?(\d+(\.\d*)?|\.\d+))", 1)
    return F.coalesce(F.when(head != "", head.try_cast("double")), F.when(s.isNotNull(), F.lit(0.0)))


def fmt_num(x: Column) -> Column:
    """Two decimals, trailing zeros removed."""
    return F.regexp_replace(F.format_string("%.2f", x.cast("double")), r"\.?0+$", "")


def char_trunc(s: Column, n: int) -> Column:
    """A CHAR(n) value: longer input is cut."""
    return F.substring(s, 1, n)


def truthy(x: Column, kind: str) -> Column:
    """Truth of a value of type int, float or char."""
    if kind == "int":
        return x != 0
    if kind == "float":
        return F.abs(x) > EPSILON
    return F.coalesce(x.try_cast("double") != 0, x.isNotNull())
