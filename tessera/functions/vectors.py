"""Vectors as arrays of floats: literals, arithmetic, comparison and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DIM = 16_000


def parse(s: Column, dim: int | None = None) -> Column:
    """'[1,2,3]' to a vector; a wrong dimension or syntax is an error."""
    v = F.from_json(s, "array<float>", {"mode": "FAILFAST"})
    return v if dim is None else check_dim(v, dim)


def check_dim(v: Column, dim: int) -> Column:
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"vector({dim}) expected, dimension "), F.size(v).cast("string"))))


def render(v: Column) -> Column:
    """Text form, two decimals at most."""
    one = lambda x: F.regexp_replace(F.format_string("%.2f", x.cast("double")), r"\.?0+$", "")
    return F.concat(F.lit("["), F.array_join(F.transform(v, one), ","), F.lit("]"))


def _same(a: Column, b: Column, value: Column) -> Column:
    """value, or an error where the dimensions differ; null for a null vector."""
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vector dimensions differ")))


def elementwise(op: str, a: Column, b: Column) -> Column:
    ops = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y}
    return _same(a, b, F.zip_with(a, b, ops[op]))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def inner_product(a: Column, b: Column) -> Column:
    return _same(a, b, _sum(F.zip_with(_d(a), _d(b), lambda x, y: x * y)))


def l2_distance(a: Column, b: Column) -> Column:
    return _same(a, b, F.sqrt(_sum(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector has norm zero."""
    norms = F.sqrt(_sum(F.transform(_d(a), lambda x: x * x))) * F.sqrt(_sum(F.transform(_d(b), lambda x: x * x)))
    return F.lit(1.0) - F.try_divide(inner_product(a, b), norms)


DISTANCES = {"l2_distance": l2_distance, "cosine_distance": cosine_distance, "inner_product": inner_product}

_SAME = "CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN size({a}) = size({b}) THEN %s ELSE raise_error('vector dimensions differ') END"
_TOTAL = "aggregate(%s, 0D, (s, x) -> s + x)"
_PAIRS = "zip_with(CAST({a} AS ARRAY<DOUBLE>), CAST({b} AS ARRAY<DOUBLE>), (x, y) -> %s)"
_NORM = "sqrt(" + _TOTAL % "transform(CAST({%s} AS ARRAY<DOUBLE>), x -> x * x)" + ")"
_EACH = "zip_with({a}, {b}, (x, y) -> x %s y)"
#: The same as SQL text with places for two operands.
SQL_FORMS = {
    "l2_distance": _SAME % f"sqrt({_TOTAL % (_PAIRS % '(x - y) * (x - y)')})",
    "inner_product": _SAME % (_TOTAL % (_PAIRS % "x * y")),
    "cosine_distance": _SAME % f"1D - try_divide({_TOTAL % (_PAIRS % 'x * y')}, {_NORM % 'a'} * {_NORM % 'b'})",
    **{op: _SAME % (_EACH % op) for op in "+-*"},
}
