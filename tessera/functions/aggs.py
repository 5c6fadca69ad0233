"""The five aggregates with their argument rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = ("int", "bigint", "float", "double")


class AggregateError(ValueError):
    pass


def check(name: str, args: list[str]) -> None:
    """One argument exactly; only count takes a star."""
    if name.lower() not in ("count", "sum", "avg", "min", "max"):
        raise AggregateError(f"unknown aggregate {name}")
    if len(args) != 1 or not args[0].strip():
        raise AggregateError(f"{name} takes one argument")
    if args[0].strip() == "*" and name.lower() != "count":
        raise AggregateError(f"{name}(*) is not allowed")


def aggregate(name: str, arg: str, kind: str | None = None) -> Column:
    """A checked aggregate over an expression; ``kind`` is the argument's type."""
    check(name, [arg])
    name = name.lower()
    if name in ("sum", "avg") and kind is not None and kind not in NUMERIC:
        raise AggregateError(f"{name} needs a number, not {kind}")
    if name == "count":
        return F.count(F.lit(1) if arg.strip() == "*" else F.expr(arg))
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[name](F.expr(arg))
