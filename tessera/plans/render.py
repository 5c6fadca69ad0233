"""Text output of results."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame


def cell(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, float):
        text = re.sub(r"\.?0+$", "", f"{v:.2f}")
        return "0" if text == "-0" else text
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return str(v)


def render(df: DataFrame, names: list[str] | None = None) -> str:
    """'a | b' lines with a header, also for an empty result. Rows come one partition at a time."""
    lines = [" | ".join(names or df.columns)]
    lines += [" | ".join(map(cell, r)) for r in df.toLocalIterator()]
    return "\n".join(lines)
