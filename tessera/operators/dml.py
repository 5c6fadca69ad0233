"""Insert, update and delete as new versions of a table.

Only files that hold a matching row are rewritten; the others are carried over, so
the cost of a change follows the data it touches.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Catalog, CatalogError, Version, conform


def delete_frame(df: DataFrame, condition: str) -> DataFrame:
    """Rows that a DELETE leaves: those for which the condition is false or unknown."""
    return df.where(~F.coalesce(F.expr(condition), F.lit(False)))


def update_frame(df: DataFrame, sets: dict[str, str], condition: str = "true") -> DataFrame:
    """Rows after an UPDATE; the new values see the old row."""
    hit = F.coalesce(F.expr(condition), F.lit(False))
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(hit, F.expr(v).cast(kinds[c])).otherwise(F.col(c)) for c, v in sets.items()})


def check_unique(rows: DataFrame, columns: list[str]) -> None:
    """An error if two rows share a key without a null; one grouped count, checked by its first hit."""
    keyed = rows.dropna(subset=columns).groupBy(*columns).count().where("count > 1")
    if keyed.limit(1).count():
        raise CatalogError(f"duplicate key in ({', '.join(columns)})")


def check_new_keys(catalog: Catalog, name: str, v: Version, files: list[str], kept: list[str], keys: list[list[str]]) -> None:
    """An error if rows in ``files`` repeat a key among themselves or one in the ``kept`` files.

    Only the new rows are grouped.  Old rows are read between the least and the greatest new key,
    which prunes files and row groups, and meet the new keys in a semi join.
    """
    new = catalog.frame(name, replace(v, files=files))
    for columns in keys:
        check_unique(new, columns)
        if not kept:
            continue
        first = columns[0]
        low, high = new.agg(F.min(first), F.max(first)).first()
        if low is None:
            continue
        old = catalog.frame(name, replace(v, files=kept)).where(F.col(first).between(low, high)).select(*columns)
        if old.join(new.select(*columns), columns, "left_semi").limit(1).count():
            raise CatalogError(f"duplicate key in ({', '.join(columns)})")


def insert(catalog: Catalog, name: str, rows: DataFrame, v: Version) -> Version:
    """All rows or none."""
    files = catalog.store(name, conform(rows, v), v)
    try:
        check_new_keys(catalog, name, v, files, v.files, v.keys)
    except CatalogError:
        catalog.discard(files)
        raise
    return replace(v, files=v.files + files, rows=None)


def _rewrite(catalog: Catalog, name: str, v: Version, condition: str, change, keys: list[list[str]] = ()) -> tuple[Version, int]:
    if not v.files:
        catalog.frame(name, v).where(condition)  # names are checked all the same
        return v, 0
    df = catalog.frame(name, v)
    hits = df.where(condition).groupBy(F.col("_metadata.file_path").alias("f")).count().collect()
    if not hits:
        return v, 0
    path = lambda p: p.split(":", 1)[-1].replace("///", "/")
    touched = {path(r["f"]) for r in hits}
    old = [f for f in v.files if path(f) in touched]
    kept = [f for f in v.files if path(f) not in touched]
    files = catalog.store(name, conform(change(catalog.frame(name, replace(v, files=old))), v), v)
    try:
        check_new_keys(catalog, name, v, files, kept, list(keys))
    except CatalogError:
        catalog.discard(files)
        raise
    return replace(v, files=kept + files, rows=None), sum(r["count"] for r in hits)


def delete(catalog: Catalog, name: str, v: Version, condition: str = "true") -> tuple[Version, int]:
    return _rewrite(catalog, name, v, condition, lambda df: delete_frame(df, condition))


def update(catalog: Catalog, name: str, v: Version, sets: dict[str, str], condition: str = "true") -> tuple[Version, int]:
    changed = {v.column(c).name for c in sets}
    keys = [k for k in v.keys if changed & {v.column(c).name for c in k}]
    return _rewrite(catalog, name, v, condition, lambda df: update_frame(df, sets, condition), keys)


def compact(catalog: Catalog, name: str, files: int) -> None:
    """Rewrite a table's rows into so many files, clustered by its first index."""
    v = catalog.current(name)
    order = v.indexes[0].columns if v.indexes else v.primary_key
    df = catalog.frame(name, v)
    df = df.repartitionByRange(files, *order) if order else df.repartition(files)
    catalog.publish(name, replace(v, files=catalog.store(name, df, v)), v.number)


def latest_by_key(log: DataFrame, key: str, order: str | Column, deleted: str | None = None) -> DataFrame:
    """The newest entry of each key; keys whose newest entry is a deletion go. One grouped maximum."""
    newest = log.groupBy(key).agg(F.max_by(F.struct("*"), F.col(order) if isinstance(order, str) else order).alias("r")).select("r.*")
    return newest.where(~F.col(deleted)) if deleted else newest
