"""A key-value store as a log of batches: the newest entry of a key wins.

Each batch is one immutable write of (key, value, seq, gone) rows, so a batch is atomic
and readers of an older sequence number keep their view.  Keys and values have any length.  Of
entries of one key in one batch the largest value wins.  ``compact`` folds the log into
one entry for each live key; levels have no counterpart beyond that.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import Catalog, Field, Version
from . import dml


class KeyValueStore:
    FIELDS = (Field("key", "string"), Field("value", "string", nullable=True), Field("seq", "int"), Field("gone", "int"))

    def __init__(self, spark: SparkSession, path: str, name: str = "kv"):
        self.spark, self.name = spark, name
        self.catalog = Catalog(spark, path)
        if not self.catalog.exists(name):
            self.catalog.create(name, list(self.FIELDS))

    def _write(self, rows: DataFrame, version: Version | None = None) -> int:
        """Append a batch under the next sequence number; fails if another writer took it."""
        v = version or self.catalog.current(self.name)
        v = replace(v, fields=list(self.FIELDS))  # stores from before had bounded strings
        seq = v.number + 1
        self.catalog.publish(self.name, dml.insert(self.catalog, self.name, rows.withColumn("seq", F.lit(seq)), v), v.number)
        return seq

    def put(self, rows: DataFrame, version: Version | None = None) -> int:
        """All (key, value) rows or none. A pinned version makes it conditional on nothing having changed."""
        return self._write(rows.select("key", "value", F.lit(0).alias("gone")), version)

    def remove(self, keys: DataFrame) -> int:
        return self._write(keys.select("key", F.lit(None).cast("string").alias("value"), F.lit(1).alias("gone")))

    def pin(self) -> Version:
        return self.catalog.current(self.name)

    def scan(self, condition: Column | None = None, version: Version | None = None) -> DataFrame:
        """Live (key, value) rows; a condition on the key is pushed into the files."""
        log = self.catalog.frame(self.name, version)
        log = log if condition is None else log.where(condition)
        return dml.latest_by_key(log.withColumn("removed", F.col("gone") == 1), "key", F.struct("seq", "value"), "removed").select("key", "value")

    def get(self, key: str, version: Version | None = None) -> str | None:
        r = self.scan(F.col("key") == key, version).first()
        return r["value"] if r else None

    def compact(self, files: int | None = None) -> None:
        """Fold the log, into so many files or as many as its size asks for; older pinned versions stay readable."""
        v = self.catalog.current(self.name)
        live = self.scan(version=v).select("key", "value", F.lit(v.number + 1).alias("seq"), F.lit(0).alias("gone"))
        live = live.repartitionByRange(files, "key") if files else live.repartitionByRange("key")
        self.catalog.publish(self.name, replace(v, files=self.catalog.store(self.name, live.sortWithinPartitions("key"), v)), v.number)
