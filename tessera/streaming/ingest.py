"""Continuous loading: delimited files that arrive in a folder are appended to a table.

An extension beyond the relational surface: the same schema rules as LOAD DATA.  A version
records the last batch of each stream that it holds, so a batch that is replayed after a
failure is not added twice.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import dml
from ..sources.catalog import Catalog


def follow(spark: SparkSession, catalog: Catalog, name: str, folder: str, checkpoint: str, sep: str = "|") -> StreamingQuery:
    """Append every new file's rows as a version; processes what is there, then stops."""
    v = catalog.current(name)
    schema = T.StructType([T.StructField(f.name, f.type) for f in v.fields])
    rows = spark.readStream.schema(schema).option("sep", sep).option("mode", "FAILFAST").csv(folder)

    def append(batch, epoch: int) -> None:
        now = catalog.current(name)
        if now.batches.get(checkpoint, -1) >= epoch:
            return
        catalog.publish(name, replace(dml.insert(catalog, name, batch, now), batches=now.batches | {checkpoint: epoch}), now.number)

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
