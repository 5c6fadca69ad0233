"""Shared plumbing of the corpus operators: scratch tables and links."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir.

    Only where that is unset (a local session in tests) a temporary folder takes
    its place, and only on a local master, whose executors share the driver's disk.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


#: Seconds from one ``tidy_executors`` of ``stash`` to the next, at least.
TIDY_EVERY = 5.0
_tidied = 0.0


def tidy_executors(spark: SparkSession) -> None:
    """A full collection in each executor, by a task on each core: heap that grew on garbage goes back to the system."""
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')").alias("gc"))
    rows.write.format("noop").mode("overwrite").save()


def stash(df: DataFrame, name: str, batch_rows: int = 2000) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors.

    Arrow batches to and from Python hold at most ``batch_rows`` rows meanwhile.  The files stay
    until ``release`` or until the folder is cleaned.

    The driver is then rid of what its plans and tasks left: with many tasks a stage the heap else grows to its
    limit on garbage, beside about as much memory outside it, though little of either is in use.  Executors are too,
    every few seconds: no task of this table runs then.
    """
    global _tidied
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(batch_rows, int(before)) if int(before) > 0 else batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    gc.collect()
    spark._jvm.System.gc()
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local" and time.monotonic() - _tidied >= TIDY_EVERY:
        tidy_executors(spark)
        _tidied = time.monotonic()
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of stashed tables that no plan reads any more."""
    for df in frames:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df._stashed)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bits of the filter of ``hit_or_not`` at least and at most (16 MB), and in one row of it.
LEAST_BITS, MOST_BITS, FILTER_PAGE = 1 << 20, 1 << 27, 1 << 15


def hit_or_not(rows: DataFrame, key: Column, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two parts: those whose key may be among ``hits`` (one column of longs) and those whose key is not.

    The keys make a bitmap of 16 to 32 bits a key that is broadcast, so the second part needs no shuffle.  It has
    ``MOST_BITS`` at most; with very many keys it fills, and the first part is all rows.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * hits.count()).bit_length()))
    place = F.pmod(F.col(hits.columns[0]), F.lit(bits))
    pages = hits.select(place.alias("p")).groupBy(F.floor(F.col("p") / FILTER_PAGE).cast("int").alias("_page")).agg(
        F.bitmap_construct_agg(F.col("p") % FILTER_PAGE).alias("_bits"))
    pages = F.broadcast(stash(pages, "filter"))
    at = F.pmod(key, F.lit(bits))
    named = rows.select(F.struct("*").alias("_row"), F.floor(at / FILTER_PAGE).cast("int").alias("_page"), (at % FILTER_PAGE).cast("int").alias("_at"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.pow(F.lit(2), F.col("_at") % 8).cast("int")) != 0
    found = named.join(pages, "_page", "left").select("_row", F.coalesce(bit, F.lit(False)).alias("_hit"))
    return found.where("_hit").select("_row.*"), found.where("NOT _hit").select("_row.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): (node, component) for each node but the smallest of its
    group, which is the component.

    Alternating large-star and small-star steps until nothing changes: every step is a grouped minimum
    and an equi-join, so nothing is gathered in one task or on the driver, and a
    group of any size shrinks to a star in logarithmically many steps.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stash(edges, "links")
    last = now = None
    while now is None or now != last:
        last = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, edges = edges, stash(small.where("u <> v").distinct(), "links")
        release(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
