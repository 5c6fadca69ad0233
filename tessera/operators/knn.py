"""Nearest neighbours: exact, and by an inverted file of clusters.

The index is a table partitioned by cluster, so a search with few probes reads only
those clusters' files.  Clusters are fitted on a bounded sample, every row is assigned.  How
many lists a search must probe depends on the vectors, so ``calibrate`` measures recall on a
bounded sample of queries and takes the fewest probes that reach a target.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import DISTANCES

#: Rows that clusters are fitted on, queries that recall is measured on, vectors of one block of a cluster.
FIT_ROWS, PROBE_QUERIES, BLOCK = 200_000, 64, 4096


def _within(last: float, distance: str, within: float, scale: float) -> float:
    """The gap up to which a row may still rank with one of gap ``last``: distances differ by less than ``within``, or by what the product of matrices is inexact."""
    noise = 1e-12 * (1 + scale)
    return (np.sqrt(max(last, 0.0)) + within + noise) ** 2 + noise if distance == "l2_distance" else last + within + noise


def _distances(x: np.ndarray, q: np.ndarray, distance: str) -> np.ndarray:
    """The distances of rows from one query, summed in the order of the expressions, so equal ones are equal here too."""
    def total(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for i in range(x.shape[1]):
            out += a[..., i] * b[..., i]
        return out

    if distance == "l2_distance":
        return np.sqrt(total(x - q, x - q))
    if distance == "inner_product":
        return total(x, q)
    norms = np.sqrt(total(x, x)) * np.sqrt(total(q, q))
    return 1 - np.divide(total(x, q), norms, out=np.full(len(x), np.nan), where=norms > 0)


def _literal(q: list[float]):
    return F.array(*[F.lit(float(x)) for x in q])


def exact(df: DataFrame, column: str, q: list[float], k: int, distance: str = "l2_distance", key: str | None = None) -> DataFrame:
    """The k nearest rows; partial top-k in each task, then one merge of k rows a task."""
    d = DISTANCES[distance](F.col(column), _literal(q))
    order = F.col("distance").desc() if distance == "inner_product" else F.col("distance").asc()
    rows = df.withColumn("distance", d).where(F.col("distance").isNotNull())
    return rows.orderBy(order, *([key] if key else [])).limit(k)


def gaps(centroids: np.ndarray, q: np.ndarray, distance: str, largest: bool) -> np.ndarray:
    """How far each query (rows) is from each centroid (columns): smaller is nearer in the order that a search asks for."""
    if distance == "l2_distance":
        d = (q * q).sum(axis=1)[:, None] - 2 * q @ centroids.T + (centroids * centroids).sum(axis=1)
    else:
        d = q @ centroids.T
        if distance == "cosine_distance":
            norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(centroids, axis=1)
            d = 1 - np.divide(d, norms, out=np.zeros_like(d), where=norms > 0)
    return -d if largest else d


@dataclass
class IvfIndex:
    column: str
    distance: str
    table: DataFrame
    centroids: list[list[float]]

    @classmethod
    def build(cls, df: DataFrame, column: str, lists: int | None, path: str, distance: str = "l2_distance", seed: int = 7, sample: int = FIT_ROWS) -> IvfIndex:
        """Cluster a bounded sample, assign every row, write by cluster; about a square root of lists by default."""
        spark = df.sparkSession
        rows = df.where(F.col(column).isNotNull())
        features = rows.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))
        n = rows.count()
        lists = max(1, min(lists or math.isqrt(n), n))
        if lists > 1:
            fitted = features if n <= sample else features.sample(min(1.0, 1.1 * sample / n), seed)
            model: KMeansModel = KMeans(k=lists, seed=seed, maxIter=10).fit(fitted)
            placed = model.transform(features).withColumnRenamed("prediction", "cluster_id").drop("features")
            centroids = [list(map(float, c)) for c in model.clusterCenters()]
        else:
            width = rows.agg(F.max(F.size(column))).first()[0] or 0
            mean = rows.agg(*[F.avg(F.get(F.col(column), i)) for i in range(width)]).first() if width else ()
            placed, centroids = rows.withColumn("cluster_id", F.lit(0)), [[float(x) for x in mean]]
        # Rows of a cluster go together, and a cluster of any size is split where it is too large.
        placed.hint("rebalance", "cluster_id").write.mode("overwrite").partitionBy("cluster_id").parquet(path)
        spec = rows.withColumn("cluster_id", F.lit(0)).schema
        return cls(column, distance, spark.read.schema(spec).parquet(path), centroids)

    def near(self, q: list[float], probes: int, largest: bool = False) -> list[int]:
        """The lists to read, in the order of the index's own distance."""
        d = gaps(np.array(self.centroids), np.array([q], float), self.distance, largest)[0]
        return np.argsort(d, kind="stable")[:probes].tolist()

    def search(self, q: list[float], k: int, probes: int, key: str | None = None) -> DataFrame:
        """Rank centroids, read the nearest ``probes`` clusters, search them exactly."""
        near = self.near(q, probes, self.distance == "inner_product")
        return exact(self.table.where(F.col("cluster_id").isin(near)), self.column, q, k, self.distance, key).drop("cluster_id")

    def search_many(self, queries: DataFrame, query_key: str, query_column: str, k: int, probes: int, key: str, digits: int | None = None) -> DataFrame:
        """The k nearest for each row of ``queries``, but for the row itself: (query_id, rank, key, distance).

        With ``digits``, distances are rounded before they are ranked; equal ones go by ``key``.

        Queries go to their nearest clusters; a cluster meets its queries in blocks of at most
        ``BLOCK`` vectors and as many queries, as a product of matrices, and gives for each query the rows that
        may be among its k, at most k of one distance.
        """
        centroids, distance, largest = np.array(self.centroids), self.distance, self.distance == "inner_product"
        within = 0.0 if digits is None else 10.0**-digits

        def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                q = _matrix(batch.column("v"))
                near = np.argsort(gaps(centroids, q, distance, largest), axis=1, kind="stable")[:, :probes] if len(centroids) > 1 else np.zeros((len(q), 1), int)
                row = np.repeat(np.arange(len(q)), near.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), batch.column("v").take(pa.array(row)), pa.array(near.ravel().astype(np.int32))], ["id", "v", "cluster_id"])

        def meet(_, rows: pa.Table, asked: pa.Table) -> pa.Table:
            ids, qids = (t.column("id").combine_chunks().to_numpy() for t in (rows, asked))
            out = []
            if len(ids) and len(qids):
                x = _matrix(rows.column("v").combine_chunks())
                longest = np.nanmax((x * x).sum(axis=1), initial=0.0)
                for a in range(0, len(qids), 512):
                    q = _matrix(asked.column("v").combine_chunks().slice(a, 512))
                    d = gaps(x, q, distance, largest)
                    d[qids[a : a + 512, None] == ids] = np.inf
                    for j in range(len(q)):
                        some = np.arange(len(ids))
                        if len(ids) > k:
                            last = np.partition(d[j], k - 1)[k - 1]
                            some = np.flatnonzero(d[j] <= _within(last, distance, within, longest + (q[j] * q[j]).sum()))
                        best = some
                        if len(some) > k:
                            own = _distances(x[some], q[j], distance)
                            order = np.lexsort((ids[some], own))
                            own = own[order]
                            best = some[order[np.arange(len(own)) - np.searchsorted(own, own, "left") < k]]
                        best = best[d[j][best] < np.inf]
                        out.append((np.full(len(best), qids[a + j]), ids[best]))
            q, i = (np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else ((), ())))
            return pa.table({"query_id": pa.array(q, pa.int64()), "id": pa.array(i, pa.int64())})

        ask = queries.where(F.col(query_column).isNotNull()).select(F.col(query_key).cast("long").alias("id"), F.col(query_column).cast("array<double>").alias("v"))
        ask = ask.mapInArrow(place, "id long, v array<double>, cluster_id int")
        held = self.table.select(F.col(key).cast("long").alias("id"), F.col(self.column).cast("array<double>").alias("v"), "cluster_id")
        sizes = held.groupBy("cluster_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nx")).join(
            ask.groupBy("cluster_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nq")), "cluster_id")
        held = held.join(sizes, "cluster_id").select("id", "v", "cluster_id", F.pmod(F.xxhash64("id"), "nx").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("j"))
        ask = ask.join(sizes, "cluster_id").select("id", "v", "cluster_id", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("i"), F.pmod(F.xxhash64("id"), "nq").cast("int").alias("j"))
        block = ["cluster_id", "i", "j"]
        found = held.groupBy(*block).cogroup(ask.groupBy(*block)).applyInArrow(meet, "query_id long, id long")
        # Few rows are left: their distances are those of the expressions.
        found = found.join(self.table.select(F.col(key).cast("long").alias("id"), F.col(key).alias("_key"), F.col(self.column).alias("v")), "id")
        found = found.join(queries.select(F.col(query_key).cast("long").alias("query_id"), F.col(query_column).alias("q")), "query_id")
        found = found.select("query_id", F.col("_key").alias(key), DISTANCES[self.distance](F.col("v"), F.col("q")).alias("distance")).distinct()
        if digits is not None:
            found = found.withColumn("distance", F.round("distance", digits))
        order = Window.partitionBy("query_id").orderBy(F.desc("distance") if largest else F.asc("distance"), key)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", key, "distance")

    def calibrate(self, k: int, recall: float, key: str, seed: int = 7) -> int:
        """The fewest probes with at least this recall over a bounded sample of the table's own rows."""
        some = self.table.select(key, self.column).orderBy(F.xxhash64(F.lit(seed), key)).limit(PROBE_QUERIES).withColumnsRenamed({key: "q_id", self.column: "q"})
        found = self.search_many(some, "q_id", "q", k, len(self.centroids), key)
        ids = found.join(self.table.select(F.col(key).alias("i"), "cluster_id"), F.col(key) == F.col("i")).select("query_id", "cluster_id").collect()
        asked = {r["q_id"]: r["q"] for r in some.collect()}
        largest = self.distance == "inner_product"
        ranks = {i: np.argsort(np.argsort(gaps(np.array(self.centroids), np.array([q], float), self.distance, largest)[0], kind="stable")) for i, q in asked.items()}
        needed = sorted(int(ranks[r["query_id"]][r["cluster_id"]]) + 1 for r in ids)
        return needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)] if needed else len(self.centroids)


def _matrix(v: pa.ListArray) -> np.ndarray:
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(v), -1) if len(v) else np.zeros((0, 0))


def knn(df: DataFrame, column: str, q: list[float], k: int, distance: str = "l2_distance", index: IvfIndex | None = None, probes: int = 5, key: str | None = None) -> DataFrame:
    """ORDER BY distance LIMIT k, through the index where one fits."""
    if index is not None and index.column == column and index.distance == distance:
        return index.search(q, k, probes, key)
    return exact(df, column, q, k, distance, key)


def exact_many(df: DataFrame, column: str, queries: DataFrame, query_key: str, query_column: str, k: int, key: str, distance: str = "l2_distance", digits: int | None = None) -> DataFrame:
    """The k nearest for each row of ``queries`` among all rows, in blocks: (query_id, rank, key, distance), distances rounded to ``digits`` if given."""
    rows = df.where(F.col(column).isNotNull()).withColumn("cluster_id", F.lit(0))
    return IvfIndex(column, distance, rows, [[]]).search_many(queries, query_key, query_column, k, 1, key, digits)
