"""Exact top-k inner products by aggregation without random access.

Vectors are packed into blocks.  In a block each dimension has a list sorted by
value, read from the top for a query's positive components and from the bottom
for its negative ones, depth by depth.  What has been read adds to a candidate's
score; the list's head bounds what has not been read from above and its far end from
below, so every candidate has a lower and an upper bound all the time.  A query stops
when at most a few candidates can still be among its best k, and the scores of those,
no others, are then resolved.  At the full depth both bounds are the score, so a query
that no earlier depth could stop ends by the same rule.  Depths are read for a block of
queries at once, as products of matrices in which a read entry stands for itself and
an unread one for its list's head or far end.

The search is a stated query set against all rows, in blocks: blocks of at most
``QUERIES`` queries meet blocks of at most ``ROWS`` vectors in an equi-join on the
place they are dealt to, and every pair of blocks returns k rows for each query.

Defined results: vectors that are null or hold a null or a non-finite component take
no part; nor do empty ones.  Vectors of different lengths do not meet.  Ties go to
the smaller id.  A query with no candidate has no rows.  Rows that repeat an id are
one before blocks are built, with the smallest of their usable vectors (as arrays
compare); a query's own id is not its candidate.  Components beyond ``LARGEST`` in
magnitude count as that.  Scores are exact integers; one that a long cannot hold
counts as the nearest long, and ties there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROWS, QUERIES = 4096, 1024
#: Shares of the lists that have been read when bounds are compared; the last is all of them.
DEPTHS = (0.05, 0.3, 0.7, 0.85, 0.93, 0.97, 1.0)
LARGEST = 2.0**500
#: Products below this are exact in 32-bit and in 64-bit floats.
EXACT_32, EXACT_64 = 2.0**22, 2.0**52
BLOCKS = "dim int, n int, ids binary, data binary"


def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad


def _blocks(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size: dict[int, int] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids = np.concatenate([x for x, _ in held[dim]])
            data = np.concatenate([y for _, y in held[dim]])
            held[dim], size[dim] = [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())],
                ["dim", "n", "ids", "data"])

        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            vectors = batch.column("v")
            dims = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(dims)])
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                part = flat[(starts[own][:, None] + np.arange(dim)).ravel()].reshape(len(own), dim)
                part = np.floor(256 * np.clip(part, -LARGEST, LARGEST))
                for a in range(0, len(own), rows):
                    piece = (ids[own[a : a + rows]], part[a : a + rows])
                    if size.get(dim, 0) + len(piece[0]) > rows:
                        yield out(dim)
                    held.setdefault(dim, []).append(piece)
                    size[dim] = size.get(dim, 0) + len(piece[0])
        for dim in [d for d, n in size.items() if n]:
            yield out(dim)

    return run


def resolve(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Scores of some candidates for one query; by Python's integers where floats are not exact."""
    if exact:
        return (x @ q).astype(np.int64)
    low, high = -(2**63), 2**63 - 1
    whole = [int(v) for v in q]
    return np.array([min(max(sum(int(v) * w for v, w in zip(row, whole)), low), high) for row in x], np.int64)


def search_block(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, closed: dict[float, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (query id, vector id, score) of each query's k best candidates in a block; integer-valued components, distinct ids.
    ``closed`` gets how many queries stopped at each depth."""
    n, dim = x.shape
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * dim
    exact = bound < EXACT_64
    kind = np.float32 if bound < EXACT_32 else np.float64
    slack = 0.0 if exact else bound * dim * 2.0**-48  # what rounding can add to a bound
    wide, wide_q = x, q
    x = x.astype(kind)
    # A list for each sign: columns of the values themselves, then of their negatives, both read from the largest.
    both = np.concatenate([x, -x], axis=1)
    weight = np.concatenate([np.maximum(q, 0), np.maximum(-q, 0)], axis=1).astype(kind).T
    order = np.argsort(-both, axis=0, kind="stable")
    place = np.empty((n, 2 * dim), np.int32)
    np.put_along_axis(place, order, np.arange(n, dtype=np.int32)[:, None].repeat(2 * dim, 1), axis=0)
    listed = np.take_along_axis(both, order, axis=0)
    del order
    by = np.argsort(qids, kind="stable")
    lo, hi = np.searchsorted(qids[by], ids, "left"), np.searchsorted(qids[by], ids, "right")
    self_row = np.repeat(np.arange(n), hi - lo)
    self_query = by[np.concatenate([np.arange(a, b) for a, b in zip(lo, hi) if a < b] or [np.zeros(0, np.int64)])]
    few = max(4 * k, n // 64)
    open_ = np.arange(len(q))
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for share in DEPTHS:
        depth = n if share >= 1 else min(n, max(k + 1, int(n * share)))
        if not len(open_):
            break
        w = weight[:, open_]
        read = place < depth
        upper = np.where(read, both, listed[depth - 1]) @ w
        lower = upper if depth == n else np.where(read, both, listed[-1]) @ w
        column = np.full(len(q), -1)
        column[open_] = np.arange(len(open_))
        own = column[self_query] >= 0
        if not exact:
            upper, lower = np.clip(upper, -(2.0**63), 2.0**63), np.clip(lower, -(2.0**63), 2.0**63)
        for side in (upper, lower):
            side[self_row[own], column[self_query[own]]] = -np.inf
        at = min(k, n) - 1
        kth = -np.partition(-lower, at, axis=0)[at]
        alive = (upper >= kth - slack) & (upper > -np.inf)
        stops = np.ones(len(open_), bool) if depth == n else alive.sum(axis=0) <= few
        for j in np.flatnonzero(stops):
            query, rows = int(open_[j]), np.flatnonzero(alive[:, j])
            scores = upper[rows, j].astype(np.int64) if depth == n and exact else resolve(wide[rows], wide_q[query], exact)
            best = np.lexsort((ids[rows], -scores.astype(object) if not exact else -scores))[:k]
            parts.append((np.full(len(best), qids[query]), ids[rows[best]], scores[best]))
        if closed is not None:
            closed[share] = closed.get(share, 0) + int(stops.sum())
        open_ = open_[~stops]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*parts))


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, qids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["qids"], np.int64)
                x = np.frombuffer(r["data"], np.float64).reshape(len(ids), -1)
                q = np.frombuffer(r["qdata"], np.float64).reshape(len(qids), -1)
                found = search_block(ids, x, qids, q, k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(id, v array) to query_id, rank, vec_id, score of the k best other rows of each query row."""
    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    good = vectors.where(usable(F.col("v"))).where("id IS NOT NULL").groupBy("id").agg(F.min("v").alias("v"))
    block = good.mapInArrow(_blocks(ROWS), BLOCKS)
    asked = good.where(is_query).mapInArrow(_blocks(QUERIES), BLOCKS).select(F.col("dim").alias("qdim"), F.col("ids").alias("qids"), F.col("data").alias("qdata"))
    # Each block of vectors goes to one place, each block of queries to all of them.
    block = block.withColumn("at", F.pmod(F.xxhash64("ids"), F.lit(spread)).cast("int")).repartition(spread, "at")
    asked = asked.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).repartition(spread, "at")
    both = block.join(asked, "at").where("dim = qdim").select("ids", "data", "qids", "qdata")
    found = both.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
