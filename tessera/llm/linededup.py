"""Line dedup over overlapping windows of three lines.

Every three consecutive lines of a text are a window.  A window that also stands
earlier (in a smaller id, or before it in the same text) is a later occurrence; the
lines that later occurrences cover, merged, are removed.  Windows meet by a 64-bit
hash: a grouped minimum finds each repeated window's first place, and only windows
that repeat go on.  Texts without a later occurrence stay where they are read; only the others
are shuffled, to meet their places by id and a hash of the text.

Defined results: lines are the pieces between ``\\n``; null text has none and stays null.
Texts of fewer than three lines have no window.  Windows of three lines without
anything but spaces do not count.  Rows with a null id stay whole and remove
nothing; rows that repeat an id count as one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hit_or_not, stash

WINDOW = 3


def _windows(lines: Column) -> Column:
    """Hash of each window with its first line; blank windows are left out."""
    def at(i: Column) -> Column:
        three = [F.get(lines, i + k) for k in range(WINDOW)]
        return F.struct(i.alias("pos"), F.when(F.trim(F.concat(*three)) != "", F.xxhash64(*three)).alias("h"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.size(lines) - WINDOW), at), lambda x: x["h"].isNotNull())


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, rid, starts): first lines of the later occurrences in each text; rid is xxhash64(doc_id, text)."""
    lines = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), F.split("text", "\n", -1).alias("lines"))
    rows = lines.where(F.size("lines") >= WINDOW).select("doc_id", "rid", F.inline(_windows(F.col("lines"))))
    first = rows.groupBy("h").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first")
    first = stash(first, "windows")  # else the join keeps the sum's partitions and cannot split a hot window
    later = rows.join(first, "h").where(F.struct("doc_id", "pos") > F.col("first"))
    return later.groupBy("doc_id", "rid").agg(F.collect_set("pos").alias("starts"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any more columns) with the lines left in ``text``, and n_lines, n_removed in a struct ``lines``."""
    found = stash(covered(docs.select("doc_id", "text")), "covered").withColumnsRenamed({"doc_id": "id", "rid": "rid2"})
    rid = F.xxhash64("doc_id", "text")
    maybe, rest = hit_or_not(docs, rid, found.select("rid2"))
    rows = maybe.select(F.struct("*").alias("row"), rid.alias("rid")).join(found, (F.col("row.doc_id") == F.col("id")) & (F.col("rid") == F.col("rid2")), "left").select("row", "starts")
    rows = rows.union(rest.select(F.struct("*").alias("row"), F.lit(None).cast("array<int>").alias("starts")))
    lines = F.split("row.text", "\n", -1)
    n = F.coalesce(F.size(lines), F.lit(0))
    n = F.when(F.col("row.text").isNull(), 0).otherwise(n)
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.array(*[p + k for k in range(WINDOW)]))))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.when(F.col("starts").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    removed = F.when(F.col("starts").isNull(), 0).otherwise(F.size(gone))
    own = [text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return rows.select(*own, F.struct(n.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed")).alias("lines"))
