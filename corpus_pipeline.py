"""Corpus pipeline: language ID, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept and
returns a DataFrame; all but the last return the columns they were given.  Between
stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import hit_or_not, stash, table
from tessera.llm.langid import UNDETERMINED, fit, predictor
from tessera.llm.linededup import dedup_lines
from tessera.llm.mixing import mix
from tessera.llm.neardup import near_duplicates
from tessera.llm.packing import pack

#: A document is rejected whose language is undetermined or less likely than this.
MIN_LANGUAGE_SCORE = 0.5
#: Rarer sources are read up to this many times, and no source less than once.
MAX_REPEATS = 2.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language the context trees tell; trees learn from these documents' own labels.

    A null, empty or letterless text goes; texts of any length are read whole; of equally likely languages
    the alphabetically first counts; repeated rows are judged one by one; no rows give none.
    """
    p = predictor(spark, fit(docs.select("doc_id", "text", "lang")))(F.col("text"))
    rows = docs.select(F.struct("*").alias("row"), p.alias("p"))
    return rows.where((F.col("p.lang") != UNDETERMINED) & (F.col("p.score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later occurrences of three-line windows; a document that loses all its lines goes.

    Null texts and rows with a null id stay as they are; rows that repeat an id count as one place; ``n_chars``
    is counted anew where lines went; no rows give none.
    """
    rows = dedup_lines(docs)
    rows = rows.where((F.col("lines.n_removed") == 0) | (F.trim("text") != ""))
    chars = F.when(F.col("lines.n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    Of rows that repeat that id one stays: that with the smallest text, then the smallest other columns as JSON.
    Rows with a null id and documents without words link with nothing and stay.
    """
    found = near_duplicates(docs.select("doc_id", "text")).where("doc_id IS NOT NULL")
    found = found.groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("rows"))
    found = stash(found.where("NOT kept OR rows > 1").withColumn("key", F.xxhash64("doc_id")), "not-once")
    # What stays as it is, most rows, is not shuffled.
    maybe, rest = hit_or_not(docs.where("doc_id IS NOT NULL"), F.xxhash64("doc_id"), found.select("key"))
    rest = rest.union(maybe.join(found, "doc_id", "left_anti").select(*docs.columns))
    again = maybe.join(found.where("kept"), "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    again = again.groupBy("doc_id").agg(F.min_by("row", F.struct(F.col("text"), F.to_json("row"))).alias("row")).select("row.*")
    return rest.union(again).union(docs.where("doc_id IS NULL"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents of rarer sources by temperature; the largest source is read once.

    A null source is a source of its own; documents without words stay once; rows that repeat id, source and text
    are each read as often as the least of them, so no budget is overspent; no rows give none.
    """
    key = F.xxhash64("text")
    plan = mix(docs.select("doc_id", "text", "source", key.alias("k")), target_entropy=0.5, max_repeats=MAX_REPEATS, budget_share=None, carry=("k",))
    plan = plan.groupBy(F.col("doc_id").alias("id"), F.col("source").alias("s"), "k").agg(F.min("copies").alias("copies"))
    plan = stash(plan.where("copies <> 1").withColumn("key", F.xxhash64("id", "s", "k")), "copies")
    # What is read once, the largest sources, is not shuffled.
    maybe, rest = hit_or_not(docs, F.xxhash64("doc_id", "source", key), plan.select("key"))
    rows = maybe.select(F.struct("*").alias("row"), key.alias("k2"))
    rows = rows.join(plan, F.col("row.doc_id").eqNullSafe(F.col("id")) & F.col("row.source").eqNullSafe(F.col("s")) & (F.col("k2") == F.col("k")), "left")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.coalesce("copies", F.lit(1))))).select("row.*").union(rest)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences. A null text is an empty one; rows that repeat an id, as mixing makes them, are packed one by one."""
    return pack(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL cannot express the language and packing stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
