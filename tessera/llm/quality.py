"""Quality rules with adaptive thresholds.

Each metric of each language and source has a quantile sketch: counts of values
in logarithmic buckets (2 % wide, so a quantile is within 1 %).  Sketches are
plain (group, bucket, count) rows, so they merge by addition: a group with fewer
than ``ENOUGH`` documents takes the merged sketch of its language, and a small
language the one of all documents.  A fence comes from quantiles of the group's
sketch alone: it stands ``REACH`` times the gap between the median and the tail
quantile beyond that quantile.  Where a metric has no such gap, as most documents
lack the trait altogether, the fence is the lower quartile of the documents that
have it; by rank, at most a tenth of the group is beyond.  No threshold is a constant.
Documents meet their group's fences in a join, each as the value of its bucket, so
a document on a fence passes.

Defined results: null texts count as empty and fail the base rules; a null
language or source is a group of its own.  Two counters come first and hold for
all groups: fewer than ten words, or over 20 % of words in repeated windows.
Documents that fail them do not count in sketches.  Rows that repeat an id are
judged one by one; texts are counted whole, however long; columns beyond those named
do not matter.  With no document there are no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import docstats
from .common import stash

MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
ENOUGH = 100
#: Ranks of the low, middle and high quantile, and of the lower quartile of the documents that have a rare trait.
LOW, MIDDLE, HIGH, RARE = 0.1, 0.5, 0.9, 0.25
#: Fences stand so many gaps between the middle and the tail quantile beyond the tail.
REACH = 5.0
TWO_SIDED = ("word_length",)
GAMMA = 1.02
FLOOR = 1e-4


def metrics(c) -> dict[str, Column]:
    words, lines = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("n_lines"), F.lit(1))
    return {
        "word_length": c("word_chars") / words,
        "symbol_rate": c("n_symbols") / words,
        "dup_line_share": c("n_dup_lines") / lines,
        "repeat_share": c("n_repeat_words") / words,
        "upper_share": c("n_letters_upper") / F.greatest(c("word_chars"), F.lit(1)),
    }


def bucket(x: Column) -> Column:
    """Logarithmic bucket; all values below FLOOR share one."""
    return F.floor(F.log(F.greatest(x, F.lit(FLOOR))) / F.log(F.lit(GAMMA))).cast("int")


def value(b: Column) -> Column:
    """The middle of a bucket; zero for the lowest."""
    low = bucket(F.lit(FLOOR))
    return F.when(b <= low, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), b + 0.5))


def sketches(stats: DataFrame) -> DataFrame:
    """Quantile sketches (lang, source, metric, bucket, n) of documents with lang, source and COUNTS."""
    found = F.array(*[F.struct(F.lit(k).alias("metric"), bucket(x).alias("bucket")) for k, x in metrics(F.col).items()])
    rows = stats.select("lang", "source", F.explode(found).alias("m"))
    return rows.groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Merge sketches over all but ``keys`` and read their quantiles: one row (docs, low, middle, high, rare) for each group and metric."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    up, every = Window.partitionBy(*keys, "metric").orderBy("bucket"), Window.partitionBy(*keys, "metric")
    zero = F.col("bucket") <= bucket(F.lit(FLOOR))
    ranked = merged.select("*", F.sum("n").over(up).alias("upto"), F.sum("n").over(every).alias("total"), F.sum(F.when(zero, F.col("n")).otherwise(0)).over(every).alias("zeros"))

    def at(rank: Column) -> Column:
        return value(F.min(F.when(F.col("upto") >= rank, F.col("bucket"))))

    whole = [at(F.ceil(F.col("total") * q)).alias(name) for q, name in ((LOW, "low"), (MIDDLE, "middle"), (HIGH, "high"))]
    rare = F.coalesce(at(F.col("zeros") + F.greatest(F.ceil((F.col("total") - F.col("zeros")) * RARE), F.lit(1))), F.lit(0.0))
    return ranked.groupBy(*keys, "metric").agg(F.max("total").alias("docs"), *whole, rare.alias("rare"))


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, fence): a map from metric to its lowest and highest value that passes."""
    read = F.struct("docs", "low", "middle", "high", "rare")
    lang = quantiles(sketch, ["lang"]).select(F.col("lang").alias("l2"), F.col("metric").alias("m2"), read.alias("by_lang"))
    every = quantiles(sketch, []).select(F.col("metric").alias("m3"), read.alias("by_all"))
    one = quantiles(sketch, ["lang", "source"]).select("lang", "source", "metric", read.alias("own"))
    one = one.join(lang, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("metric") == F.col("m2"))).join(every, F.col("metric") == F.col("m3"))
    q = F.when(F.col("own.docs") >= ENOUGH, F.col("own")).when(F.col("by_lang.docs") >= ENOUGH, F.col("by_lang")).otherwise(F.col("by_all"))
    one = one.select("lang", "source", "metric", q.alias("q"))
    low, middle, high = F.col("q.low"), F.col("q.middle"), F.col("q.high")
    top = F.when(high > middle, high + REACH * (high - middle)).otherwise(F.greatest(high, F.col("q.rare")))
    bottom = F.when(F.col("metric").isin(*TWO_SIDED), low - REACH * (middle - low)).otherwise(F.lit(float("-inf")))
    pair = F.struct("metric", F.struct(bottom.alias("low"), top.alias("high")).alias("fence"))
    return one.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(pair)).alias("fence"))


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang, source) to COUNTS, base_failed, kept and failed (names of the fences a document is beyond)."""
    stats = docs.select("doc_id", "lang", "source", F.arrow_udf(docstats.counts, docstats.RESULT)(F.coalesce("text", F.lit(""))).alias("s"))
    stats = stash(stats.select("doc_id", "lang", "source", "s.*"), "counts")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    stats = stats.withColumn("base_failed", base)
    limits = fences(sketches(stats.where(~F.col("base_failed")))).withColumnsRenamed({"lang": "l2", "source": "s2"})
    limits = stash(limits, "fences")  # its size is then known, and the join can split a hot group
    both = stats.join(limits, F.col("lang").eqNullSafe(F.col("l2")) & F.col("source").eqNullSafe(F.col("s2")), "left").drop("l2", "s2")
    beyond = [F.when((x < F.col("fence")[k]["low"]) | (x > F.col("fence")[k]["high"]), F.lit(k)) for k, x in ((k, value(bucket(x))) for k, x in metrics(F.col).items())]
    failed = F.array_compact(F.array(*beyond))
    return both.withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("fence")
