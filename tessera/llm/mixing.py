"""Mixing sources to target weights by temperature.

Token shares of sources are raised to an exponent and normalised.  The exponent is
the smallest in [0, 1] that keeps the entropy of the weights at or below a target
and the repetition of every source at or below a limit; both fall as the exponent
grows, so it is found by repeated section, each pass one aggregate over the table
of sources.  Weights become whole documents: a source that is read e times gives
each document floor(e) copies, and its remaining fraction of tokens is spent in
blocks: documents are dealt into blocks of about ``BLOCK`` by a digest, permuted in
each block, and taken while the block's share of the budget lasts.  Only blocks,
never sources, meet in one task.  ``position`` is a document's place in its block's permutation, from 0,
and ``block_docs`` the block's size: copy c (from 0) of a document is number c * block_docs + position
of what is read of the block, without gaps, as the documents that the last pass takes are the first.

Defined results: tokens are words ``[^\\x20\\x09-\\x0D]+``; null text has none.  A null
source is a source of its own.  A source without tokens keeps one copy of each document.
Rows that repeat an id are dealt to one block and taken one by one, in no fixed order where
they have as many tokens; texts are counted whole, however long; columns beyond those named
and ``carry`` are not read.  Without rows there are none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stash

BLOCK = 4096
SECTIONS, PASSES = 31, 7
#: Sources up to this number are broadcast to documents; beyond it they are joined.
BROADCAST_SOURCES = 100_000


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def digest(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def _moments(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(sum of p^a, sum of p^a ln p) for each exponent a."""
    # Exponents are data, so Spark compiles one plan for all passes.
    rows = shares.select("p", F.explode(F.array(*map(F.lit, exponents))).alias("a")).withColumn("w", F.pow("p", "a"))
    found = {r["a"]: (r["z"], r["zl"]) for r in rows.groupBy("a").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("p")).alias("zl")).collect()}
    return [found[a] for a in exponents]


def exponent(shares: DataFrame, target_entropy: float | None, max_repeats: float | None, budget_share: float | None) -> tuple[float, float, float]:
    """(exponent, sum of p^exponent, entropy). shares: column p > 0, summing to 1. target_entropy: as a fraction of
    the way from the natural entropy to the highest. budget_share: the budget as a multiple of all tokens; None for
    the least budget under which no source is read less than once."""
    r = shares.agg(F.count("*"), F.min("p"), F.max("p"), F.sum(F.col("p") * F.log("p"))).first()
    count, least, most, natural = r[0], r[1], r[2], -(r[3] or 0.0)
    if not count:
        return 1.0, 1.0, 0.0
    goal = None if target_entropy is None else natural + target_entropy * (math.log(count) - natural)

    def fits(a: float, z: float, zl: float) -> bool:
        entropy = math.log(z) - a * zl / z
        budget = z * most ** (1 - a) if budget_share is None else budget_share
        repeats = budget * least ** (a - 1) / z
        return (goal is None or entropy <= goal + 1e-12) and (max_repeats is None or repeats <= max_repeats + 1e-12)

    low, high = 0.0, 1.0
    for _ in range(PASSES):
        at = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        found = [fits(a, *m) for a, m in zip(at, _moments(shares, at))]
        first = next((i for i, ok in enumerate(found) if ok), SECTIONS)
        if not first:
            high = low
            break
        low, high = at[first - 1], at[first]
    a = round(high, 8)
    z, zl = _moments(shares, [a])[0]
    return a, z, math.log(z) - a * zl / z


def mix(docs: DataFrame, target_entropy: float | None = 0.5, max_repeats: float | None = 4.0, budget_share: float | None = 1.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, source) to doc_id, source, n_tokens, weight, epochs, block, position, block_docs, copies, and the columns ``carry``."""
    counted = stash(docs.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"), *carry), "tokens")
    sources = stash(counted.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")), "sources")
    r = sources.agg(F.sum("tokens"), F.count("*")).first()
    total, n_sources = float(r[0] or 0), r[1]
    shares = sources.where("tokens > 0").select((F.col("tokens") / F.lit(max(total, 1.0))).alias("p"))
    a, z, _ = exponent(shares, target_entropy, max_repeats, budget_share)
    most = shares.agg(F.max("p")).first()[0] or 1.0
    budget = z * most ** (1 - a) if budget_share is None else budget_share
    p = F.col("tokens") / F.lit(max(total, 1.0))
    weight = F.when(F.col("tokens") > 0, F.pow(p, F.lit(a)) / F.lit(z)).otherwise(0.0)
    epochs = F.when(F.col("tokens") > 0, F.round(F.lit(budget) * weight / p, 9)).otherwise(1.0)
    plan = sources.select(F.col("source").alias("s"), weight.alias("weight"), epochs.alias("epochs"), F.ceil(F.col("docs") / BLOCK).alias("blocks"))
    if n_sources <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    rows = counted.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("d", digest(F.col("doc_id"))).withColumn("block", F.conv(F.substring("d", 1, 8), 16, 10).cast("long") % F.col("blocks"))
    block = Window.partitionBy("source", "block")
    order = block.orderBy("d", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", F.sum("n_tokens").over(order).alias("upto"), (F.count("*").over(order) - 1).alias("position"), F.sum("n_tokens").over(block).alias("all"), F.count("*").over(block).alias("block_docs"))
    whole = F.floor("epochs")
    taken = F.col("upto") - F.col("n_tokens") / 2 < (F.col("epochs") - whole) * F.col("all")
    copies = (whole + F.when(taken, 1).otherwise(0)).cast("int")
    return rows.select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), "epochs", "block", "position", "block_docs", copies.alias("copies"), *carry)
