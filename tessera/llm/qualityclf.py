"""Quality classifier: a regularised quadratic discriminant.

Texts become vectors of transformed counts.  Each class has a mean and a
covariance shrunk towards the pooled diagonal; its Cholesky factor is computed
once and kept.  A text's score is the logistic of the difference of the classes'
Mahalanobis log-densities plus the log prior odds.  Moments are sums about the overall
mean, which keeps their differences exact, so training is two aggregates over all
labelled documents, whatever their number.

Defined results: null and empty texts have all counts zero and get a score too.
With no labelled document of one class the score is the share of label 1 among
the labelled ones, and 0.5 when there are none.  A document with equal densities
scores the prior; a score of 0.5 counts as label 1.  Texts are counted whole, however long.
Each row of a repeated id is scored, and each of its rows and labels is learned from.  Labels
other than 0 and 1 and columns beyond those named are not read.  No rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import docstats
from .common import stash

FEATURES = ("words", "word_length", "symbols", "upper", "digits", "punct", "dup_lines", "repeats", "lines", "distinct")
#: Weight of the pooled diagonal, in documents for each dimension.
SHRINK = 2.0


def features(c=F.col) -> list[Column]:
    """Log-transformed rates in the order of FEATURES."""
    rate = lambda a, b: F.log((c(a) + 0.5) / (c(b) + 1.0))
    return [
        F.log1p(c("n_words").cast("double")),
        rate("word_chars", "n_words"),
        rate("n_symbols", "n_words"),
        rate("n_letters_upper", "n_chars"),
        rate("n_digits", "n_chars"),
        rate("n_punct", "n_chars"),
        rate("n_dup_lines", "n_lines"),
        rate("n_repeat_words", "n_words"),
        rate("n_lines", "n_words"),
        rate("n_distinct_words", "n_words"),
    ]


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, x), x an array of features; texts are read once."""
    counted = docs.select("doc_id", F.arrow_udf(docstats.counts, docstats.RESULT)(F.coalesce("text", F.lit(""))).alias("s")).select("doc_id", "s.*")
    return stash(counted.select("doc_id", F.array(*features()).alias("x")), "features")


class Discriminant:
    """Two Gaussians with shrunk covariances."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], centre: np.ndarray | None = None):
        """moments: class to (count, sum of x, sum of x times its transpose), x taken from ``centre``."""
        self.parts = []
        n = {k: m[0] for k, m in moments.items()}
        total = sum(n.values())
        self.constant = None
        if len(moments) < 2:
            self.constant = 0.5 if not total else float(1 in n)
            return
        d = len(FEATURES)
        cov, mean = {}, {}
        for k, (c, s, ss) in moments.items():
            mean[k] = s / c
            cov[k] = ss / c - np.outer(mean[k], mean[k])
        pooled = sum(n[k] * np.diag(cov[k]) for k in cov) / total
        pooled = np.maximum(pooled, 1e-6)
        for k in (0, 1):
            a = SHRINK * d / (n[k] + SHRINK * d)
            shrunk = (1 - a) * cov[k] + a * np.diag(pooled) + 1e-6 * np.diag(pooled)
            factor = np.linalg.cholesky(shrunk)
            inverse = np.linalg.inv(factor)
            self.parts.append((mean[k] if centre is None else mean[k] + centre, inverse, float(np.log(np.diag(factor)).sum()), float(np.log(n[k] / total))))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        log = []
        for mean, inverse, half_det, prior in self.parts:
            z = (x - mean) @ inverse.T
            log.append(prior - half_det - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(labelled: DataFrame) -> Discriminant:
    """From rows (x, quality): sums of each class, one row each."""
    d = len(FEATURES)
    labelled = labelled.where("quality IN (0, 1)")
    centre = [float(m or 0.0) for m in labelled.agg(*[F.avg(F.col("x")[i]) for i in range(d)]).first()]
    x = [F.col("x")[i] - F.lit(m) for i, m in enumerate(centre)]
    sums = [F.sum(v) for v in x] + [F.sum(x[i] * x[j]) for i in range(d) for j in range(i + 1)]
    moments = {}
    for r in labelled.groupBy("quality").agg(F.count("*"), *sums).collect():
        ss = np.zeros((d, d))
        ss[np.tril_indices(d)] = r[2 + d :]
        ss = ss + np.tril(ss, -1).T
        moments[int(r[0])] = (float(r[1]), np.array(r[2 : 2 + d], float), ss)
    return Discriminant(moments, np.array(centre))


def scorer(spark, model: Discriminant):
    held = spark.sparkContext.broadcast(model)

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for xs in it:
            flat = xs.flatten().to_numpy(zero_copy_only=False).reshape(len(xs), -1) if len(xs) else np.zeros((0, len(FEATURES)))
            yield pa.array(held.value.score(flat))

    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")


def classify(docs: DataFrame, labelled_ids: DataFrame) -> DataFrame:
    """(doc_id, text) and (doc_id, quality) to (doc_id, score)."""
    x = vectors(docs)
    model = fit(x.join(labelled_ids, "doc_id").select("x", "quality"))
    return x.select("doc_id", scorer(docs.sparkSession, model)(F.col("x")).alias("score"))
