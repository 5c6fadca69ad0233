"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree: contexts of up to three
bytes, the counts of the bytes that followed them, and an escape probability
(escape method C: as many escapes as distinct successors).  Statistics are
frozen after training, so the code length of a byte depends on its last three
bytes alone and a text's exact code length is a sum of table entries.  The
trees of ``GROUP`` languages share one table of four-byte strings with one column of
bits for each language; strings that none of them has seen escape to shorter
contexts.  The predicted language has the shortest code.

Every label is a language, however many there are.  Trees are fitted on a bounded
number of labelled texts (``SAMPLE_PER_LANGUAGE``, and about ``SAMPLE_ALL`` in all); the size
of the tables is checked before they are broadcast.

Defined results: a null text, an empty one and one without a letter give
``und`` and score 0; so does any text when there is nothing to learn from.
Equal code lengths go to the alphabetically first language.  Texts of any length are
scored whole; rows that repeat an id are scored one by one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textops as tx
from .common import stash

ORDER = 3
PAD = "\n" * ORDER
UNDETERMINED = "und"
#: The model is fitted on at most this many labelled texts of a language, none longer than
#: this.  A language with longer ones only gives so many of its shortest texts, whole.
SAMPLE_PER_LANGUAGE, SAMPLE_CHARS, LONG_SAMPLE = 400, 65_536, 8
#: With many languages each gives fewer texts, so that about so many are read in all, but one at least.
SAMPLE_ALL = 25_600
#: Languages that share a table; tables that are larger than this together are not broadcast but an error.
GROUP, MAX_TABLE_BYTES = 16, 1 << 30
RESULT = "struct<lang:string,score:double,bits_per_byte:double>"


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """Every string of ``size`` bytes as an integer, first byte highest."""
    n = len(data) - size + 1
    out = np.zeros(max(n, 0), dtype=np.uint32)
    for j in range(size):
        out = (out << np.uint32(8)) | data[j : j + max(n, 0)]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text with PAD) to counts of the byte strings that end at each byte of the text."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lang in sorted(set(langs.tolist())):
            rows = batch.column("t").filter(pa.array(langs == lang))
            for size in range(1, ORDER + 2):
                parts = []
                for text in rows.to_pylist():
                    raw = np.frombuffer(text.encode(), dtype=np.uint8)
                    parts.append(_grams(raw[ORDER + 1 - size :], size))
                keys, counts = np.unique(np.concatenate(parts), return_counts=True) if parts else ([], [])
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(keys), pa.string()),
                    "size": pa.array(np.full(len(keys), size, np.int32)),
                    "gram": pa.array(np.asarray(keys, np.int64)),
                    "n": pa.array(np.asarray(counts, np.int64)),
                })


def train_counts(labelled: DataFrame, seed: int = 0) -> DataFrame:
    """Byte-string counts (lang, size, gram, n) of a bounded sample of (doc_id, text, lang)."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("text", "lang", F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    fits = F.length("text") <= SAMPLE_CHARS
    sizes = stash(rows.groupBy("lang").agg(F.count_if(fits).alias("fitting")), "labels")
    each = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE_ALL // max(1, sizes.count())))
    # A hash threshold thins each language to twice the bound before anything is sorted.
    share = F.least(F.lit(1.0), F.lit(2.0 * each) / F.greatest(F.col("fitting"), F.lit(1)))
    rows = rows.join(sizes.withColumn("limit", (F.lit(-(2.0**63)) + share * (2.0**64 - 2048)).cast("long")), "lang")
    order = Window.partitionBy("lang").orderBy("h", "text")
    sample = rows.where(fits & (F.col("h") <= F.col("limit"))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)
    order = Window.partitionBy("lang").orderBy(F.length("text"), "h", "text")
    shortest = rows.where("fitting = 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LONG_SAMPLE)
    counted = sample.union(shortest).select("lang", F.concat(F.lit(PAD), F.lower("text")).alias("t")).mapInArrow(
        _count, "lang string, size int, gram long, n long")
    return counted.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen context trees of some languages as tables of bits."""

    SLOTS = 20

    def __init__(self, counts: list[tuple[str, int, int, int]] | pa.Table):
        """counts: (lang, size, gram, n) rows."""
        if not isinstance(counts, pa.Table):
            counts = pa.table([list(c) for c in zip(*counts)] or [[]] * 4, names=["lang", "size", "gram", "n"])
        names = counts.column("lang").combine_chunks().dictionary_encode()
        order = np.argsort(np.array(names.dictionary.to_pylist(), dtype=object)) if len(names.dictionary) else np.zeros(0, np.int64)
        self.langs = [names.dictionary[int(i)].as_py() for i in order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        every_lang = place[names.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
        every_size, every_gram, every_n = (counts.column(c).to_numpy().astype(np.int64) for c in ("size", "gram", "n"))
        width = len(self.langs)
        self.keys: list[np.ndarray] = [np.zeros(0, np.uint32)] * (ORDER + 2)
        self.bits: list[np.ndarray] = [np.full((1, width), 8.0)] * (ORDER + 2)
        self.contexts: list[np.ndarray] = [np.zeros(0, np.uint32)] * (ORDER + 1)
        self.escapes: list[np.ndarray] = [np.zeros((0, width))] * (ORDER + 1)
        weight = None
        for size in range(1, ORDER + 2):
            of = every_size == size
            lang, gram, n = every_lang[of], every_gram[of], every_n[of].astype(float)
            keys, row = np.unique(gram, return_inverse=True)
            seen = np.zeros((len(keys), width))
            seen[row, lang] = n
            ctx_of = keys >> 8
            ctx, crow = np.unique(ctx_of, return_inverse=True)
            total, kinds = np.zeros((len(ctx), width)), np.zeros((len(ctx), width))
            np.add.at(total, crow, seen)
            np.add.at(kinds, crow, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                own = -np.log2(seen / (total + kinds)[crow])
            self.keys[size] = keys.astype(np.uint32)
            self.contexts[size - 1], self.escapes[size - 1] = ctx.astype(np.uint32), escape
            # Unseen here in one language: that language escapes and asks its shorter context.
            shorter = self._lookup(size - 1, (keys & ((1 << (8 * (size - 1))) - 1)).astype(np.uint32))
            self.bits[size] = np.where(seen > 0, own, escape[crow] + shorter)
            weight = n
            order_of = row
        # The longest strings by hash slot, the frequent ones first; a string without a slot is searched for.
        total = np.bincount(order_of, weights=weight, minlength=len(self.keys[-1])) if len(self.langs) else np.zeros(0)
        slot = self._slot(self.keys[-1])
        self.slot_row = np.full(1 << self.SLOTS, -1, np.int32)
        by = np.argsort(total, kind="stable")
        self.slot_row[slot[by]] = by.astype(np.int32)
        self.slot_key = np.zeros(1 << self.SLOTS, np.uint32)
        full = self.slot_row >= 0
        self.slot_key[full] = self.keys[-1][self.slot_row[full]]
        # A row of zeros stands for strings that are not counted here.
        self.bits[-1] = np.vstack([self.bits[-1], np.zeros((1, width))])

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return (gram * np.uint32(2654435769)) >> np.uint32(32 - self.SLOTS)

    def _lookup(self, size: int, gram: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each string, for each language."""
        if size == 0:
            return np.full((len(gram), len(self.langs)), 8.0)
        keys = self.keys[size]
        at = np.minimum(np.searchsorted(keys, gram), max(len(keys) - 1, 0))
        hit = keys[at] == gram if len(keys) else np.zeros(len(gram), bool)
        out = np.zeros((len(gram), len(self.langs)))
        out[hit] = self.bits[size][at[hit]]
        rest = gram[~hit]
        if len(rest):
            out[~hit] = self._escape(size - 1, rest >> np.uint32(8)) + self._lookup(size - 1, rest & np.uint32((1 << (8 * (size - 1))) - 1))
        return out

    def _escape(self, size: int, ctx: np.ndarray) -> np.ndarray:
        keys = self.contexts[size]
        out = np.zeros((len(ctx), len(self.langs)))
        if len(keys):
            at = np.minimum(np.searchsorted(keys, ctx), len(keys) - 1)
            hit = keys[at] == ctx
            out[hit] = self.escapes[size][at[hit]]
        return out

    def code_lengths(self, tb: tx.TextBatch) -> np.ndarray:
        """Bits of each padded text (rows) under each language (columns)."""
        out = np.zeros((tb.n, len(self.langs)))
        gram = _grams(tb.data, ORDER + 1)
        if not len(gram) or not self.langs:
            return out
        slot = self._slot(gram)
        row = self.slot_row[slot]
        hit = (self.slot_key[slot] == gram) & (row >= 0)
        row[~hit] = len(self.bits[-1]) - 1
        # Strings that end in a text's first bytes reach into the text before; they are not its own.
        bits = self.bits[-1][row]
        edge = (tb.offsets[1:-1, None] + np.arange(-ORDER, 0)).ravel()
        edge = edge[(edge >= 0) & (edge < len(gram))]
        own = np.ones(len(gram), bool)
        own[edge] = False
        bits[~own] = 0
        has = tb.sizes > ORDER
        starts = tb.offsets[:-1][has]
        out[has] = np.add.reduceat(bits, starts, axis=0)
        miss = np.flatnonzero(~hit & own)
        if len(miss):
            doc = np.searchsorted(tb.offsets, miss, side="right") - 1
            lost = self._lookup(ORDER + 1, gram[miss])
            for k in range(len(self.langs)):
                out[:, k] += np.bincount(doc, weights=lost[:, k], minlength=tb.n)
        return out


class Trees:
    """Models of all languages, ``GROUP`` languages in each."""

    def __init__(self, models: list[Model]):
        self.models = models
        self.langs = [x for m in models for x in m.langs]

    def code_lengths(self, tb: tx.TextBatch) -> np.ndarray:
        return np.hstack([m.code_lengths(tb) for m in self.models]) if self.models else np.zeros((tb.n, 0))


def predict_batch(model: Trees, texts: pa.Array, letters: pa.Array) -> pa.StructArray:
    langs, scores, rates = [], [], []
    whole = pa.RecordBatch.from_arrays([texts, letters], ["t", "ok"])
    for part in tx.chunks(whole, "t"):
        tb = tx.text_batch(part.column("t"))
        bits = model.code_lengths(tb)
        ok = np.array(part.column("ok").fill_null(False).to_pylist(), bool) & bool(model.langs)
        if not model.langs:
            bits = np.zeros((tb.n, 1))
        best = bits.argmin(axis=1)
        gap = bits - bits[np.arange(tb.n), best][:, None]
        score = 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)
        length = np.maximum(tb.sizes - ORDER, 1)
        langs += [model.langs[k] if y else UNDETERMINED for k, y in zip(best.tolist(), ok.tolist())]
        scores.append(np.where(ok, score, 0.0))
        rates.append(np.where(ok, bits[np.arange(tb.n), best] / length, 0.0))
    return pa.StructArray.from_arrays(
        [pa.array(langs, pa.string()), pa.array(np.concatenate(scores or [[]]), pa.float64()), pa.array(np.concatenate(rates or [[]]), pa.float64())],
        ["lang", "score", "bits_per_byte"])


def fit(labelled: DataFrame, seed: int = 0) -> Trees:
    """Context trees from (doc_id, text, lang); the counts come from a bounded sample, so those of a group fit the driver."""
    counts = stash(train_counts(labelled, seed), "counts")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    groups = [langs[i : i + GROUP] for i in range(0, len(langs), GROUP)]
    return Trees([Model(counts.where(F.col("lang").isin(g)).toArrow()) for g in groups])


def predictor(spark, model: Trees):
    """A column function of a text column: struct(lang, score, bits_per_byte)."""
    data = pickle.dumps(model, protocol=5)
    if len(data) > MAX_TABLE_BYTES:
        raise ValueError(f"context trees of {len(model.langs)} languages take {len(data)} bytes, over {MAX_TABLE_BYTES}")
    held = spark.sparkContext.broadcast(data)

    def run(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = pickle.loads(held.value)
        for texts, letters in it:
            yield predict_batch(known, texts, letters)

    run.__annotations__ = {"it": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(tx.tidied(run), RESULT)

    def apply(text: Column) -> Column:
        return udf(F.concat(F.lit(PAD), F.lower(F.coalesce(text, F.lit("")))), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))

    return apply


def detect(docs: DataFrame, labelled: DataFrame, out: str = "detected") -> DataFrame:
    """``docs`` with a struct column ``out``: lang, score, bits_per_byte. It replaces a column of that name; others pass unchanged."""
    return docs.withColumn(out, predictor(docs.sparkSession, fit(labelled))(F.col("text")))
