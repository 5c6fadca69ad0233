"""Substring dedup by suffix automata of reference shards.

A window is ``WINDOW`` consecutive words.  Each window belongs to the smallest
hash among its runs of ``GRAM`` words (its minimizer), so equal windows always
belong to the same one, and a shard is the text around all copies of one
minimizer.  Minimizers of a single document are dropped, which leaves little
more than the passages that do repeat; equal stretches are taken once, with
their smallest id.  Each shard's reference texts form a generalised suffix
automaton over words whose states hold the first document; stretches stream
through it in the order of their ids and the matching statistics give the
first document of every window.  Matched windows merge into maximal spans.

A shard with over ``HOT`` different stretches is cut into whole windows, so that no
automaton or task grows with a passage that stands in many different surroundings: such
windows meet by two 64-bit hashes, and a minimum summed up before the shuffle gives their
first document.  Automata are built next to their shard instead of being
broadcast: the reference is the whole corpus, so its automata have no size bound.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``, unchanged; null text has none.
A null id is neither smaller nor larger than another, so such rows stay whole and
remove nothing.  Rows that repeat an id do not remove from each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .common import hit_or_not, release, stash

WINDOW, GRAM, HOT = 50, 24, 500
SPAN = WINDOW - GRAM + 1
RUNS = "array<struct<mz:long,at:int,n:int,h:long>>"
_PRIME = 0x9E3779B97F4A7C15 | 1


def minimizer_runs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows of one row that have the same minimizer: row, minimizer hash,
    first window in the row, number of windows, hash of the run's words."""
    empty = np.zeros(0, np.int64)
    counts = np.diff(first)
    total = len(hashes)
    if total < WINDOW:
        return (empty,) * 5
    gram = tx.gram_hashes(hashes, GRAM)
    best = np.arange(len(gram))
    reach = 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(gram[a] <= gram[b], a, b)

    while reach * 2 <= SPAN:
        best = better(best[:-reach], best[reach:])
        reach *= 2
    if reach < SPAN:
        rest = SPAN - reach
        best = better(best[: len(best) - rest], best[rest:])
    row = np.repeat(np.arange(len(counts)), counts)
    start = np.flatnonzero(row[: len(best)] == row[WINDOW - 1 :][: len(best)])
    if not len(start):
        return (empty,) * 5
    pos = best[start]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (pos[1:] != pos[:-1]) | (start[1:] != start[:-1] + 1) | (row[start[1:]] != row[start[:-1]])
    head = np.flatnonzero(fresh)
    n = np.diff(np.append(head, len(start)))
    a = start[head]
    b = a + n + WINDOW - 1
    prefix = np.zeros(total + 1, np.uint64)
    np.cumsum(hashes * tx.powers(_PRIME, total + 1)[:total], out=prefix[1:])
    h = (prefix[b] - prefix[a]) * tx.powers(pow(_PRIME, -1, 1 << 64), total + 1)[a]
    return row[a], gram[pos[head]], a - first[row[a]], n, tx.mix64(h + n.astype(np.uint64))


@tx.tidied
def runs(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("mz", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("h", pa.int64())]))
    for texts in it:
        parts = []
        for part in tx.chunks(pa.RecordBatch.from_arrays([texts], ["t"]), "t"):
            tb = tx.text_batch(part.column("t"))
            w = tx.words(tb)
            row, mz, at, n, h = minimizer_runs(w.hashes, w.first)
            offsets = np.searchsorted(row, np.arange(tb.n + 1)).astype(np.int32)
            flat = pa.StructArray.from_arrays(
                [pa.array(tx.signed(mz)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(tx.signed(h))], ["mz", "at", "n", "h"])
            parts.append(pa.ListArray.from_arrays(pa.array(offsets), flat).cast(kind))
        yield pa.concat_arrays(parts) if parts else pa.array([], kind)


def _cut(take, names: list[str], kinds: list[pa.DataType]):
    """A function of batches (doc, text, wanted) that puts out what ``take`` gives for each stretch, a few MB at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            size = 0
            for doc, text, wanted in zip(batch.column("doc"), batch.column("text"), batch.column("wanted")):
                words, doc = text.as_py().encode().split(), doc.as_py()
                for x in wanted.as_py():
                    for values in take(words[x["at"] : x["at"] + x["n"] + WINDOW - 1], x["mz"], x["h"], doc):
                        for column, v in zip(out, values):
                            column.append(v)
                        size += 64 + (len(values[-1]) if isinstance(values[-1], bytes) else 0)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
                    out, size = [[] for _ in names], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    return run


def _whole(words: list[bytes], mz: int, h: int, doc: int) -> list[tuple]:
    return [(mz, h, doc, b" ".join(words))]


def _windows(words: list[bytes], mz: int, h: int, doc: int) -> list[tuple]:
    """Two hashes of each window of a stretch."""
    raw = [b" ".join(words[j : j + WINDOW]) for j in range(len(words) - WINDOW + 1)]
    return [(mz, h, j, doc, xxhash.xxh64_intdigest(r, 7) - (1 << 63), xxhash.xxh64_intdigest(r, 11) - (1 << 63)) for j, r in enumerate(raw)]


_stretches = _cut(_whole, ["mz", "h", "doc", "words"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()])
_hot_windows = _cut(_windows, ["mz", "h", "j", "doc", "x", "y"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])


class Automaton:
    """Generalised suffix automaton over words; each state keeps the document that came first."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.doc = [-1], [0], [0]

    def _state(self, length: int, doc: int, nexts: dict[bytes, int], link: int) -> int:
        self.next.append(nexts)
        self.link.append(link)
        self.length.append(length)
        self.doc.append(doc)
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        """The state for the words of p and this one, cut from q where q is longer."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.doc[q], dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def add(self, words: list[bytes], doc: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = self._split(last, q, word)
                continue
            now = self._state(self.length[last] + 1, doc, {}, 0)
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = now
                p = self.link[p]
            if p >= 0:
                self.link[now] = self._split(p, self.next[p][word], word)
            last = now

    def first_docs(self, words: list[bytes], size: int) -> list[int | None]:
        """For each run of ``size`` words, the document that held it first, or None."""
        nexts, link, length = self.next, self.link, self.length
        out: list[int | None] = []
        at = matched = 0
        for i, word in enumerate(words):
            while True:
                to = nexts[at].get(word)
                if to is not None:
                    at = to
                    matched += 1
                    break
                if not at:
                    matched = 0
                    break
                at = link[at]
                matched = length[at]
            if matched >= size:
                matched = size
                while length[link[at]] >= size:
                    at = link[at]
            if i >= size - 1:
                out.append(self.doc[at] if matched == size else None)
        return out


@tx.tidied
def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by shard and document to the first document of each of their windows, as runs."""
    names, kinds = ["mz", "h", "j", "n", "first"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    key, auto = None, Automaton()
    for batch in batches:
        out: list[list] = [[] for _ in names]
        rows = zip(*(batch.column(c).to_pylist() for c in ("mz", "h", "doc", "words")))
        for mz, h, doc, raw in rows:
            if mz != key:
                key, auto = mz, Automaton()
            words = raw.split(b" ")
            found = auto.first_docs(words, WINDOW) if len(auto.link) > 1 else [None] * (len(words) - WINDOW + 1)
            if None in found:
                auto.add(words, doc)
                found = [doc if x is None else x for x in found]
            a = 0
            for b in range(1, len(found) + 1):
                if b == len(found) or found[b] != found[a]:
                    for column, v in zip(out, (mz, h, a, b - a, found[a])):
                        column.append(v)
                    a = b
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)


@tx.tidied
def _strip(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Text and matched runs of windows to word counts, kept text and its digest."""
    for texts, spans in it:
        n_words, removed, digests = [], [], []
        for text, found in zip(texts, spans):
            words = (text.as_py() or "").encode().split()
            total = len(words)
            if found.is_valid:
                gone = bytearray(total)
                for x in found.as_py():
                    a, b = x["a"], min(total, x["a"] + x["n"] + WINDOW - 1)
                    gone[a:b] = b"\x01" * (b - a)
                words = [w for w, g in zip(words, gone) if not g]
            n_words.append(total)
            removed.append(total - len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["n_words", "n_removed", "kept_sha256"])


def matched_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, rid, found): for each text, the runs (a, n) of windows that start in a smaller id;
    rid is xxhash64(doc_id, text)."""
    rid = F.xxhash64("doc_id", "text").alias("rid")
    own = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    base = own.select("doc_id", rid, F.arrow_udf(runs, RUNS)("text").alias("runs")).where(F.size("runs") > 0)
    base = stash(base, "runs")
    flat = base.select(F.col("doc_id").alias("doc"), "rid", F.inline("runs"))
    shared = flat.groupBy("mz").agg(F.min("doc").alias("x"), F.max("doc").alias("y")).where("x <> y").select("mz")
    shared = stash(shared, "minimizers")  # else the join keeps the sum's partitions and cannot split a hot one
    wanted = stash(flat.join(shared, "mz"), "shared")
    release(base, shared)
    distinct = wanted.groupBy("mz", "h").agg(F.min(F.struct("doc", "rid", "at", "n")).alias("r"))
    distinct = stash(distinct.select("mz", "h", "r.*"), "stretches")
    hot = stash(distinct.groupBy("mz").count().where(F.col("count") > HOT).select("mz", F.lit(True).alias("hot")), "hot")
    kind = distinct.join(hot, "mz", "left").select("rid", "doc", F.struct("mz", "h", "at", "n").alias("x"), F.coalesce("hot", F.lit(False)).alias("hot"))
    cut = stash(kind.groupBy("rid", "doc", "hot").agg(F.collect_list("x").alias("wanted")), "cuts")
    release(distinct, hot)
    whole = _texts(own, cut.where("NOT hot")).mapInArrow(_stretches, "mz long, h long, doc long, words binary")
    dealt = whole.repartition(F.col("mz")).sortWithinPartitions("mz", "doc", "h")
    first = stash(dealt.mapInArrow(_match, "mz long, h long, j int, n int, first long"), "first")
    done = [wanted, cut, first]
    if cut.where("hot").limit(1).count():
        windows = stash(_texts(own, cut.where("hot")).mapInArrow(_hot_windows, "mz long, h long, j int, doc long, x long, y long"), "windows")
        least = stash(windows.groupBy("x", "y").agg(F.min("doc").alias("first")), "least")
        done += [windows, least]
        first = first.union(windows.join(least, ["x", "y"]).select("mz", "h", "j", F.lit(1).alias("n"), "first"))
    hits = wanted.select("rid", "doc", "mz", "h", "at").join(first, ["mz", "h"]).where("first < doc")
    runs_of = hits.select("rid", "doc", F.struct((F.col("at") + F.col("j")).alias("a"), "n").alias("x"))
    found = stash(runs_of.groupBy(F.col("doc").alias("doc_id"), "rid").agg(F.collect_set("x").alias("found")), "found")
    release(*done)
    return found


def _texts(own: DataFrame, cut: DataFrame) -> DataFrame:
    """The texts of ``cut`` with what is wanted of them; others stay where they are read."""
    rows = own.select(F.col("doc_id").alias("id"), "text", F.xxhash64("doc_id", "text").alias("rid2"))
    maybe, _ = hit_or_not(rows, F.col("rid2"), cut.select("rid"))
    return maybe.join(cut, (F.col("id") == F.col("doc")) & (F.col("rid2") == F.col("rid"))).select("doc", "text", "wanted")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to doc_id, n_words, n_removed and the digest of the words that stay. Only texts that lose words are shuffled for it."""
    found = matched_windows(docs).withColumnsRenamed({"doc_id": "id", "rid": "rid2"})
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))
    maybe, rest = hit_or_not(rows, F.col("rid"), found.select("rid2"))
    hits = maybe.join(found, (F.col("doc_id") == F.col("id")) & (F.col("rid") == F.col("rid2")), "left").select("doc_id", "text", "found")
    rows = hits.union(rest.select("doc_id", "text", F.lit(None).cast(found.schema["found"].dataType).alias("found")))
    out = F.arrow_udf(_strip, "struct<n_words:long,n_removed:long,kept_sha256:string>")(F.coalesce("text", F.lit("")), "found")
    return rows.select("doc_id", out.alias("s")).select("doc_id", "s.*")
