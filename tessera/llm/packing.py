"""Packing token sequences: first-fit decreasing with a tournament tree.

Texts become token ids and are cut at every ``SEQ`` tokens; whole pieces fill a
sequence each and only remainders are packed.  Pieces are dealt out by a hash of
their document, so each partition is a random group; it is packed in runs of
``GROUP`` documents, so memory does not depend on the size of a partition.  In a
run, remainders go longest first to the first sequence with room, which a
tournament tree over the sequences' free space finds in logarithmic time.

Defined results: a null text is an empty one and has the end token alone.  Rows
that repeat an id are packed one by one.  Texts of any length are encoded whole.  Pieces of
equal length go in the order they have after the deal.  Sequence numbers are unique, not
dense.  Columns beyond doc_id and text are not read; no rows give none.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx

SEQ, GROUP, END_ID = 2048, 8192, 1
TOKENIZER = "word_bpe_49k.json"
PIECES = "struct<doc_tokens:long,pieces:array<struct<start:long,length:long,ids_crc32:long>>>"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: A character that is not plain.  Plain ones are ASCII white space, letters, digits and punctuation, and Latin letters that
#: are one code point, stay one when lower-cased, and cannot compose with a neighbour here.
_ODD = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ]")
#: The pieces of ``TOKENIZER`` in plain text in lower case.
_PIECE = re.compile("[a-zß-öø-ÿ]+|'(?:[stmd]|re|ve|ll)|[0-9]|[!-/:-@\\[-`{-~]+")


class Kept(dict):
    """What ``find`` gives for a key, in two generations of ``limit`` keys; the older one goes when the newer is full.

    Keys over ``LONG`` are asked for each time, so that memory is bounded."""

    LONG = 100

    def __init__(self, find: Callable, limit: int):
        self.find, self.limit, self.old = find, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.find(key)
            if len(key) > self.LONG:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes.

    ``TOKENIZER`` drops white space and never merges across its pieces.  Plain texts
    skip its normalizer and pre-tokenizer: one pattern finds the pieces, whose ids are
    kept in two generations of a bounded cache.  In a text with odd characters or with
    what may be a special token this is done for each word, as ids of a text are those
    of its words in order; words are kept in such a cache too, and one that is not
    plain itself is encoded by the tokenizer.
    Other tokenizers encode each text as a whole.
    """

    LIMIT, PIECE_LIMIT = 30_000, 150_000
    #: Characters of a plain text that are cut into pieces at once, and those up to the next space.
    STEP = 1 << 16

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.by_word = os.path.basename(path) == TOKENIZER
        self.model = self.whole.model
        bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {k: bytes_of.pre_tokenize_str(chr(k))[0][0] for k in range(0xC0, 0x100) if chr(k).isalpha()}
        self.packed = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]
        self.words = Kept(self.word, self.LIMIT)
        self.pieces = Kept(self.piece, self.PIECE_LIMIT)

    def _pack(self, ids: list[int]) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def piece(self, text: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(text if text.isascii() else text.translate(self.spelled))])

    def plain(self, text: str) -> bytes | None:
        """The ids of a plain text; None of another."""
        if _ODD.search(text) or "<|" in text:
            return None
        low, at, out = text.lower(), 0, []
        while at < len(low):
            to = low.find(" ", at + self.STEP)
            to = len(low) if to < 0 else to
            out.append(b"".join(map(self.pieces.__getitem__, _PIECE.findall(low, at, to))))
            at = to
        return b"".join(out)

    def word(self, raw: bytes) -> bytes:
        if raw.isalpha():  # ASCII alone
            return self.pieces[raw.lower().decode()]
        text = raw.decode()
        ids = self.plain(text)
        return self._pack(self.whole.encode(text, add_special_tokens=False).ids) if ids is None else ids

    def text(self, text: str) -> bytes:
        if not self.by_word:
            return self._pack(self.whole.encode(text, add_special_tokens=False).ids)
        ids = self.plain(text)
        # Bytes are split at ASCII white space only.
        return b"".join(map(self.words.__getitem__, text.encode().split())) if ids is None else ids


_encoders: dict[str, Encoder] = {}


def encoder(name: str = TOKENIZER) -> Encoder:
    if name not in _encoders:
        import public_tokenizers

        _encoders[name] = Encoder(name if "/" in name else public_tokenizers.path(name))
    return _encoders[name]


def tokenized(tokenizer: str = TOKENIZER, seq: int = SEQ):
    """A column function: text to doc_tokens and its pieces of at most ``seq`` tokens."""
    end = END_ID.to_bytes(4, "little")
    kind = pa.struct([("doc_tokens", pa.int64()), ("pieces", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])))])

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(tokenizer)
        for texts in it:
            totals, offsets, starts, lengths, crcs = [], [0], [], [], []
            for text in texts:
                ids = enc.text(text.as_py() or "") + end
                n = len(ids) // 4
                totals.append(n)
                for a in range(0, n, seq):
                    b = min(n, a + seq)
                    starts.append(a)
                    lengths.append(b - a)
                    crcs.append(zlib.crc32(ids[4 * a : 4 * b]))
                offsets.append(len(starts))
            flat = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["start", "length", "ids_crc32"])
            pieces = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            yield pa.StructArray.from_arrays([pa.array(totals, pa.int64()), pieces], ["doc_tokens", "pieces"]).cast(kind)

    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(tx.tidied(run), PIECES)


class FirstFit:
    """Bins of equal size; a tournament tree holds the most free space below each node."""

    def __init__(self, bins: int, size: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [size] * (2 * self.leaves)
        self.size = size

    def place(self, length: int) -> tuple[int, int]:
        """The first bin with room, and the offset there."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < length:
                at += 1
        offset = self.size - free[at]
        free[at] -= length
        bin_, at = at - self.leaves, at // 2
        while at:
            most = free[2 * at] if free[2 * at] > free[2 * at + 1] else free[2 * at + 1]
            if free[at] == most:
                break
            free[at] = most
            at //= 2
        return bin_, offset


def first_fit_decreasing(lengths: list[int], size: int = SEQ) -> list[tuple[int, int]]:
    """(bin, offset) of each length; ties in the order given."""
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    tree = FirstFit(len(lengths), size)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        out[i] = tree.place(lengths[i])
    return out


@tx.tidied
def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 40
    held: list[pa.RecordBatch] = []
    count = 0

    def flush(rows: pa.RecordBatch, first: int) -> tuple[pa.RecordBatch, int]:
        lengths = rows.column("length").to_pylist()
        short = [i for i, n in enumerate(lengths) if n < SEQ]
        seq, off = [0] * len(lengths), [0] * len(lengths)
        used = 0
        for i, (b, o) in zip(short, first_fit_decreasing([lengths[i] for i in short])):
            seq[i], off[i], used = first + b, o, max(used, b + 1)
        at = first + used
        for i, n in enumerate(lengths):
            if n >= SEQ:
                seq[i] = at
                at += 1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        return pa.RecordBatch.from_arrays([rows.column(c) for c in names] + [pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*names, "sequence_id", "offset"]), at

    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        while count >= GROUP:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            out, first = flush(rows.slice(0, GROUP), first)
            yield out
            held, count = [rows.slice(GROUP)], count - GROUP
    if count:
        yield flush(pa.Table.from_batches(held).combine_chunks().to_batches()[0], first)[0]


def pack(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, text) to one row for each piece: its place in its document and in its sequence."""
    cut = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), tokenized(tokenizer)(F.coalesce("text", F.lit(""))).alias("t"))
    rows = cut.select("doc_id", "h", "t.doc_tokens", F.inline("t.pieces"))
    rows = rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "h")
    dealt = rows.repartition(F.col("h")).sortWithinPartitions("h", "doc_id", "start")
    return dealt.mapInArrow(_pack, PACKED)
