"""Vectorised text primitives shared by the corpus operators.

Everything works on whole Arrow string batches: words, lines and shingles of
all rows of a batch are found and hashed with numpy, without a Python loop over
words.  Null texts count as empty.  Hashes are 64-bit and depend only on the
bytes, so they agree between tasks, retries and machines.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once, with some 40 times as much memory; a longer single text is still taken whole.
CHUNK_BYTES = 1 << 19

_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_MULT, -1, 1 << 64)


def tidied(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``f`` over batches; what it has freed goes back to the system at its end, as Python workers are
    used again and an executor's workers would else keep the most that each task ever took."""
    @wraps(f)
    def run(it: Iterator) -> Iterator:
        try:
            yield from f(it)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: One 64-bit code for each byte value, made from a rule.
BYTE_CODES = mix64(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))
#: The same codes with A-Z taken as a-z.
LOWER_CODES = BYTE_CODES.copy()
LOWER_CODES[65:91] = BYTE_CODES[97:123]

#: The word separators, \x20 and \x09 to \x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.ones(size, dtype=U64)
        have[1:] = U64(base & _MASK)
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have


@dataclass
class TextBatch:
    """Rows of text as one byte buffer. ``offsets`` has n + 1 entries from 0."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)


def text_batch(column: pa.Array) -> TextBatch:
    """A batch's texts without copying their bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n, at = len(column), column.offset
    if n == 0 or offs is None:
        return TextBatch(np.zeros(0, np.uint8), np.zeros(n + 1, np.int64))
    offsets = np.frombuffer(offs, dtype=np.int64 if large else np.int32)[at : at + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return TextBatch(raw[offsets[0] : offsets[-1]], offsets - offsets[0])


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a record batch with about ``limit`` bytes of text each, one row at least."""
    if batch.num_rows == 0:
        return
    offsets = text_batch(batch.column(column)).offsets
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


@dataclass
class Words:
    """Words of a batch: byte spans, 64-bit hashes, and the first word of each row (n + 1)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def span_hashes(tb: TextBatch, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """Hash of the bytes of each span; equal bytes give equal hashes wherever they stand."""
    n = len(tb.data)
    prefix = np.zeros(n + 1, dtype=U64)
    np.cumsum(codes[tb.data] * powers(_MULT, n + 1)[:n], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * powers(_INV, n + 1)[starts]
    return mix64(h + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))


def words(tb: TextBatch, lower: bool = False, hashed: bool = True) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every row; ``lower`` takes A-Z as a-z in the hashes."""
    n = len(tb.data)
    inside = ~SPACE[tb.data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[tb.offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = span_hashes(tb, starts, ends, LOWER_CODES if lower else BYTE_CODES) if hashed else np.zeros(0, U64)
    return Words(starts, ends, hashes, np.searchsorted(starts, tb.offsets))


def gram_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive values (len - size + 1 of them)."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    if size <= 8:
        out = np.zeros(n, dtype=U64)
        for j in range(size):
            out = out * U64(_MULT) + values[j : j + n]
        return mix64(out)
    total = len(values)
    prefix = np.zeros(total + 1, dtype=U64)
    np.cumsum(values * powers(_MULT, total + 1)[:total], out=prefix[1:])
    return mix64((prefix[size:] - prefix[:n]) * powers(_INV, total + 1)[:n])


def shingle_sets(w: Words, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's shingles of ``size`` words; a row with fewer words has
    one shingle, its whole sequence; a row without words has none."""
    grams = gram_hashes(w.hashes, size)
    out = []
    first = w.first.tolist()
    for a, b in zip(first[:-1], first[1:]):
        k = b - a
        if k >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif k:
            short = U64(k)
            with np.errstate(over="ignore"):
                for x in w.hashes[a:b]:
                    short = short * U64(_INV) + x
            out.append(mix64(np.array([short], dtype=U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed column for Spark."""
    return x.view(np.int64) if x.dtype == U64 else x
