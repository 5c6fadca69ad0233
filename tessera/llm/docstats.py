"""Counts over whole texts, made for a batch of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import textops as tx

#: The symbols counted as n_symbols.
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
          "n_letters_upper", "n_digits", "n_punct", "n_chars", "n_distinct_words")
RESULT = "struct<" + ",".join(f"{c}:long" for c in COUNTS) + ">"
WINDOW = 5

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_IS_UPPER, _IS_DIGIT, _IS_PUNCT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_IS_UPPER[65:91] = True
_IS_DIGIT[48:58] = True
_IS_PUNCT[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between consecutive offsets."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _own(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The hashes made distinct between rows."""
    return tx.mix64(hashes ^ tx.mix64(row.astype(np.uint64) + np.uint64(1)))


def count_batch(tb: tx.TextBatch) -> dict[str, np.ndarray]:
    n, data = tb.n, tb.data
    w = tx.words(tb)
    counts = np.diff(w.first)
    out = {"n_words": counts}
    code_point = (data & 0xC0) != 0x80
    out["n_chars"] = _per_row(code_point, tb.offsets)
    out["word_chars"] = _per_row(code_point & ~tx.SPACE[data], tb.offsets)
    for name, table in (("n_symbols", _IS_SYMBOL), ("n_letters_upper", _IS_UPPER), ("n_digits", _IS_DIGIT), ("n_punct", _IS_PUNCT)):
        out[name] = _per_row(table[data], tb.offsets)
    # Lines: pieces between \n inside each row.
    cuts = np.flatnonzero(data == 10)
    starts = np.concatenate([tb.offsets[:-1], cuts + 1])
    row = np.concatenate([np.arange(n), np.searchsorted(tb.offsets, cuts, side="right") - 1])
    by = np.lexsort((starts, row))
    starts, row = starts[by], row[by]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = np.ones(len(row), bool)
    last[:-1] = row[1:] != row[:-1]
    ends[last] = tb.offsets[1:]
    worded = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, row = starts[worded], ends[worded], row[worded]
    lines = np.bincount(row, minlength=n)
    _, first = np.unique(_own(tx.span_hashes(tb, starts, ends), row), return_index=True)
    out["n_lines"] = lines
    out["n_dup_lines"] = lines - np.bincount(row[first], minlength=n)
    # Windows of five words inside a row that occur twice or more in it.
    of = np.repeat(np.arange(n), counts)
    _, first = np.unique(_own(w.hashes, of), return_index=True)
    out["n_distinct_words"] = np.bincount(of[first], minlength=n)
    grams = tx.gram_hashes(w.hashes, WINDOW)
    at = np.flatnonzero(of[: len(grams)] == of[WINDOW - 1 :][: len(grams)])
    covered = np.zeros(len(of) + 1, np.int64)
    if len(at):
        key = _own(grams[at], of[at])
        by = np.argsort(key)
        key = key[by]
        same = key[1:] == key[:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[by[twice]]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + WINDOW, -1)
    out["n_repeat_words"] = _per_row(np.cumsum(covered[:-1]) > 0, w.first)
    return out


@tx.tidied
def counts(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A struct of COUNTS for each text; null counts as empty."""
    for texts in it:
        parts: list[dict[str, np.ndarray]] = []
        for part in tx.chunks(pa.RecordBatch.from_arrays([texts], ["t"]), "t"):
            parts.append(count_batch(tx.text_batch(part.column("t"))))
        yield pa.StructArray.from_arrays(
            [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)) for c in COUNTS], list(COUNTS))
