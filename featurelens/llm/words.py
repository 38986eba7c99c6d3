"""Words and their hashes, computed for many texts at once with numpy inside a task.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Its hash is a Rabin-Karp polynomial
over its bytes modulo 2^64, mixed; sequences of words are hashed by the same rolling polynomial over
word hashes.  64 bits: among n different sequences n^2 / 2^65 pairs agree by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed in one step, and the bytes of text that callers take at a time.
STEP = 1 << 20
PIECE = 4 << 20
BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose result bits depend on all bits of ``x``."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


CODES = mix(np.arange(1, 257, dtype=U) * U(BASE))
FOLDED = CODES.copy()
FOLDED[ord("A"):ord("Z") + 1] = CODES[ord("a"):ord("z") + 1]


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self, base: int):
        self.bases = base, pow(base, -1, 1 << 64)
        self.of = [np.ones(1, U), np.ones(1, U)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.of[0]) < n:
            size = max(n, 2 * len(self.of[0]))
            for i, base in enumerate(self.bases):
                grown = np.full(size, U(base))
                grown[0] = 1
                self.of[i] = np.cumprod(grown, dtype=U)
        return self.of[0][:n], self.of[1][:n]


BYTE_POWERS, WORD_POWERS = Powers(BASE), Powers(WORD_BASE)


@dataclass
class Words:
    """The words of several texts, in order."""

    doc: np.ndarray  # index of the text
    start: np.ndarray  # in ``data``
    end: np.ndarray
    hash: np.ndarray
    count: np.ndarray  # words of each text
    data: np.ndarray  # bytes of all texts
    offset: np.ndarray  # where each text begins in ``data``, and the end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return data, (at - at[0] if len(texts) else np.zeros(1, np.int64))


def words(texts: pa.Array, fold: bool = False) -> Words:
    """``fold``: A-Z hash like a-z."""
    data, offset = text_bytes(texts)
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offset] = True
    before, after = np.empty_like(solid), np.empty_like(solid)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    if len(data):
        before[0] = after[-1] = False
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    doc = np.searchsorted(offset, start, "right") - 1
    hashes, codes, i = np.empty(len(start), U), FOLDED if fold else CODES, 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + STEP, "right")))
        low = start[i]
        part = codes[data[low:end[j - 1]]]
        power, inverse = BYTE_POWERS.upto(len(part) + 1)
        total = np.zeros(len(part) + 1, U)
        np.cumsum(part * power[:-1], out=total[1:])
        s, e = start[i:j] - low, end[i:j] - low
        hashes[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U))
        i = j
    return Words(doc, start, end, hashes, np.bincount(doc, minlength=len(offset) - 1).astype(np.int64), data, offset)


def sequences(w: Words, first: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` words from each of ``first`` (indices of words) on."""
    power, inverse = WORD_POWERS.upto(len(w.hash))
    total = np.zeros(len(w.hash) + 1, U)
    np.cumsum(w.hash * power, out=total[1:])
    return mix((total[first + k] - total[first]) * inverse[first]) if len(first) else np.zeros(0, U)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words (indices) and hashes of all windows of ``k`` words within a text."""
    n = len(w.hash)
    first = np.flatnonzero(w.doc[:n - k + 1] == w.doc[k - 1:]) if n >= k else np.zeros(0, np.int64)
    return first, sequences(w, first, k)


def parts(table: pa.Table, column: str, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a table with about ``most`` bytes in ``column``, one row at least."""
    for batch in table.to_batches():
        size = max(1, batch.column(column).nbytes)
        rows = max(1, batch.num_rows * most // size)
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
