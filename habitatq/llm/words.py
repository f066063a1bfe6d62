"""Vectorised words of Arrow text columns, shared by the text operators.

A text column is handled as the flat bytes Arrow keeps it in: word borders come from
a byte table, word and window fingerprints from running polynomial sums modulo 2**64,
so no Python object is made per word. Work is cut into slices of bounded bytes; one
very long text is a slice of its own and is summed in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
_BLOCK = 1 << 17
_U = np.uint64

#: Byte tables. A word byte is none of space, \t, \n, \v, \f, \r.
ANY_WORD = np.ones(256, bool)
ANY_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters, digits and every byte above ASCII.
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown when asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, b, _U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_BYTES, _ONE, _TWO = _Powers(0x9E3779B97F4A7C15), _Powers(0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit values; a bijection."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Words:
    """Words of a run of texts: byte borders in ``data``, and the first word of each text in ``ptr``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit fingerprint of each word's bytes."""
        n, out, a = len(self.start), np.empty(len(self.start), _U), 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(self.end, self.start[a] + _BLOCK, "right")))
            lo, hi = int(self.start[a]), int(self.end[b - 1])
            up, down = _BYTES.get(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, _U)
            np.cumsum((self.data[lo:hi].astype(_U) + _U(1)) * down[: hi - lo], out=sums[1:])
            s, e = self.start[a:b] - lo, self.end[a:b] - lo
            out[a:b] = (sums[e] - sums[s]) * up[e - 1]
            a = b
        return mix(out)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat UTF-8 bytes and text borders; a null text is empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    borders = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    borders = borders[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[borders[0] : borders[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, borders - borders[0]


def words_of(column: pa.Array, word_bytes: np.ndarray = ANY_WORD, lower: bool = False) -> Words:
    """Words of a text column: longest runs of ``word_bytes``."""
    data, offsets = text_buffers(column)
    if lower:
        data = LOWER[data]
    inside = word_bytes[data]
    n = len(data)
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = offsets[(offsets > 0) & (offsets < n)]
        first[edge] |= inside[edge]
        last[edge - 1] |= inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def window_hash(h: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """Fingerprint of each run of ``size`` consecutive values; ``second`` gives an independent one."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    up, down = (_TWO if second else _ONE).get(len(h) + 1)
    sums = np.zeros(len(h) + 1, _U)
    np.cumsum((mix(h + _U(0x632BE59BD9B4E019)) if second else h) * down[: len(h)], out=sums[1:])
    return mix((sums[size:] - sums[:n]) * up[size - 1 : size - 1 + n])


def window_starts(ptr: np.ndarray, size: int) -> np.ndarray:
    """Word indices at which a window of ``size`` words lies inside one text."""
    n = int(ptr[-1])
    ok = np.ones(n, bool)
    for back in range(1, size):
        tail = ptr[1:] - back
        ok[tail[tail >= ptr[:-1]]] = False
    return np.flatnonzero(ok)


def slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES, rows: int = 4096
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` text bytes and at most ``rows``; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        done, a = np.cumsum(sizes), 0
        while a < len(sizes):
            b = min(a + rows, max(a + 1, int(np.searchsorted(done, done[a] - sizes[a] + limit, "right"))))
            yield batch.slice(a, b - a)
            a = b


def minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the index of its smallest, the leftmost among equals.

    Depends on the values in the run alone, so equal runs choose the same place.
    """
    if len(grams) < width:
        return np.zeros(0, np.int64)
    low = ((grams >> _U(32)) << _U(32)) | np.arange(len(grams), dtype=_U)
    have = 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return (low & _U(0xFFFFFFFF)).astype(np.int64)


def spans(lengths: np.ndarray) -> np.ndarray:
    """0..length-1 for each length, one after the other."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def id_text(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Id and text alone, so that clashing extra columns never meet the operator's own."""
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def ascii_lower(column: Column | str) -> Column:
    """A-Z lower-cased, everything else unchanged."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
