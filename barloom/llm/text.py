"""Vectorised words, lines and rolling hashes over the UTF-8 bytes of many texts.

A word is a maximal run of bytes other than space and 0x09-0x0D, which in UTF-8
is the same as a maximal run of such characters.  Memory is linear in the bytes
that a caller passes at once, about 40 times.

Hashes of 64 bits find what may be equal.  Where a result rests on equality, they
are of one text or of two, or a wider digest follows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# A random number for each byte at each of the first places of a span, and a random factor for each place of a window.
_PLACES = 64
_TABLE = np.random.default_rng(20).integers(0, 1 << 64, _PLACES << 8, dtype=np.uint64)
_FACTORS = np.random.default_rng(21).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def whole_id(docs: DataFrame, id_col: str) -> Column:
    """The identifier as a long, ``doc_id``; an error for a column that doesn't hold whole numbers."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be of a whole-number type, not {kind}")
    return F.col(id_col).cast("long").alias("doc_id")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Texts(NamedTuple):
    """Bytes of several texts end to end; text k is ``data[offsets[k]:offsets[k + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def part(self, a: int, b: int) -> Texts:
        return Texts(self.data[self.offsets[a] : self.offsets[b]], self.offsets[a : b + 1] - self.offsets[a])


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The texts of an Arrow column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets is not None and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(raw[offsets[0] : offsets[-1]], offsets - offsets[0])


def parts(texts: Texts, limit: int = 1 << 20) -> Iterator[tuple[int, int, Texts]]:
    """Runs of whole texts of about ``limit`` bytes, so that work arrays stay small."""
    a = 0
    while a < len(texts):
        b = int(np.searchsorted(texts.offsets, texts.offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), len(texts))
        yield a, b, texts.part(a, b)
        a = b


class Words(NamedTuple):
    """Words ``data[start[i]:end[i]]``; text k has words ``offsets[k]`` to ``offsets[k + 1]``."""

    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray


def split_words(texts: Texts) -> Words:
    data, offsets = texts
    inside = ~_SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    opens[first] = inside[first]
    closes[last] = inside[last]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(start, end, np.searchsorted(start, offsets))


def span_hashes(texts: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; equal ranges, wherever they stand, hash alike.  No range is empty.

    The sum of a random number for each byte at its place in the range, so that no
    pattern of bytes cancels out.
    """
    length = end - start
    if not len(length):
        return np.zeros(0, np.uint64)
    upto = np.append(0, np.cumsum(length))
    kind = np.int32 if max(len(texts.data), upto[-1]) < 1 << 23 else np.int64
    place = np.arange(upto[-1], dtype=kind)
    at = place + np.repeat((start - upto[:-1]).astype(kind), length)
    place -= np.repeat(upto[:-1].astype(kind), length)
    place <<= 8
    place |= texts.data[at]
    del at
    far = np.flatnonzero(place >= _PLACES << 8)
    values = _TABLE[np.minimum(place, (_PLACES << 8) - 1)]
    values[far] = mix(place[far].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mix(np.add.reduceat(values, upto[:-1]) + length.astype(np.uint64))


def window_hashes(items: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` items (windows may cross texts; see :func:`window_starts`)."""
    n = len(items) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += items[k : k + n] * _FACTORS[k]
    return mix(total)


def window_starts(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window lies within one text, and the text of each."""
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - first[text] + offsets[:-1][text], text


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a sorted array: the number of the run that each value is in, and where the runs start."""
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.cumsum(new) - 1, np.flatnonzero(new)


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Mask of the positions that a window of ``size`` from one of ``starts`` covers."""
    mask = np.zeros(n, bool)
    for k in range(size):
        mask[starts + k] = True
    return mask
