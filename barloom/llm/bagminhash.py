"""BagMinHash signatures of word-shingle multisets, for many documents at once.

A shingle of weight w stands for the interval (0, w].  The line is cut at 1, 2,
4, 8, ..., and each piece of each shingle has a Poisson process of its own, seeded
by shingle and piece, with a rate equal to the piece's length; a point has a place
in its piece and counts if that place is at most w.  So heavier shingles see a
superset of the points of lighter ones, and log2(w) processes suffice.  A point
belongs to one signature component, drawn evenly; a component keeps its earliest
point.  Two multisets agree in a component with the probability of their weighted
Jaccard similarity.

Points come in order of time, so a process stops at the time by which a document
of that total weight has almost surely filled every component; the few documents
with an empty component are done again for longer.  The number of points does not
depend on a document's length.
"""

from __future__ import annotations

import numpy as np

from .text import Texts, mix, runs, span_hashes, split_words, window_hashes, window_starts

SHINGLE = 5
HASH_BITS = 48
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(texts: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text number, 48-bit hash and count, in that order.

    Words are compared after lower-casing A-Z.  A text with some words, but fewer
    than ``size``, has one shingle: all its words.  At most 65,536 texts at once.
    """
    texts = Texts(_LOWER[texts.data], texts.offsets)
    words = split_words(texts)
    hashes = span_hashes(texts, words.start, words.end)
    at, text = window_starts(words.offsets, size)
    hashed = window_hashes(hashes, size)[at] if len(at) else np.zeros(0, np.uint64)
    n_words = np.diff(words.offsets)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    whole = np.zeros(len(short), np.uint64)
    for n in range(1, size):
        own = n_words[short] == n
        if own.any():
            whole[own] = window_hashes(hashes, n)[words.offsets[:-1][short[own]]]
    key = (np.concatenate([text, short]).astype(np.uint64) << np.uint64(HASH_BITS)) | (np.concatenate([hashed, whole]) >> np.uint64(64 - HASH_BITS))
    key.sort()
    _, first = runs(key)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(HASH_BITS)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1), count


def _uniform(state: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((state >> np.uint64(11)) + np.uint64(1)) * (1.0 / (1 << 53))


def signatures(n_texts: int, text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, m: int, spare: float = 6.0) -> np.ndarray:
    """``(n_texts, m)`` 64-bit components; rows of texts without shingles hold the largest number."""
    out = np.full((n_texts, m), np.iinfo(np.uint64).max, np.uint64)
    total = np.bincount(text, weight, n_texts)
    todo, limit = total > 0, m * (np.log(m) + spare) / np.maximum(total, 1)
    while todo.any():
        own = todo[text]
        _fill(out, text[own], shingle[own], weight[own], limit, m)
        todo &= (out == np.iinfo(np.uint64).max).any(axis=1)
        limit *= 3
    return out


def _fill(out: np.ndarray, text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, limit: np.ndarray, m: int) -> None:
    flat = out.reshape(-1)
    low, piece = 0, 0
    while len(text):
        length = max(low, 1)
        item, time = np.arange(len(text)), np.zeros(len(text))
        state = mix(shingle * np.uint64(0x9E3779B97F4A7C15) + np.uint64(piece))
        while len(item):
            state = mix(state + np.uint64(0x9E3779B97F4A7C15))
            time = time - np.log(_uniform(state)) / length
            on = time <= limit[text[item]]
            item, time, state = item[on], time[on], state[on]
            drawn = mix(state ^ np.uint64(0xD1342543DE82EF95))
            component = ((drawn >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            place = low + (drawn & np.uint64(0xFFFFFFFF)).astype(np.float64) * (length / (1 << 32))
            counts = place < weight[item]
            early = time[counts].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)
            np.minimum.at(flat, text[item[counts]] * m + component[counts].astype(np.int64), early | (state[counts] & np.uint64(0xFFFFFFFF)))
        low = max(1, 2 * low)
        piece += 1
        more = weight > low
        text, shingle, weight = text[more], shingle[more], weight[more]


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """``(n, bands)`` keys; equal where all rows of a band are equal."""
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(signature), bands))
    for k in range(rows):
        key = mix(key ^ parts[:, :, k])
    return key
