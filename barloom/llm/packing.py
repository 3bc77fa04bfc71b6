"""Packing documents into windows by Karmarkar-Karp multiway differencing.

A document's ids, the end id last, are cut into full windows, each of which is a
sequence, and a rest.  Rests are dealt into groups by a hash.  In a group every
rest starts as a partial partition of its own; the two partial partitions with
the largest imbalance are merged, the fullest windows of one with the emptiest
of the other, until one is left.  The number of windows is at first the least that
holds all ids, and rises while a window exceeds its capacity, until all fit; no rest
is cut.  Only with a ``slack`` does that end where the padding would exceed it: the
excess of the first, fullest attempt is then cut off and fills windows with room.

Cases: a null text counts as empty, so it is the end id alone; repeated rows are
packed each on its own, and spread over groups; a document of any length; the identifier
must be of a whole-number type, and may be null; empty tables give empty results; other columns
are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .store import small_batches
from .text import parts, texts_of, whole_id
from .vocab import WordVocabulary, loaded, release, tidy

CAPACITY = 4096
GROUP_BYTES = 2 << 20
# Words that a worker's encoder remembers; a heap that earlier stages have filled leaves a worker little else.
WORDS = 200_000
# Sequences of the rests of group g are numbered from g * 2**GROUP_BITS; those of full windows, from -1 down.
GROUP_BITS = 24


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """``k`` windows with near-equal sums, as lists of item numbers (empty ones at the end).

    A partial partition lists its non-empty windows by falling sum; the others
    count as empty.
    """
    heap = []
    for n, size in enumerate(sizes):
        heap.append((-size if k > 1 else 0, n, [(size, (n,))]))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = len(a) + len(b) - k
        if both > 0:  # the emptiest windows of one meet the emptiest of the other, crosswise
            keep_a, keep_b = len(a) - both, len(b) - both
            met = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[keep_a:], reversed(b[keep_b:]), strict=True)]
            merged = a[:keep_a] + b[:keep_b] + met
        else:
            merged = a + b
        merged.sort(key=lambda w: -w[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, serial, merged))
        serial += 1
    windows = [list(items) for _, items in heap[0][2]] if heap else []
    return windows + [[] for _ in range(k - len(windows))]


def pack_rests(sizes: list[int], capacity: int, slack: float | None) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, length); together they hold every item once."""
    total = sum(sizes)
    if not total:
        return []
    least = -(-total // capacity)
    k, first, most = least, None, None if slack is None else max(least + 1, int(total / (capacity * (1 - slack))))
    while most is None or k <= most:  # ends at a window for each rest at the latest
        windows = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return [[(i, 0, sizes[i]) for i in w] for w in windows if w]
        first = first or windows
        k += max(1, k // 200)
    windows = first
    packed, excess = [], []
    for window in windows:
        room, out = capacity, []
        for i in sorted(window, key=lambda i: -sizes[i]):
            take = min(room, sizes[i])
            if take:
                out.append((i, 0, take))
            if take < sizes[i]:
                excess.append((i, take, sizes[i] - take))
            room -= take
        packed.append((room, out))
    for i, start, length in excess:
        packed.sort(key=lambda p: -p[0])
        k = 0
        while length:
            room, out = packed[k]
            take = min(room, length)
            out.append((i, start, take))
            packed[k] = (room - take, out)
            start, length, k = start + take, length - take, k + 1
    return [out for _, out in packed if out]


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
# While they are dealt, pieces also carry a number that parts the rows of one identifier.
_CUT = _PIECES.insert(6, pa.field("nth", pa.int64()))
_PIECES_SQL = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = 2,
    capacity: int = CAPACITY,
    slack: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32-bit)."""
    small_batches(docs.sparkSession)
    source = docs.select(whole_id(docs, id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_bytes = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = max(1, -(-n_bytes // GROUP_BYTES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # Full windows are sequences at once, numbered -1, -2, ... in steps of the partition.
        partition, serial = TaskContext.get().partitionId(), 0
        encoder = loaded((WordVocabulary, vocabulary), limit=WORDS)[0]
        for batch in batches:
            column = batch.column(1)
            for a, b, _ in parts(texts_of(column), 1 << 20):
                ids, n = encoder.encode(column.slice(a, b - a).to_pylist())
                nth = pd.Series(batch.column(0).slice(a, b - a).to_pylist(), dtype=object)
                nth = nth.groupby(nth, dropna=False, sort=False).cumcount().to_numpy() + (partition << 20)
                data = np.insert(ids, np.cumsum(n), end_id).astype("<u4")
                n = n + 1
                first = np.cumsum(n) - n
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, n[doc] - start)
                full = length == capacity
                number = np.where(full, -1 - ((np.cumsum(full) + serial) + (partition << 40)), 0)
                serial += int(full.sum())
                offsets = np.append(first[doc] + start, len(data)) * 4
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(pa.array(doc)),
                        *(pa.array(x, pa.int64()) for x in (start, length, n[doc], number, np.zeros(len(doc)))),
                        pa.array(nth[doc], pa.int64()),
                        pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]),
                    ],
                    schema=_CUT,
                )
        tidy()

    def pack(table: pa.Table) -> pa.Table:
        release()
        group = table.column("group")[0].as_py()
        table = table.drop_columns(["group"]).combine_chunks()
        rest = pc.equal(table.column("sequence_id"), 0)
        whole, table = table.filter(pc.invert(rest)), table.filter(rest)
        sizes, ids = table.column("length").to_pylist(), table.column("ids").to_pylist()
        rows = []
        for number, window in enumerate(pack_rests(sizes, capacity, slack)):
            at = 0
            for i, start, length in window:
                rows.append((i, start, length, (group << GROUP_BITS) + number, at, ids[i][4 * start : 4 * (start + length)]))
                at += length
        if not rows:
            return whole
        item, start, length, sequence, offset, data = zip(*rows, strict=True)
        own = table.take(pa.array(item))
        begin = pa.array(np.array(start) + own.column("start").to_numpy())
        packed = pa.table([own.column("doc_id"), begin, pa.array(length), own.column("doc_tokens"), pa.array(sequence), pa.array(offset), pa.array(data, pa.binary())], schema=_PIECES)
        return pa.concat_tables([whole, packed])

    # Full windows pass through a group too, so that texts are encoded once.
    pieces = source.mapInArrow(cut, _PIECES_SQL.replace("ids binary", "nth bigint, ids binary"))
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "nth"), F.lit(groups))).drop("nth")
    return pieces.groupBy("group").applyInArrow(pack, _PIECES_SQL)
