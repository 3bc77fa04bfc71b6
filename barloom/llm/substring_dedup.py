"""Removal of passages that occur in an earlier document, by fixed-block anchors.

Reference blocks are the non-overlapping blocks of 7 words of every document.
Any 13 consecutive words hold one whole block, so a passage of 13 words or more
that two documents share is hit when the rolling 7-word windows of one probe the
blocks of the other.  Hits are extended to 13-word windows, and exact repeats of
these, merged where they overlap, are the maximal repeats to remove.

Documents are dealt by a hash of their key into batches of a few MB, and a batch
talks to the hash buckets in whole arrays:

1. a batch sends each distinct 7-word hash once, with two bits: a block starts
   here; two of its documents have it.  A bucket answers with one bit per hash:
   a block, and in two documents at least.
2. for windows that hold such a hash, the batch sends each distinct 13-word
   sequence once, as a 16-byte BLAKE2b digest of its words, with its smallest
   document.  The bucket answers with one bit per digest: some document elsewhere
   is smaller still.
3. the batch removes what the bits say.

So the hashes of step 1 only choose what is looked at, and equal words always hash
alike; what is removed rests on the digests, for which no two word sequences are
known to agree.

A batch sends a hash once however many of its documents hold it, so a passage
that a third of all documents share costs a bucket one entry a batch; no pairs
of documents are formed.  The texts are shuffled once, by batch, and that
exchange serves all three steps.  What step 1 sends is 4 bytes a word (the
bucket number gives further bits); a false agreement there only costs digests in
step 2.

Cases: null and short texts have no windows and lose nothing; equal identifiers
are not smaller than each other, and a null identifier is larger than any other;
repeated rows each give a row; words of any length; the identifier must be of a
whole-number type; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import covered, parts, runs, span_hashes, split_words, texts_of, window_hashes, window_starts, whole_id
from .vocab import release

WINDOW, BLOCK = 13, 7
BATCH_BYTES = 4 << 20
BUCKET_BYTES = 12 << 20


class _Batch:
    """The documents of one batch in the order of their identifiers, with their window hashes."""

    def __init__(self, table: pa.Table):
        release()
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = table.column("doc_id")
        self.rank = self.ids.fill_null(np.iinfo(np.int64).max).to_numpy()
        self.texts = texts_of(table.column("text"))
        words, hashes, at, base = [], [], 0, 0
        for _, _, part in parts(self.texts):
            w = split_words(part)
            hashes.append(span_hashes(part, w.start, w.end))
            words.append((w.start + base, w.end + base, w.offsets[:-1] + at))
            at += len(w.start)
            base += len(part.data)
        join = lambda k: np.concatenate([w[k] for w in words]) if words else np.zeros(0, np.int64)
        self.start, self.end = join(0), join(1)
        self.offsets = np.append(join(2), at)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)

    def anchors(self):
        """Distinct block-size hashes in ascending order, their bits, and the way back to the positions."""
        at, text = window_starts(self.offsets, BLOCK)
        hashed = window_hashes(self.hashes, BLOCK)[at]
        order = np.argsort(hashed)
        ordered = hashed[order]
        run, first = runs(ordered)
        aligned = np.zeros(len(first), bool)
        aligned[run[((at - self.offsets[text]) % BLOCK == 0)[order]]] = True
        several = np.zeros(len(first), bool)
        docs = self.rank[text][order]
        several[run[1:][(docs[1:] != docs[:-1]) & (run[1:] == run[:-1])]] = True
        return ordered[first], aligned, several, at[order], run

    def candidates(self, shared: np.ndarray):
        """Distinct windows that hold a shared anchor: digest (two numbers), its first window, and all windows' starts, texts and digests' numbers."""
        _, _, _, at, run = self.anchors()
        flag = np.zeros(len(self.hashes) + 1, np.int64)
        flag[at[shared[run]] + 1] = 1
        flag = np.cumsum(flag)
        start, text = window_starts(self.offsets, WINDOW)
        hit = flag[start + WINDOW - BLOCK + 1] > flag[start]
        start, text = start[hit], text[hit]
        digests = self.digests(start)
        order = np.lexsort((digests[:, 1], digests[:, 0]))  # stable, so documents ascend within a digest
        ordered = digests[order]
        new = np.ones(len(order), bool)
        new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
        return ordered[new], order[new], start[order], text[order], np.cumsum(new) - 1

    def digests(self, start: np.ndarray) -> np.ndarray:
        """A 128-bit digest of the words, joined by one space, of each window; a row of two numbers."""
        used = np.zeros(len(self.start) + WINDOW, bool)
        for k in range(WINDOW):
            used[start + k] = True
        used = np.flatnonzero(used[: len(self.start)])
        begin, length = self.start[used], self.end[used] - self.start[used]
        place = np.append(0, np.cumsum(length + 1))
        joined = np.full(place[-1], 0x20, np.uint8)
        at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        joined[at + np.repeat(place[:-1], length)] = self.texts.data[at + np.repeat(begin, length)]
        first = np.searchsorted(used, start)
        data, blake = memoryview(joined), hashlib.blake2b
        spans = zip(place[first].tolist(), (place[first + WINDOW] - 1).tolist(), strict=True)
        return np.frombuffer(b"".join([blake(data[a:b], digest_size=16).digest() for a, b in spans]), "<u8").reshape(-1, 2)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash: a multiple of its top 32 bits, so buckets are ranges of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _slices(bucket: np.ndarray):
    _, first = runs(bucket)
    return zip(bucket[first].tolist(), first.tolist(), np.append(first, len(bucket))[1:].tolist(), strict=True)


def _bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def _mask(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


_SENT = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
_ANSWER = pa.schema([("batch", pa.int64()), ("step", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])
_SENT_SQL = "bucket bigint, batch bigint, n bigint, hashes binary, a binary, b binary"
_ANSWER_SQL = "batch bigint, step bigint, bucket bigint, n bigint, bits binary"


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _answers(table: pa.Table, step: int) -> np.ndarray:
    """The answered bits of one step in ascending order of the buckets, as they were sent."""
    rows = [r for r in table.to_pylist() if r["step"] == step]
    masks = [_mask(r["bits"], r["n"]) for r in sorted(rows, key=lambda r: r["bucket"])]
    return np.concatenate(masks) if masks else np.zeros(0, bool)


def _split_answer(rows: list[dict], step: int, mask: np.ndarray) -> pa.Table:
    ends = np.cumsum([r["n"] for r in rows]) if rows else []
    return _rows(_ANSWER, [(r["batch"], step, r["bucket"], r["n"], _bits(mask[e - r["n"] : e])) for r, e in zip(rows, ends, strict=True)])


def _send_anchors(table: pa.Table, buckets: int) -> pa.Table:
    batch = table.column("batch")[0].as_py()
    hashes, aligned, several, _, _ = _Batch(table).anchors()
    return _rows(
        _SENT,
        [(k, batch, b - a, hashes[a:b].astype(np.uint32).tobytes(), _bits(aligned[a:b]), _bits(several[a:b])) for k, a, b in _slices(_bucket(hashes, buckets))],
    )


def _answer_anchors(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    hashes = np.concatenate([np.frombuffer(r["hashes"], np.uint32) for r in rows])
    order = np.argsort(hashes)
    run, first = runs(hashes[order])
    entries = np.diff(np.append(first, len(hashes)))
    any_of = lambda c: np.logical_or.reduceat(np.concatenate([_mask(r[c], r["n"]) for r in rows])[order], first)
    shared = any_of("a") & ((entries > 1) | any_of("b"))
    mask = np.zeros(len(hashes), bool)
    mask[order] = shared[run]
    return _split_answer(rows, 1, mask)


def _by_bucket(digests: np.ndarray, first: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sending: by bucket, then by position, in which documents ascend."""
    bucket = _bucket(digests[:, 0], buckets)
    order = np.lexsort((first, bucket))
    return order, bucket[order]


def _send_windows(docs: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    if not docs.num_rows:
        return _rows(_SENT, [])
    batch = _Batch(docs)
    digests, first, _, text, run = batch.candidates(_answers(answers, 1))
    owner = batch.rank[text][runs(run)[1]] if len(run) else np.zeros(0, np.int64)
    order, bucket = _by_bucket(digests, first, buckets)
    digests, owner = digests[order], owner[order]
    out = []
    for k, a, b in _slices(bucket):
        run, begin = runs(owner[a:b])
        out.append((k, docs.column("batch")[0].as_py(), b - a, digests[a:b].tobytes(), owner[a:b][begin].tobytes(), begin.astype(np.uint32).tobytes()))
    return _rows(_SENT, out)


def _answer_windows(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    digests = np.concatenate([np.frombuffer(r["hashes"], "<u8") for r in rows]).reshape(-1, 2)
    owner = np.concatenate([np.repeat(np.frombuffer(r["a"], np.int64), np.diff(np.append(np.frombuffer(r["b"], np.uint32), r["n"]))) for r in rows])
    order = np.lexsort((digests[:, 1], digests[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (digests[order[1:]] != digests[order[:-1]]).any(axis=1)
    least = np.minimum.reduceat(owner[order], np.flatnonzero(new))
    mask = np.zeros(len(order), bool)
    mask[order] = owner[order] > least[np.cumsum(new) - 1]
    return _split_answer(rows, 2, mask)


def _remove(docs: pa.Table, answers: pa.Table, buckets: int, id_type: pa.DataType) -> pa.Table:
    schema = pa.schema([("doc_id", id_type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.large_string())])
    if not docs.num_rows:
        return schema.empty_table().cast(pa.schema([*list(schema)[:3], ("kept_text", pa.string())]))
    batch = _Batch(docs)
    digests, first, start, text, run = batch.candidates(_answers(answers, 1))
    order, _ = _by_bucket(digests, first, buckets)
    elsewhere = np.zeros(len(digests), bool)
    elsewhere[order] = _answers(answers, 2)
    rank = batch.rank[text]
    owner = rank[runs(run)[1]] if len(run) else rank
    removed = covered(len(batch.hashes), start[elsewhere[run] | (rank > owner[run])], WINDOW)

    data, offsets = batch.texts
    kept = ~removed
    change = np.zeros(len(data) + 1, np.int8)
    change[batch.start[kept]] += 1
    change[batch.end[kept]] -= 1
    keep = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    n_words = np.diff(batch.offsets)
    upto = np.append(0, np.cumsum(kept))
    n_kept = upto[batch.offsets[1:]] - upto[batch.offsets[:-1]]
    # A byte of white space follows each kept word but a text's last; it becomes the one space between.
    which = np.flatnonzero(kept)
    has_next = np.ones(len(which), bool)
    has_next[upto[batch.offsets[1:]][n_kept > 0] - 1] = False
    gaps = batch.end[which[has_next]]
    data = data.copy()
    data[gaps] = 0x20
    keep[gaps] = True
    total = np.append(0, np.cumsum(keep))
    new_offsets = total[offsets]
    text_column = pa.LargeStringArray.from_buffers(len(new_offsets) - 1, pa.py_buffer(new_offsets.astype(np.int64).tobytes()), pa.py_buffer(data[keep].tobytes()))
    return pa.table([batch.ids, pa.array(n_words), pa.array(n_words - n_kept), text_column.cast(pa.string())], names=schema.names)


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept_text, the kept words joined by one space."""
    source = docs.select(whole_id(docs, id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_bytes = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-n_bytes // BUCKET_BYTES))
    batches = max(1, -(-n_bytes // BATCH_BYTES))
    dealt = source.withColumn("batch", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(batches)))

    def send_anchors(table):
        return _send_anchors(table, buckets)

    def send_windows(docs, answers):
        return _send_windows(docs, answers, buckets)

    def remove(docs, answers):
        return _remove(docs, answers, buckets, pa.int64())

    first = dealt.groupBy("batch").applyInArrow(send_anchors, _SENT_SQL).groupBy("bucket").applyInArrow(_answer_anchors, _ANSWER_SQL)
    second = dealt.groupBy("batch").cogroup(first.groupBy("batch")).applyInArrow(send_windows, _SENT_SQL).groupBy("bucket").applyInArrow(_answer_windows, _ANSWER_SQL)
    answers = first.unionByName(second)
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(remove, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")
