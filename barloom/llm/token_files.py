"""Token ids in files of Simple-8b words.

File format (all numbers little-endian 64-bit):

    magic "BLMS8B01", n_docs, n_ids, n_blocks, n_words, n_escaped
    doc_id[n_docs], null flag[n_docs], n_tokens[n_docs]
    block_word[n_blocks + 1]     first word of each block of 256 ids
    word[n_words]                selector in the top 4 bits, ids from the low bits up
    escaped[n_escaped]           ids of 2**60 and more

Selector s of 1 to 14 packs ``COUNTS[s]`` ids of ``60 // COUNTS[s]`` bits.
Selector 0 is an escape: its low 60 bits index ``escaped``.  Blocks are
independent, so many are packed and unpacked at once: packing moves through all
blocks of a chunk in step, unpacking handles all words of one selector together.

Documents go to shards by ranges of their identifier and the first characters of
their text, in ascending order within a shard (null last; rows with one identifier
by text).  A shard that is larger than planned, such as that of many like rows, goes
to several files, so a task holds the packed ids of one file.  A file gets its name
only when it is complete, and the manifest lists the files of the tasks that Spark
committed, so lost or repeated tasks leave no trace in what is read.  Files are read
one to a task.

Cases: a null text counts as empty, so it is the end id alone; a null identifier is
larger than any other; repeated rows are written each on its own; a document of any
length; the identifier must be of a whole-number type; empty tables give no file and no
row; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .store import fresh_path, small_batches, written
from .text import parts, texts_of, whole_id
from .vocab import ByteVocabulary, loaded, tidy

# Ids per word by selector; selector 0 is the escape.
COUNTS = (1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BLOCK = 256
MAGIC = b"BLMS8B01"
SHARD_BYTES = 16 << 20
FILE_WORDS = 4 << 20
_CHUNK = 1024


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, 1 at least; 64 for those beyond 60 bits."""
    out = np.ones(len(values), np.uint8)
    for k in range(1, 60):
        more = values >= np.uint64(1 << k)
        if not more.any():
            return out
        out += more
    out[values >= np.uint64(1 << 60)] = 64
    return out


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, word offsets of the blocks, and escaped values of an array of unsigned numbers."""
    values = values.astype(np.uint64)
    n, n_blocks = len(values), -(-len(values) // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    bits = np.full((n_blocks, BLOCK + 60), 65, np.uint8)  # what lies beyond a block fits no selector
    filled = np.full(n_blocks * BLOCK, 65, np.uint8)
    filled[:n] = _bits(values)
    bits[:, :BLOCK] = filled.reshape(n_blocks, BLOCK)
    choice = np.zeros((n_blocks, BLOCK), np.uint8)  # the escape, if nothing fits
    widest, size = bits, 1
    for s in range(len(COUNTS) - 1, 0, -1):
        step = COUNTS[s] - size
        if step:
            wide = widest.shape[1] - step
            reach = widest if step <= size else _window_max(bits, COUNTS[s])
            widest = np.maximum(widest[:, :wide], reach[:, step : step + wide]) if step <= size else reach
            size = COUNTS[s]
        fits = widest[:, :BLOCK] <= 60 // size
        if not fits.any():
            if 60 // size < bits.min():
                break
            continue
        choice[fits] = s
    counts = np.array(COUNTS, np.int64)
    at, lane = np.zeros(n_blocks, np.int64), np.arange(n_blocks)
    length = np.minimum(BLOCK, n - lane * BLOCK)
    steps = []
    while len(lane):
        s = choice[lane, at]
        steps.append((lane, at, s))
        at = at + counts[s]
        more = at < length[lane]
        lane, at = lane[more], at[more]
    lane, at, chosen = (np.concatenate([x[k] for x in steps]) for k in range(3))
    where = lane * BLOCK + at
    order = np.argsort(where)
    where, chosen, lane = where[order], chosen[order], lane[order]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(1, len(COUNTS)):
        own = np.flatnonzero(chosen == s)
        if len(own):
            base, width = where[own], 60 // COUNTS[s]
            word = words[own]
            for k in range(COUNTS[s]):
                word |= values[base + k] << np.uint64(k * width)
            words[own] = word
    own = np.flatnonzero(chosen == 0)
    words[own] = np.arange(len(own), dtype=np.uint64)
    return words, np.searchsorted(lane, np.arange(n_blocks + 1)), values[where[own]]


def _window_max(bits: np.ndarray, size: int) -> np.ndarray:
    out, have = bits, 1
    while have < size:
        step = min(have, size - have)
        wide = out.shape[1] - step
        out, have = np.maximum(out[:, :wide], out[:, step : step + wide]), have + step
    return out


def unpack(words: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """The numbers of any run of whole words."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS, np.int64)[selector]
    begin = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in range(1, len(COUNTS)):
        own = np.flatnonzero(selector == s)
        if len(own):
            width = np.uint64(60 // COUNTS[s])
            mask = (np.uint64(1) << width) - np.uint64(1)
            word, at = words[own] & np.uint64((1 << 60) - 1), begin[own]
            for k in range(COUNTS[s]):
                out[at + k] = (word >> (np.uint64(k) * width)) & mask
    own = np.flatnonzero(selector == 0)
    out[begin[own]] = escaped[(words[own] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


class Packer:
    """Packs a stream of ids; blocks are filled across calls."""

    def __init__(self):
        self.rest = np.zeros(0, np.uint64)
        self.words, self.blocks, self.escaped = [], [np.zeros(1, np.int64)], []
        self.n_ids = self.n_words = self.n_escaped = 0

    def add(self, ids: np.ndarray, last: bool = False) -> None:
        self.n_ids += len(ids)
        ids = np.concatenate([self.rest, ids.astype(np.uint64)])
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        words, blocks, escaped = pack(ids[:whole])
        self.rest = ids[whole:]
        words[words >> np.uint64(60) == 0] += np.uint64(self.n_escaped)
        self.words.append(words)
        self.blocks.append(blocks[1:] + self.n_words)
        self.escaped.append(escaped)
        self.n_words += len(words)
        self.n_escaped += len(escaped)

    def write(self, stream, doc_ids: list[int | None], counts: np.ndarray) -> None:
        self.add(np.zeros(0, np.uint64), last=True)
        blocks = np.concatenate(self.blocks)
        stream.write(MAGIC)
        stream.write(np.array([len(doc_ids), self.n_ids, len(blocks) - 1, self.n_words, self.n_escaped], "<u8").tobytes())
        stream.write(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
        stream.write(np.array([d is None for d in doc_ids], "<u8").tobytes())
        stream.write(counts.astype("<u8").tobytes())
        stream.write(blocks.astype("<u8").tobytes())
        for piece in (*self.words, *self.escaped):
            stream.write(piece.astype("<u8").tobytes())


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = 0,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write all texts' ids, ``end_id`` after each, and return the manifest.

    Manifest: shard, part, path, n_docs, n_ids, first_id (ids in all files before).
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or fresh_path(spark, "token-files")
    source = docs.select(whole_id(docs, id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_bytes = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    by_id = F.col("doc_id").asc_nulls_last()
    ranged = source.repartitionByRange(max(1, -(-n_bytes // SHARD_BYTES)), by_id, F.substring("text", 1, 16)).sortWithinPartitions(by_id, "text")
    file_words = FILE_WORDS

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, part = TaskContext.get().partitionId(), 0
        [encoder], packer, doc_ids, counts = loaded((ByteVocabulary, vocabulary)), Packer(), [], []

        def saved() -> pa.RecordBatch:
            system, folder = _file_system(path)
            system.create_dir(folder, recursive=True)
            name = f"ids-{shard:08d}-{part:04d}-{uuid.uuid4().hex}.s8b"
            with system.open_output_stream(f"{folder}/.{name}") as stream:
                packer.write(stream, doc_ids, np.concatenate(counts))
            system.move(f"{folder}/.{name}", f"{folder}/{name}")
            return pa.RecordBatch.from_pydict({"shard": [shard], "part": [part], "path": [f"{path}/{name}"], "n_docs": [len(doc_ids)], "n_ids": [packer.n_ids]})

        for batch in batches:
            texts, column = texts_of(batch.column(1)), batch.column(1)
            for a, b, _ in parts(texts):
                ids, n = encoder.encode(column.slice(a, b - a).to_pylist())
                doc_ids += batch.column(0).slice(a, b - a).to_pylist()
                counts.append(n + 1)
                packer.add(np.insert(ids, np.cumsum(n), end_id))
                if packer.n_words > file_words:
                    yield saved()
                    part, packer, doc_ids, counts = part + 1, Packer(), [], []
        if doc_ids:
            yield saved()
        tidy()

    manifest = written(ranged.mapInArrow(write, "shard bigint, part bigint, path string, n_docs bigint, n_ids bigint"), "token-manifest")
    # Sums in two levels: within chunks of shards, and over the chunks.
    chunked = manifest.withColumn("chunk", F.expr(f"shard div {_CHUNK}"))
    sums = chunked.groupBy("chunk").agg(F.sum("n_ids").alias("in_chunk"))
    earlier = lambda n, *order, by=(): F.coalesce(F.sum(n).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = sums.select("chunk", earlier("in_chunk", "chunk").alias("base"))
    placed = chunked.join(bases, "chunk").withColumn("first_id", F.col("base") + earlier("n_ids", "shard", "part", by=("chunk",)))
    return placed.drop("chunk", "base")


class Reader:
    """One file: its documents, and ids by ranges of whole blocks."""

    def __init__(self, stream):
        if stream.read(8) != MAGIC:
            raise ValueError("not a token file")
        number = lambda n, kind="<u8": np.frombuffer(stream.read(8 * n), kind)
        n_docs, self.n_ids, self.n_blocks, self.n_words, n_escaped = (int(x) for x in number(5))
        ids, null = number(n_docs, "<i8"), number(n_docs).astype(bool)
        self.doc_ids = pa.array(ids, mask=null)
        self.counts = number(n_docs).astype(np.int64)
        self.blocks = number(self.n_blocks + 1).astype(np.int64)
        self.at = stream.tell()
        self.stream = stream
        stream.seek(self.at + 8 * self.n_words)
        self.escaped = number(n_escaped).astype(np.uint64)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids ``a`` to ``b``; only the blocks that hold them are read and unpacked."""
        first, last = a // BLOCK, -(-b // BLOCK)
        begin, end = self.blocks[first], self.blocks[last]
        self.stream.seek(self.at + 8 * int(begin))
        words = np.frombuffer(self.stream.read(8 * int(end - begin)), "<u8").astype(np.uint64)
        return unpack(words, self.escaped)[a - first * BLOCK : b - first * BLOCK]


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before), n_tokens, ids (little-endian 32-bit)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, name = _file_system(row["path"])
                with system.open_input_file(name) as stream:
                    file = Reader(stream)
                    ends = np.cumsum(file.counts)
                    starts = ends - file.counts
                    a = 0
                    while a < len(ends):
                        b = max(a + 1, int(np.searchsorted(ends, starts[a] + (1 << 20), "right")))
                        ids = file.ids(int(starts[a]), int(ends[b - 1])).astype("<u4")
                        offsets = np.append(starts[a:b], ends[b - 1]) - starts[a]
                        yield pa.RecordBatch.from_arrays(
                            [
                                file.doc_ids.slice(a, b - a),
                                pa.array(starts[a:b] + row["first_id"]),
                                pa.array(file.counts[a:b]),
                                pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((offsets * 4).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())]),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )
                        a = b

    files = manifest.select("shard", "part", "path", "first_id")
    return files.repartitionByRange(max(1, files.count()), "shard", "part").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
