"""Near-duplicate classes by BagMinHash, banding and exact verification.

Documents with the same multiset of shingles are one node.  Nodes that agree in
all rows of a band share a bucket.  In each bucket all nodes are compared with
its pivot, the node with the most bucket mates in all bands, which in a group of
edited copies is the text they come from; the weighted Jaccard similarity is
computed exactly.  Buckets in which this leaves several components are worked
through in blocks: nodes outside the pivot's component against all members of
other components.  Blocks meet as signatures; only where a pair may be similar
do the bags of its two nodes follow, and are compared exactly.  Candidates travel
as lists of a pair of blocks, and a list returns at most one link for a node and a
component, which is all that the classes depend on.  Classes are the connected
components.

With 32 bands of 6 rows a pair of similarity 0.8 shares a bucket with
probability 0.99994, and the signature test lets it pass with 0.99998.

Scale: the texts are read twice, and the second time only those of nodes with
bucket mates are shuffled on.  Buckets and pivots come from partial aggregates;
joins on keys that may be hot are :func:`~.store.join_counted`.  Every step is a
table in the shared folder.

Cases: a text with fewer than five words has one shingle, all its words; a text
without words, or null, is in a class of its own; repeated rows and equal texts
are in one class; a null identifier is larger than any other; of rows with one
identifier the least hash of the text is the smallest; rows that are alike in
identifier and text are kept or not together, and :func:`drop_near_duplicates`
leaves one of them; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .bagminhash import band_keys, shingles, signatures
from .components import connected_components
from .exact_dedup import one_row_each
from .store import join_counted, join_spread, session_conf, small_batches, written
from .text import parts, texts_of
from .vocab import release, tidy

BANDS, ROWS = 32, 6
THRESHOLD, SURE_BELOW = 0.8, 0.68
BLOCK_NODES, LIST_WEIGHT = 256, 1 << 19
RUN_TEXTS = 4096


def _multisets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts with their shingles: first text, end, text number within the run, shingle, count."""
    for a, b, part in parts(texts_of(column)):
        for c in range(0, len(part), RUN_TEXTS):
            d = min(len(part), c + RUN_TEXTS)
            yield a + c, a + d, *shingles(part.part(c, d))


def _nodes(n: int, text: np.ndarray, shingle: np.ndarray, count: np.ndarray) -> list[bytes | None]:
    """A 16-byte digest of each multiset, null if empty."""
    cuts = np.searchsorted(text, np.arange(n + 1))
    both = np.stack([shingle, count.astype(np.uint64)], axis=1).astype("<u8")
    return [hashlib.blake2b(both[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for a, b, text, shingle, count in _multisets(batch.column(2)):
            n = b - a
            signature = signatures(n, text, shingle, count, BANDS * ROWS)
            bands = band_keys(signature, BANDS, ROWS).astype(np.int64)
            small = (signature & np.uint64(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, n),
                    batch.column(1).slice(a, n),
                    pa.array(_nodes(n, text, shingle, count), pa.binary()),
                    pa.array(np.bincount(text, count, n).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands.reshape(-1))),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * small.shape[1]).astype(np.int32).tobytes()), pa.py_buffer(small.tobytes())]),
                ],
                names=["doc_id", "version", "node", "weight", "bands", "signature"],
            )
    tidy()


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text its node and its shingles' low 32 bits in ascending order, each as often as it occurs."""
    release()
    for batch in batches:
        for a, b, text, shingle, count in _multisets(batch.column(0)):
            n = b - a
            low = np.repeat((text.astype(np.uint64) << np.uint64(32)) | (shingle & np.uint64(0xFFFFFFFF)), count)
            low.sort()
            cuts = np.searchsorted(low >> np.uint64(32), np.arange(n + 1).astype(np.uint64)).astype(np.int32) * 4
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_nodes(n, text, shingle, count), pa.binary()),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(low.astype("<u4").tobytes())]),
                ],
                names=["node", "bag"],
            )
    tidy()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted bags."""
    if not len(a) or not len(b):
        return 0.0
    # The k-th occurrence in a meets the k-th in b.
    both = np.sort(np.concatenate([_numbered(a), _numbered(b)]))
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(a) + len(b) - common)


def _numbered(bag: np.ndarray) -> np.ndarray:
    value = bag.astype(np.uint64) << np.uint64(32)
    new = np.ones(len(bag), bool)
    new[1:] = bag[1:] != bag[:-1]
    at = np.arange(len(bag))
    return value + (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)


def _may_link(a: int, b: int, threshold: float) -> bool:
    return min(a, b) >= threshold * max(a, b)


def _verify_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("bag_a"), batch.column("bag_b"), strict=True):
            a, b = (np.frombuffer(v.as_buffer(), "<u4") for v in (x, y))
            keep.append(_may_link(len(a), len(b), THRESHOLD) and similarity(a, b) >= THRESHOLD)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class _Block:
    def __init__(self, members: list[dict]):
        self.nodes = [m["node"] for m in members]
        self.component = np.array([m["component"] for m in members], object)
        self.bands = np.array([m["bands"] for m in members], np.int64)
        self.signature = np.frombuffer(b"".join(m["signature"] for m in members), np.uint8).reshape(len(members), -1)
        self.weight = np.array([m["weight"] for m in members])


_LISTS = pa.schema([("list", pa.string()), ("nodes", pa.list_(pa.binary())), ("components", pa.list_(pa.binary())), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])


def _lists(name: str, pairs: Iterator[tuple[tuple, tuple]]) -> Iterator[tuple]:
    """Pairs of (node, component, weight) as rows of _LISTS whose nodes weigh about LIST_WEIGHT at most."""
    number, index, a, b, weight = 0, {}, [], [], 0
    for x, y in pairs:
        if weight > LIST_WEIGHT:
            yield f"{name}-{number}", [n for n, _ in index], [c for _, c in index], a, b
            number, index, a, b, weight = number + 1, {}, [], [], 0
        for side, (node, component, own) in ((a, x), (b, y)):
            if (node, component) not in index:
                index[node, component] = len(index)
                weight += own
            side.append(index[node, component])
    if a:
        yield f"{name}-{number}", [n for n, _ in index], [c for _, c in index], a, b


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks that may be similar, by their signatures, in lists."""
    for batch in batches:
        rows = []
        for row in range(batch.num_rows):
            queries, members = (_Block(batch.column(c)[row].as_py()) for c in ("queries", "members"))
            band, name = batch.column("band")[row].as_py(), batch.column("name")[row].as_py()

            def pairs(queries=queries, members=members, band=band):
                for q, node in enumerate(queries.nodes):
                    own = queries.weight[q]
                    may = (members.component != queries.component[q]) & (np.minimum(members.weight, own) >= THRESHOLD * np.maximum(members.weight, own))
                    # A pair that shares several buckets is looked at in the first.
                    may &= np.argmax(members.bands == queries.bands[q], axis=1) == band
                    agree = (members.signature == queries.signature[q]).mean(axis=1)
                    at = np.flatnonzero(may & (agree >= SURE_BELOW + (1 - SURE_BELOW) / 256))
                    for k in at[np.argsort(-agree[at], kind="stable")]:
                        yield (node, queries.component[q], own), (members.nodes[k], members.component[k], members.weight[k])

            rows += _lists(name, pairs())
        columns = zip(*rows, strict=True) if rows else [[] for _ in _LISTS]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LISTS, strict=True)], schema=_LISTS)


def _verify_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            bags = {m["node"]: np.frombuffer(m["bag"], "<u4") for m in row["bags"]}
            nodes, components, done = row["nodes"], row["components"], set()
            for x, y in zip(row["a"], row["b"], strict=True):
                if (x, components[y]) not in done and similarity(bags[nodes[x]], bags[nodes[y]]) >= THRESHOLD:
                    done.add((x, components[y]))
                    out.append((nodes[x], nodes[y]))
        a, b = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _written_in_small_batches(df: DataFrame, name: str, rows: int) -> DataFrame:
    with session_conf(df.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}):
        return written(df, name)


def _missed_links(mates: DataFrame, pivots: DataFrame, components: DataFrame, nodes: DataFrame, bags: DataFrame) -> DataFrame:
    """Links (a, b) between different components that the stars around the pivots leave within a bucket."""
    placed = mates.join(components, "node", "left").select("node", "key", F.coalesce("component", "node").alias("component"))
    pivot_of = pivots.join(components.withColumnRenamed("node", "pivot"), "pivot", "left").select("key", F.coalesce("component", "pivot").alias("pivot_component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
    mixed = written(mixed.join(pivot_of, "key").select("key", "n", "pivot_component"), "near-mixed")
    blocks = F.ceil(F.col("n") / BLOCK_NODES)
    dealt = written(
        join_counted(placed, mixed, "key", "n")
        .join(nodes.select("node", "weight", "bands", "signature"), "node")
        .withColumn("band", F.array_position("bands", F.col("key")).cast("int") - 1)
        .withColumn("n_blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("node", "key"), blocks)),
        "near-dealt",
    )
    member = F.collect_list(F.struct("node", "component", "weight", "bands", "signature"))
    members = dealt.groupBy("key", "band", "block").agg(member.alias("members"))
    queries = dealt.filter("component <> pivot_component").groupBy("key", "block", "n_blocks").agg(member.alias("queries"))
    # Each block of queries goes to every block of members, so a hot bucket spreads by these.
    sent = queries.select("key", F.col("block").alias("from_block"), "queries", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    compared = sent.join(members, ["key", "block"]).select("band", F.concat_ws("-", "key", "from_block", "block").alias("name"), "queries", "members")
    lists = _written_in_small_batches(compared.mapInArrow(_candidates, "list string, nodes array<binary>, components array<binary>, a array<int>, b array<int>"), "near-candidates", 16)
    wanted = lists.select("list", F.explode(F.array_distinct("nodes")).alias("node"))
    wanted = join_spread(wanted, bags, "node")
    found = wanted.groupBy("list").agg(F.collect_list(F.struct("node", "bag")).alias("bags"))
    return _written_in_small_batches(lists.join(found, "list").mapInArrow(_verify_lists, "a binary, b binary"), "near-more-links", 16)


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), class_size, kept (it is that document), version (hash of the text)."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), _version(text_col).alias("version"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    signed = written(source.mapInArrow(_sign, f"doc_id {id_type}, version bigint, node binary, weight bigint, bands array<bigint>, signature binary"), "near-signed")
    nodes = written(
        signed.filter("node is not null")
        .groupBy("node")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "version")).alias("first"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("weight", "bands", "signature"))),
        "near-nodes",
    )

    keys = nodes.select("node", F.explode("bands").alias("key"))
    buckets = written(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "near-buckets")
    mates = written(join_counted(keys, buckets, "key", "n"), "near-mates")
    popular = mates.groupBy("node").agg(F.sum(F.col("n") - 1).alias("popularity"))
    pivots = written(mates.join(popular, "node").groupBy("key").agg(F.max_by("node", F.struct("popularity", "node")).alias("pivot"), F.count("*").alias("n")), "near-pivots")
    stars = join_counted(mates.select("node", "key"), pivots, "key", "n").filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()

    wanted = nodes.join(popular, "node", "left_semi").select(F.col("first.doc_id").alias("id"), F.col("first.version").alias("v")).alias("w")
    texts = source.alias("s").join(wanted, F.col("s.doc_id").eqNullSafe(F.col("w.id")) & (F.col("s.version") == F.col("w.v")), "left_semi").select("text")
    found = texts.mapInArrow(_bags, "node binary, bag binary")
    bags = written(found.filter("node is not null").groupBy("node").agg(F.first("bag").alias("bag")), "near-bags")

    # A node has a star in each of its bands at most; a pivot may be that of a third of all nodes.
    starred = written(stars, "near-stars").join(bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a")
    paired = join_spread(starred, bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b")
    links = _written_in_small_batches(paired.mapInArrow(_verify_pairs, "a binary, b binary"), "near-links", 256)
    components = connected_components(links)
    more = _missed_links(mates.select("node", "key"), pivots, components, nodes, bags)
    if not more.isEmpty():
        components = connected_components(components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    placed = nodes.select("node", "first", "copies").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = placed.groupBy("component").agg(F.min("first").alias("first"), F.sum("copies").alias("class_size"), F.count("*").alias("n"))
    of_node = join_counted(placed.select("node", "copies", "component"), written(classes, "near-classes"), "component", "n")
    of_node = written(of_node.select("node", "copies", F.col("first.doc_id").alias("class_id"), F.col("first.version").alias("class_version"), "class_size"), "near-node-classes")
    rows = signed.select("doc_id", "version", "node")
    classed = join_counted(rows.filter("node is not null"), of_node, "node", "copies").select("doc_id", "version", "class_id", "class_version", "class_size")
    alone = rows.filter("node is null").select("doc_id", "version", F.col("doc_id").alias("class_id"), F.col("version").alias("class_version"), F.lit(1).cast("long").alias("class_size"))
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("version") == F.col("class_version"))
    return classed.unionByName(alone).select("doc_id", "class_id", "class_size", kept.alias("kept"), "version")


def _version(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class; all columns stay."""
    kept = near_duplicate_classes(docs, id_col, text_col).filter("kept").select("doc_id", "version")
    return one_row_each(docs, kept, id_col, _version(text_col))
