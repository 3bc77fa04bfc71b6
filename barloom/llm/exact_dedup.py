"""Exact deduplication as a stateful stream.

Digests (with identifiers) are streamed through a keyed aggregation whose state
lives in RocksDB on disk and never expires.  Per digest the state retains the
identifier of the row that stays (the largest), a content locator, which is the run
whose table of texts holds the text, and the number of rows.  The state itself, read
through Spark's state reader, is the result; a later run on the same state folder
continues with new documents.

A digest seen twice, in this run or since an earlier one, is a hit.  The full texts
of all hits, and only theirs, are compared byte by byte before the state learns of
them, those of earlier runs read through their locators: per digest the smallest
and the largest text must be equal.  Both are partial aggregates, so a group of any
size sends one text per task.  Digests under which texts differ are split: the text
that came first keeps the key, and the others try the key with a mark added, until
each text has a key of its own.  So a weak digest costs time, not correctness.

The texts that later runs compare with are kept where a state folder is named; a
run with a state of its own keeps none.

Equal means identical after lower-casing A-Z alone.  Only DataFrame functions
are used.

Cases: a null text counts as empty; a null identifier is smaller than any other;
repeated rows with one identifier count as rows of a group, and all those with
the kept identifier are kept; empty tables give empty results; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .store import exists, fresh_path, join_counted, session_conf, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Disk-backed state with a bound on the memory that all stores of an executor share.
_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "1",
    # A store is closed when its task ends, so executors hold none between batches.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    # Without this every store reserves disk for its logs, however small its state.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def update_state(run_paths: str, schema, state_path: str, spark: SparkSession, bytes_per_batch: int = 4 << 30) -> None:
    """Stream the tables (digest, doc_id, run) at ``run_paths``, a pattern, into the state at ``state_path``, as far as they aren't there yet."""
    with session_conf(spark, _STATE_CONF):
        stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(bytes_per_batch)).parquet(run_paths)
        state = stream.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.min("run").alias("locator"), F.count("*").alias("group_size"))
        query = (
            state.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", state_path)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def read_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The state as (digest, keep_id, locator, group_size)."""
    return spark.read.format("statestore").load(state_path).select(
        F.col("key.digest").alias("digest"), F.col("value.max").alias("keep_id"), F.col("value.min").alias("locator"), F.col("value.count").alias("group_size")
    )


def _split(clashing: DataFrame, known: DataFrame | None) -> DataFrame:
    """A key (digest, text_sha256, key) for each of the texts (digest, text_sha256, norm) that share digests."""
    pending = written(clashing.withColumn("key", F.col("digest")), "dedup-split")
    placed = None
    while not pending.isEmpty():
        first = pending.groupBy("key").agg(F.min("norm").alias("first"))
        if known is not None:
            first = first.join(known, first.key == known.digest, "left").select("key", F.coalesce(known.norm, "first").alias("first"))
        met = written(pending.join(first, "key").withColumn("same", F.col("norm") == F.col("first")).drop("first"), "dedup-split")
        own = met.filter("same").select("digest", "text_sha256", "key")
        placed = own if placed is None else placed.unionByName(own)
        pending = met.filter("not same").drop("same").withColumn("key", F.concat("key", F.lit("#")))
    return placed.distinct()


def _learned(rows: DataFrame, key: str, run: int) -> DataFrame:
    """What the state learns of a run."""
    return rows.select(F.col(key).alias("digest"), "doc_id", F.lit(run).cast("long").alias("run"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_hex,
    state_path: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    With a ``state_path``, a folder, documents of all runs on it count: those whose
    digests were saved, even if the run died later.  What a run left that died before
    is overwritten by the next.
    """
    spark = docs.sparkSession
    keeps_texts, folder = state_path is not None, state_path or fresh_path(spark, "dedup-state")
    state_path, runs, tables = f"{folder}/state", f"{folder}/runs", f"{folder}/texts"
    run = 0
    while exists(spark, f"{runs}/run-{run:08d}/_SUCCESS"):
        run += 1
    norm = normalised(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"), digest(norm).alias("digest"))
    rows = written(texts.select("doc_id", "digest", sha256_hex(F.col("norm")).alias("text_sha256")), "dedup-digests")

    per_digest = rows.groupBy("digest").agg(F.count("*").alias("n"))
    known = None
    if run:
        update_state(f"{runs}/run-*", _learned(rows, "digest", run).schema, state_path, spark)  # what a run saved that died before its state
        located = read_state(spark, state_path).select("digest", "locator")
        per_digest = per_digest.join(located, "digest", "left")
        held = spark.read.schema("digest string, norm string, run long").option("basePath", tables).parquet(tables)
        known = held.join(located, (held.digest == located.digest) & (held.run == located.locator), "left_semi").select("digest", "norm")
    else:
        per_digest = per_digest.withColumn("locator", F.lit(None).cast("long"))
    per_digest = written(per_digest.filter("n > 1 or locator is not null"), "dedup-hits")
    repeated = join_counted(rows, per_digest, "digest", "n").select("doc_id", "digest").distinct()
    t, r = texts.alias("t"), repeated.alias("r")
    hits = t.join(r, F.col("t.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("t.digest") == F.col("r.digest")), "left_semi")
    both = hits.select("digest", "norm")
    if known is not None:
        both = both.unionByName(known.join(per_digest, "digest", "left_semi"))
    compared = both.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
    differ = written(compared.filter("lo <> hi").select("digest"), "dedup-collisions")
    keyed = rows.withColumn("key", F.col("digest"))
    keys_of_texts = texts.withColumn("key", F.col("digest"))
    if not differ.isEmpty():
        clashing = texts.join(differ, "digest", "left_semi").select("digest", sha256_hex(F.col("norm")).alias("text_sha256"), "norm").distinct()
        split = written(_split(clashing, known), "dedup-keys")
        in_place = lambda df: df.join(split, ["digest", "text_sha256"], "left").withColumn("key", F.coalesce("key", "digest"))
        keyed = in_place(rows)
        keys_of_texts = in_place(texts.withColumn("text_sha256", sha256_hex(F.col("norm"))))

    learned = _learned(keyed, "key", run)
    if keeps_texts:
        new = keys_of_texts.groupBy(F.col("key").alias("digest")).agg(F.min("norm").alias("norm"))
        if run:
            new = new.join(located, "digest", "left_anti")
        new.write.mode("overwrite").parquet(f"{tables}/run={run}")
    learned.write.mode("overwrite").parquet(f"{runs}/run-{run:08d}")
    update_state(f"{runs}/run-*", learned.schema, state_path, spark)
    state = written(read_state(spark, state_path).select(F.col("digest").alias("key"), "keep_id", "group_size"), "dedup-groups")
    groups = join_counted(keyed, state, "key", "group_size")
    return groups.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def one_row_each(docs: DataFrame, kept: DataFrame, id_col: str, version: Column) -> DataFrame:
    """Of ``docs`` one row for each (doc_id, version) of ``kept``; all columns stay."""
    key = lambda i, v: F.concat(F.coalesce(F.concat(F.lit("="), i.cast("string")), F.lit("")), F.lit(" "), v.cast("string"))
    wanted = kept.select(key(F.col("doc_id"), F.col("version")).alias("__barloom_key")).distinct()
    keyed = docs.withColumn("__barloom_key", key(F.col(id_col), version))
    return keyed.join(wanted, "__barloom_key", "left_semi").dropDuplicates(["__barloom_key"]).select(*docs.columns)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each group of :func:`exact_dedup`; all columns stay.

    Of rows with the kept identifier and equal texts any one stays.
    """
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select("doc_id", F.col("text_sha256").alias("version"))
    return one_row_each(docs, kept, id_col, sha256_hex(normalised(F.col(text_col))))
