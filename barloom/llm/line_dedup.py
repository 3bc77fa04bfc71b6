"""Removal of repeated lines by overlapping three-line windows.

Lines are what ``\\n`` parts; only lines with a word count, and a window is three
of them in a row.  Of equal windows the first in order of (doc_id, line) stays;
every later one is removed, and a line goes if any removed window covers it.
Windows are judged on the input.

Windows travel as 16-byte hashes with their place; per hash only the first place
comes back (a partial aggregate, so a window that a third of all documents hold
sends one row per task).  The texts are shuffled once, to meet their removed
windows.

Cases: a null text counts as empty; blank lines are kept; texts of under three
lines lose nothing; rows that share identifier and line with the first place keep
it; a null identifier is larger than any other; empty tables give empty results;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import small_batches

WINDOW = 3
_HAS_WORD = r"[^\x20\x09-\x0D]"


def _has_word(line: str) -> bool:
    return bool(line.strip("\x20\x09\x0a\x0b\x0c\x0d"))


def kept_text(text: str, windows: list[int]) -> tuple[int, int, str]:
    """Counted lines, removed lines, and the text without the lines that the windows cover."""
    gone = {k + j for k in windows for j in range(WINDOW)}
    out, at = [], 0
    for line in text.split("\n"):
        counts = _has_word(line)
        if not (counts and at in gone):
            out.append(line)
        at += counts
    return at, len(gone), "\n".join(out)


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines (those with a word), n_removed, kept_text."""
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))
    lines = source.select("doc_id", "version", F.filter(F.split("text", "\n"), lambda line: line.rlike(_HAS_WORD)).alias("lines"))
    joined = F.transform(
        F.sequence(F.lit(1), F.size("lines") - (WINDOW - 1)),
        lambda k: F.unhex(F.md5(F.concat_ws("\n", *[F.element_at("lines", k + j) for j in range(WINDOW)]).cast("binary"))),
    )
    windows = lines.filter(F.size("lines") >= WINDOW).select("doc_id", "version", F.posexplode(joined).alias("k", "h"))
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), F.col("k").alias("k"))
    firsts = windows.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = windows.join(firsts, "h").filter(~place.eqNullSafe(F.col("first")))
    removed = later.groupBy("doc_id", "version").agg(F.collect_set("k").alias("windows")).withColumnsRenamed({"doc_id": "r_id", "version": "r_version"})
    met = source.join(removed, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("version") == F.col("r_version")), "left").select("doc_id", "text", "windows")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kept_text(t, w or []) for t, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            n, gone, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.string())], names=["doc_id", "n_lines", "n_removed", "kept_text"]
            )

    return met.mapInArrow(rebuild, f"doc_id {id_type}, n_lines bigint, n_removed bigint, kept_text string")
