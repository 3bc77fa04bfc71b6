"""A training corpus from raw documents: rules, exact and near copies, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm.exact_dedup import drop_copies
from barloom.llm.fertility import keep_good
from barloom.llm.mixing import apply_mix, mix_sources
from barloom.llm.near_dedup import drop_near_duplicates
from barloom.llm.packing import pack_documents
from barloom.llm.queries import vocabulary
from barloom.llm.store import delete, fresh_path, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility rules keep."""
    return keep_good(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return apply_mix(docs, mix_sources(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    pieces = pack_documents(docs, vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

# Tokenising and near-duplicate classes are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        # A stage's own tables, and what it has read, go once its result is written.
        out = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):
            found = stage(spark, docs, sf_dir)
            found.write.parquet(out)
        docs, gone, before = spark.read.schema(found.schema).parquet(out), before, out
        if gone:
            delete(spark, gone)
    return docs
