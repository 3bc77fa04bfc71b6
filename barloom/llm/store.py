"""Tables that cut lineage, in the folder that all executors share, and joins that no hot key can hold up."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

# A key with more than one in so many of all rows, and more than the least number, counts as hot.
HOT_KEYS, HOT_ROWS = 1000, 200
_PATHS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Only a session on one machine may go without it; it then gets a temporary
    folder.  On a cluster a missing setting is an error, because executors would
    write where nobody else can read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="barloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_dir(spark)}/barloom/{name}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    return path


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, computed once and safe from lost executors, and the table's path."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return stored(df, name)[0]


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if path in _PATHS:
        _PATHS.remove(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, what :func:`fresh_path` named within."""
    before = len(_PATHS)
    try:
        yield
    finally:
        for path in _PATHS[before:]:
            delete(spark, path)


def join_counted(rows: DataFrame, per_key: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of ``rows`` with a table of one row per key, in which ``n`` counts the rows of the key.

    Keys with more than a thousandth of all rows are a thousand at most, so those
    are broadcast, and the rows of no such key have to meet in one task.  The
    others are joined by key.
    """
    total = per_key.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = F.col(n) > max(HOT_ROWS, total // HOT_KEYS)
    few = F.broadcast(per_key.filter(hot))
    return rows.join(few, key).unionByName(rows.join(few, key, "left_anti").join(per_key.filter(~hot), key))


def join_spread(rows: DataFrame, per_key: DataFrame, key: str, rows_per_part: int = 2048) -> DataFrame:
    """Inner join of ``rows`` with a table of one wide row per key, such as texts: nothing wide is broadcast.

    A key with many rows has its wide row once for every ``rows_per_part`` of them, and
    its rows are dealt to those.
    """
    counts = written(rows.groupBy(key).agg(F.count("*").alias("__n")), "join-counts")
    parts = F.expr(f"(__n + {rows_per_part} - 1) div {rows_per_part}")
    own = [F.col(c) for c in rows.columns if c != key]
    dealt = join_counted(rows, counts, key, "__n").withColumn("__part", F.pmod(F.xxhash64(*own), parts) if own else F.lit(0).cast("long")).drop("__n")
    spread = per_key.join(counts, key).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__n")
    return dealt.join(spread, [key, "__part"]).drop("__part")


def small_batches(spark: SparkSession) -> None:
    """From now on this session hands texts to Python in batches of about 4 MB, of which both sides hold a few."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


@contextmanager
def session_conf(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings that hold while a step runs."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
