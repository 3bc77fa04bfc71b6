"""Sinks, caches, codecs and the strategy registry as tables."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException as SparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.sources.bars import manifest


def save_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by ticker with a JSON manifest beside; ``append`` adds to what is there."""
    bars.repartition("ticker").write.mode(mode).partitionBy("ticker").parquet(f"{path}/bars")
    everything = bars.sparkSession.read.parquet(f"{path}/bars")
    manifest(everything).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/bars")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(f"{path}/manifest")


def pending(wanted: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks that haven't landed yet."""
    return wanted.join(landed, keys, "left_anti")


def cache_key(*values: object) -> str:
    """A path-safe name for parameters."""
    return "_".join(re.sub(r"[^A-Za-z0-9.-]+", "-", str(v)) for v in values)


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table under ``key``; made and written if it isn't there or can't be read to its end.

    A key should name everything the table depends on; :func:`input_version` gives
    a name for the state of input files.
    """
    path = f"{folder}/{key}"
    try:
        found = spark.read.parquet(path)
        # Every row group of a column is read, so a file that was cut off shows here.
        found.agg(F.count(F.hash(*found.columns))).collect()
        return found
    except (AnalysisException, SparkException, Py4JJavaError):
        make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def input_version(spark: SparkSession, path: str) -> str:
    """A name that changes with the files at a path: their number, bytes and latest change."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    summary = files.getContentSummary(place)
    stamps = [files.getFileStatus(place).getModificationTime()]
    return f"{summary.getFileCount()}-{summary.getLength()}-{max(stamps)}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def first_per_key(first: DataFrame, otherwise: DataFrame, key: str = "ticker") -> DataFrame:
    """``first``, and rows of ``otherwise`` for keys of which ``first`` has none."""
    return first.unionByName(otherwise.join(first.select(key).distinct(), key, "left_anti"))


def first_non_empty(first: DataFrame, otherwise: Callable[[], DataFrame]) -> DataFrame:
    """``first`` unless it has no rows (one row is looked at)."""
    return otherwise() if first.isEmpty() else first


def normalise_times(df: DataFrame, candidates: tuple[str, ...] = ("begin", "timestamp", "ts"), source_zone: str = "UTC", zone: str = "Europe/Moscow") -> DataFrame:
    """Exchange-local ``ts`` without a zone, from the first candidate column there is."""
    name = next((c for c in candidates if c in df.columns), None)
    if name is None:
        raise ValueError(f"none of the time columns {candidates}")
    local = F.convert_timezone(F.lit(source_zone), F.lit(zone), F.col(name).cast("timestamp_ntz"))
    return df.withColumn("ts", local) if name == "ts" else df.withColumn("ts", local).drop(name)


def encode_blob(paths: Column) -> Column:
    """Nested doubles as little-endian 32-bit floats in row order, for readers of the blob layout."""

    @F.pandas_udf("binary")
    def encode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: np.array([x for p in v for x in p], "<f4").tobytes())

    return encode(paths)


def decode_blob(blob: Column, columns: int) -> Column:
    @F.pandas_udf("array<array<double>>")
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda b: np.frombuffer(b, "<f4").astype(float).reshape(-1, columns).tolist())

    return decode(blob)


def float_bytes(values: list[float]) -> bytes:
    return struct.pack(f"<{len(values)}f", *values)


METRICS = ("sharpe", "max_dd", "win_rate", "profit_factor", "total_return", "n_trades")
REGISTRY = "id string, name string, asset string, params map<string,string>, data_source string, code_path string, status string, metrics map<string,double>"


def _beside(path: str) -> tuple[str, str]:
    return f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    _, old = _beside(path)
    return spark.read.schema(REGISTRY).json(old if not exists(spark, path) and exists(spark, old) else path)


def save_registry(registry: DataFrame, path: str) -> None:
    """Written beside the old one, which may be what ``registry`` reads, and then put in its place.

    The old one is moved aside first and goes last, so that one of both is there at
    any time; :func:`load_registry` reads the one aside where a crash left no other.
    """
    spark, (new, old) = registry.sparkSession, _beside(path)
    registry.coalesce(1).write.mode("overwrite").json(new)
    jvm = spark._jvm.org.apache.hadoop.fs
    files = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(jvm.Path(path)):
        files.delete(jvm.Path(old), True)
        files.rename(jvm.Path(path), jvm.Path(old))
    files.rename(jvm.Path(new), jvm.Path(path))
    files.delete(jvm.Path(old), True)


def registry_from_csv(spark: SparkSession, path: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Rows of a metrics CSV; blanks and bad numbers become null and are left out."""
    raw = spark.read.option("header", True).csv(path)
    return registry_from_table(raw, metrics)


def registry_from_table(raw: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    pairs = [F.struct(F.lit(m).alias("key"), F.trim(F.col(m).cast("string")).try_cast("double").alias("value")) for m in metrics if m in raw.columns]
    kept = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))
    return raw.select(F.trim("strategy").alias("name"), kept.alias("metrics"))


def upsert(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Registry with new rows merged by name: old asset, params and so on win over nulls, metrics are replaced."""
    columns = [c for c in registry.columns if c != "name"]
    a, b = registry.alias("a"), new.alias("b")
    merged = []
    for c in columns:
        if c not in new.columns:
            merged.append(F.col(f"a.{c}").alias(c))
        elif c == "metrics":
            merged.append(F.coalesce(F.col("b.metrics"), F.col("a.metrics")).alias(c))
        else:
            merged.append(F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c))
    return a.join(b, F.col("a.name") == F.col("b.name"), "full").select(F.coalesce("a.name", "b.name").alias("name"), *merged)


def list_strategies(registry: DataFrame, asset: str | None = None, min_sharpe: float = -999, max_dd: float = 999, min_win_rate: float = -1) -> DataFrame:
    """Strategies within limits (missing metrics pass as 0), best Sharpe first."""
    metric = lambda name: F.coalesce(F.try_element_at("metrics", F.lit(name)), F.lit(0.0))
    kept = registry.filter((metric("sharpe") >= min_sharpe) & (F.abs(metric("max_dd")) <= max_dd) & (metric("win_rate") >= min_win_rate))
    if asset is not None:
        kept = kept.filter(F.col("asset") == asset)
    return kept.orderBy(metric("sharpe").desc(), "name")


def lookup_strategy(registry: DataFrame, name_or_id: str) -> DataFrame:
    """The row of that name, else of that id."""
    found = registry.filter((F.col("name") == name_or_id) | (F.col("id") == name_or_id))
    return found.orderBy((F.col("name") == name_or_id).desc()).limit(1)


def registry_stats(registry: DataFrame) -> DataFrame:
    """Count, least, greatest, mean and upper-median Sharpe per status."""
    s = F.try_element_at("metrics", F.lit("sharpe"))
    ordered = F.array_sort(F.collect_list(s))
    return registry.groupBy("status").agg(
        F.count("*").alias("n"), F.min(s).alias("least"), F.max(s).alias("most"), F.avg(s).alias("mean"), F.try_element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int")).alias("median")
    )
