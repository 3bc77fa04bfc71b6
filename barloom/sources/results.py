"""Sinks and scans of samples, beliefs, metrics and arrays."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.sources.connectors import decode_blob, encode_blob


def save_samples(samples: DataFrame, path: str, temperature: float = 1.0, top_p: float = 1.0) -> None:
    """Windows (ticker, w, pred_ts, month, entry_close, paths, actual) by month, paths and actual bars as blobs of 32-bit floats."""
    out = samples.select(
        "ticker", F.col("w").alias("window_id"), "pred_ts", "month", F.col("entry_close").cast("float").alias("prev_close"), encode_blob(F.col("paths")).alias("samples_blob"),
        encode_blob(F.col("actual")).alias("actual_blob"), F.lit(temperature).cast("float").alias("config_T"), F.lit(top_p).cast("float").alias("config_top_p"),
    )
    out.write.mode("overwrite").partitionBy("month").parquet(path)


def load_samples(spark: SparkSession, path: str, pred_len: int) -> DataFrame:
    """Saved windows with ``paths`` (one array a sample) and ``actual`` (four prices a step)."""
    d = spark.read.parquet(path)
    return d.withColumn("paths", decode_blob(F.col("samples_blob"), pred_len)).withColumn("actual", decode_blob(F.col("actual_blob"), 4)).drop("samples_blob", "actual_blob")


def save_beliefs(beliefs: DataFrame, path: str, **meta: object) -> None:
    """Beliefs of (ticker, bar_ix, s, h) as 32-bit floats, one nested row a window, with a JSON of what they are."""
    channels = ("confidence", "entropy_s1", "top3_mass", "entropy_ratio")
    step = F.struct("s", "h", F.array(*[F.col(c).cast("float") for c in channels]).alias("values"))
    nested = beliefs.groupBy("ticker", "bar_ix").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    nested.write.mode("overwrite").parquet(f"{path}/beliefs")
    about = beliefs.sparkSession.createDataFrame([(list(channels), {k: str(v) for k, v in meta.items()})], "channels array<string>, meta map<string,string>")
    about.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_beliefs(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, bar_ix, s, h) with a column for each channel that the JSON names."""
    channels = spark.read.json(f"{path}/meta").first().channels
    steps = spark.read.parquet(f"{path}/beliefs").select("ticker", "bar_ix", F.explode("steps").alias("x"))
    return steps.select("ticker", "bar_ix", "x.s", "x.h", *[F.col("x.values")[k].cast("double").alias(c) for k, c in enumerate(channels)])


def save_monthly_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").parquet(path)


def save_summary(summary: DataFrame, path: str) -> None:
    """A few rows as JSON lines in one file."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def save_csv(table: DataFrame, path: str, digits: dict[str, int]) -> None:
    """A report as one CSV with a header, numbers rounded; unknown values are blank."""
    rounded = table.withColumns({c: F.round(c, d) for c, d in digits.items()})
    rounded.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def save_arrays(table: DataFrame, folder: str, order: str, columns: list[str], key: str = "ticker") -> DataFrame:
    """One ``{key}.npy`` of 64-bit floats for each key, rows by ``order``; (key, n_rows) of what was written."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        name, body = str(rows[key].iloc[0]), io.BytesIO()
        np.save(body, rows.sort_values(order)[columns].to_numpy(float))
        system, place = fs.FileSystem.from_uri(folder)
        system.create_dir(place, recursive=True)
        with system.open_output_stream(f"{place}/{name}.npy") as stream:
            stream.write(body.getvalue())
        return pd.DataFrame({key: [name], "n_rows": [len(rows)]})

    return table.select(key, order, *columns).groupBy(key).applyInPandas(write, f"{key} string, n_rows bigint")


def load_arrays(spark: SparkSession, folder: str, columns: list[str], key: str = "ticker") -> DataFrame:
    """Rows of all ``*.npy`` files of a folder, with the file's name as key and the row's number as ``ix``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, body in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                values = np.load(io.BytesIO(body.as_py()), allow_pickle=False)
                name = path.rpartition("/")[2].removesuffix(".npy")
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(values)), pa.array(np.arange(len(values))), *(pa.array(values[:, k]) for k in range(len(columns)))], names=[key, "ix", *columns])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder).select("path", "content")
    return files.mapInArrow(read, f"{key} string, ix bigint, " + ", ".join(f"{c} double" for c in columns))


def without_arrays(wanted: DataFrame, loaded: DataFrame, key: str = "ticker") -> DataFrame:
    """The wanted keys that no file has."""
    return wanted.join(loaded.select(key).distinct(), key, "left_anti")
