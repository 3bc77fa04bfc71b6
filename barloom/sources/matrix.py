"""Dense matrices of features: blocks of times by tickers by fields, as 32-bit floats, read by range.

A file set has, per split, blocks of consecutive common times.  A block's bytes are
little-endian floats in the order (time, ticker, field), tickers and fields in the
order that ``layout`` tells.  The blocks carry their first and last time, so a range
reads only the files and row groups that may hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from barloom.sources.bars import OHLC
from barloom.sources.connectors import decode_blob, encode_blob

FIELDS = (*OHLC, "volume")
BLOCK = 1024
_BLOCKS = "block long, first_ts timestamp_ntz, last_ts timestamp_ntz, times array<timestamp_ntz>, data binary, split string"


def split_of(ts: Column, splits: dict[str, tuple[str, str]]) -> Column:
    """The name of the half-open range [start, end) that a time is in, null outside all."""
    out = F.lit(None).cast("string")
    for name, (start, end) in reversed(splits.items()):
        out = F.when((ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz")), name).otherwise(out)
    return out


def _numbered_times(times: DataFrame) -> DataFrame:
    """(split, ts, number) in order; numbers come from days' counts, so only a row a day meets in one task per split."""
    day = F.to_date("ts")
    days = times.groupBy("split", day.alias("day")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("split").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(W.partitionBy("split", "day").orderBy("ts")) - 1
    return times.withColumn("day", day).join(days.select("split", "day", before.alias("before")), ["split", "day"]).select("split", "ts", (F.col("before") + within).alias("number"))


def save_matrix(bars: DataFrame, path: str, tickers: list[str], splits: dict[str, tuple[str, str]], fields: tuple[str, ...] = FIELDS, block: int = BLOCK) -> None:
    """Bars at the times of a split that all tickers with any bars have; a ticker without any is all zeros.

    Unknown values become NaN.
    """
    spark = bars.sparkSession
    known = bars.filter(F.col("ticker").isin(tickers)).dropDuplicates(["ticker", "ts"])
    own = known.withColumn("split", split_of(F.col("ts"), splits)).filter("split is not null")
    some = known.agg(F.count_distinct("ticker").alias("some"))
    common = own.groupBy("split", "ts").agg(F.count("*").alias("here")).join(F.broadcast(some), F.col("here") == F.col("some"))
    places = F.create_map(*[x for k, t in enumerate(tickers) for x in (F.lit(t), F.lit(k))])
    row = F.struct(F.element_at(places, F.col("ticker")).alias("place"), F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in fields]).alias("values"))
    at = own.join(_numbered_times(common.select("split", "ts")), ["split", "ts"]).groupBy("split", "ts", "number").agg(F.collect_list(row).alias("rows"))
    of = lambda k: F.coalesce(F.try_element_at(F.filter("rows", lambda r: r["place"] == k), F.lit(1))["values"], F.array_repeat(F.lit(0.0), len(fields)))
    line = at.select("split", F.expr(f"number div {block}").alias("block"), F.struct("number", "ts", F.flatten(F.array(*map(of, range(len(tickers))))).alias("values")).alias("line"))
    blocks = line.groupBy("split", "block").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    times = F.transform("lines", lambda x: x["ts"])
    out = blocks.select(
        "split", "block", F.element_at(times, 1).alias("first_ts"), F.element_at(times, -1).alias("last_ts"), times.alias("times"), encode_blob(F.transform("lines", lambda x: x["values"])).alias("data")
    )
    out.sortWithinPartitions("split", "block").write.mode("overwrite").partitionBy("split").parquet(f"{path}/blocks")
    layout = spark.createDataFrame([(list(tickers), list(fields), block)], "tickers array<string>, fields array<string>, block int")
    layout.coalesce(1).write.mode("overwrite").json(f"{path}/layout")


def layout(spark: SparkSession, path: str) -> tuple[list[str], list[str], int]:
    """Tickers and fields in the order of the columns, and the times of a whole block."""
    r = spark.read.schema("tickers array<string>, fields array<string>, block int").json(f"{path}/layout").first()
    return list(r.tickers), list(r.fields), r.block


def load_matrix(spark: SparkSession, path: str, split: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """(split, ts, values) of the times in [start, end), ``values`` being a row of the matrix: fields within tickers."""
    tickers, fields, _ = layout(spark, path)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    if split is not None:
        blocks = blocks.filter(F.col("split") == split)
    time = lambda t: F.lit(t).cast("timestamp_ntz")
    if start is not None:
        blocks = blocks.filter(F.col("last_ts") >= time(start))
    if end is not None:
        blocks = blocks.filter(F.col("first_ts") < time(end))
    rows = blocks.select("split", F.explode(F.arrays_zip("times", decode_blob(F.col("data"), len(tickers) * len(fields)).alias("values"))).alias("x")).select("split", F.col("x.times").alias("ts"), F.col("x.values").alias("values"))
    if start is not None:
        rows = rows.filter(F.col("ts") >= time(start))
    return rows if end is None else rows.filter(F.col("ts") < time(end))


def matrix_to_long(spark: SparkSession, matrix: DataFrame, path: str) -> DataFrame:
    """(split, ts, ticker, fields) of rows of the matrix at ``path``."""
    tickers, fields, _ = layout(spark, path)
    rows = [F.struct(F.lit(t).alias("ticker"), *[F.element_at("values", k * len(fields) + j + 1).alias(f) for j, f in enumerate(fields)]) for k, t in enumerate(tickers)]
    return matrix.select("split", "ts", F.explode(F.array(*rows)).alias("r")).select("split", "ts", "r.*")


def save_wide(bars: DataFrame, path: str, tickers: list[str], zone: str | None = None) -> None:
    """A Parquet table of ``timestamp`` and 32-bit ``{ticker}_{field}`` columns, in the order of time; null where a ticker has no bar.

    With a ``zone``, times are taken as UTC and put down as that zone's local times.
    """
    from barloom.sources.bars import long_to_wide

    if zone is not None:
        bars = bars.withColumn("ts", F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("ts").cast("timestamp_ntz")))
    wide = long_to_wide(bars, tickers)
    columns = [F.col(f"`{t}_{f}`").cast("float").alias(f"{t}_{f}") for t in tickers for f in FIELDS]
    wide.select("timestamp", *columns).repartitionByRange("timestamp").sortWithinPartitions("timestamp").write.mode("overwrite").parquet(path)
