"""As-of and nearest joins by sorting, not by comparing all pairs.

Both sides are unioned and sorted by time within a key; the latest right row is
carried forward.  One shuffle by key, whatever the sides' sizes.  With a ``bucket``
(a unit of date_trunc) the sort is within a key's days or months, and each of those
starts from one row, the last right row before it; those are found among a row per
key and bucket.  So one long key spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def asof_join(
    left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, columns: list[str], strict: bool = True, forward: bool = False, bucket: str | None = None
) -> DataFrame:
    """``left`` with ``columns`` of the last right row before (or, with ``forward``, the first after) its time.

    Unless ``strict`` a right row at the same time counts.  A row without a time finds
    nothing and isn't found.  Names of ``columns`` must not be in ``left``.
    """
    carried = F.struct(F.col(right_ts).alias("asof_ts"), *columns)
    part = lambda ts: F.date_trunc(bucket, F.col(ts)) if bucket else F.lit(0)
    a = left.select(F.col(key).alias("_k"), F.col(left_ts).alias("_t"), part(left_ts).alias("_b"), F.lit(1).alias("_left"), F.struct(*left.columns).alias("_row"))
    b = right.filter(F.col(right_ts).isNotNull()).select(F.col(key).alias("_k"), F.col(right_ts).alias("_t"), part(right_ts).alias("_b"), F.lit(0).alias("_left"), carried.alias("_r"))
    both = a.unionByName(b, allowMissingColumns=True)
    way = lambda c: F.col(c).desc() if forward else F.col(c).asc()
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, W.currentRow)
    if bucket:
        edge = (F.min_by if forward else F.max_by)("_r", "_t")
        edges = b.groupBy("_k", "_b").agg(edge.alias("_r")).withColumn("_left", F.lit(0))
        asked = a.filter("_t is not null").select("_k", "_b").distinct().withColumn("_left", F.lit(1))
        # A bucket starts from the edge of one before it, so its own comes after.
        before = F.last("_r", ignorenulls=True).over(upto(W.partitionBy("_k").orderBy(way("_b"), F.col("_left").desc())))
        starts = edges.unionByName(asked, allowMissingColumns=True).withColumn("_r", before).filter("_left = 1 and _r is not null")
        both = both.unionByName(starts.select("_k", F.col("_r.asof_ts").alias("_t"), "_b", F.lit(0).alias("_left"), "_r"), allowMissingColumns=True)
    # In the order of the scan, a right row at an equal time comes after the left row if strict, before it otherwise.
    # Forward scans go backwards in time: a frame that starts at the first row is carried on, one that ends at the last isn't.
    tie = F.col("_left").desc() if strict else F.col("_left").asc()
    found = F.last("_r", ignorenulls=True).over(upto(W.partitionBy("_k", "_b").orderBy(way("_t"), tie)))
    return both.withColumn("_f", found).filter("_left = 1").withColumn("_f", F.when(F.col("_t").isNotNull(), F.col("_f"))).select("_row.*", "_f.*")


def nearest_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, columns: list[str], tolerance_seconds: int = 3600, bucket: str | None = None) -> DataFrame:
    """``left`` with ``columns`` of the right row nearest in time, within a tolerance; the earlier of two as near."""
    renamed = {c: f"_next_{c}" for c in columns}
    earlier = asof_join(left, right, key, left_ts, right_ts, columns, strict=False, bucket=bucket).withColumnRenamed("asof_ts", "_prev_ts")
    later = asof_join(earlier, right.withColumnsRenamed(renamed), key, left_ts, right_ts, list(renamed.values()), strict=False, forward=True, bucket=bucket).withColumnRenamed("asof_ts", "_next_ts")
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    back, ahead = seconds(left_ts) - seconds("_prev_ts"), seconds("_next_ts") - seconds(left_ts)
    use_prev = F.col("_prev_ts").isNotNull() & (back <= tolerance_seconds) & (F.col("_next_ts").isNull() | (back <= ahead))
    use_next = F.col("_next_ts").isNotNull() & (ahead <= tolerance_seconds)
    picked = [F.when(use_prev, F.col(c)).when(use_next, F.col(n)).alias(c) for c, n in renamed.items()]
    return later.select(*left.columns, *picked)


def asof_windows(left: DataFrame, bars: DataFrame, key: str, left_ts: str, size: int, columns: list[str], bucket: str | None = None) -> DataFrame:
    """``left`` with the last ``size`` bars strictly before its time as an array; a slice's first bar starts a day."""
    w = W.partitionBy(key).orderBy("ts").rowsBetween(-(size - 1), 0)
    listed = bars.withColumn("slice", F.collect_list(F.struct("ts", *columns)).over(w))
    joined = asof_join(left, listed, key, left_ts, "ts", ["slice"], bucket=bucket)
    first = lambda x, i: F.when(i == 0, True).otherwise(F.to_date(x["ts"]) != F.to_date(F.element_at(F.col("slice"), F.greatest(i, F.lit(1)))["ts"]))
    return joined.withColumn("day_starts", F.transform("slice", first))
