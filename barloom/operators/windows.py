"""Forecast windows: context, horizon, entry prices and realised returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barloom.config import Horizon
from barloom.operators.rolling import floor
from barloom.sources.bars import by_bar


def month_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def quarter_of(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))


def sliding_windows(bars: DataFrame, horizon: Horizon) -> DataFrame:
    """Every window of stride 1, at the bar before its horizon (``pos``); other columns of the bar stay.

    Adds w, pos, pred_ts, month, quarter, entry_close, entry_open, actual_ret and
    the horizon as an array of (open, high, low, close).
    """
    w, pl = by_bar(), horizon.pred_len
    ahead = w.rowsBetween(1, pl)
    n = F.count(F.lit(1)).over(W.partitionBy("ticker"))
    marked = (
        bars.withColumn("n_bars", n)
        .withColumn("pos", F.col("bar_ix"))
        .withColumn("w", F.col("bar_ix") - horizon.lookback + 1)
        .withColumn("pred_ts", F.lead("ts").over(w))
        .withColumn("entry_close", F.col("close"))
        .withColumn("entry_open", F.lead("open").over(w))
        .withColumn("horizon", F.collect_list(F.struct("open", "high", "low", "close")).over(ahead))
        .withColumn("actual_ret", (F.lead("close", pl).over(w) - F.col("close")) / floor(F.col("close"), 1e-8))
    )
    kept = marked.filter((F.col("w") >= 0) & (F.col("pos") <= F.col("n_bars") - pl - 1))
    return kept.withColumn("month", month_of(F.col("pred_ts"))).withColumn("quarter", quarter_of(F.col("pred_ts")))


def stepped_windows(bars: DataFrame, lookback: int, pred_len: int, step: int, start: str, end: str) -> DataFrame:
    """Windows ``step`` bars apart whose first forecast time lies within [start, end]; none where only one fits."""
    n = F.count(F.lit(1)).over(W.partitionBy("ticker"))
    marked = bars.withColumn("n_bars", n).withColumn("first_ix", F.col("bar_ix")).withColumn("pred_ts", F.col("ts"))
    last = F.col("n_bars") - lookback - pred_len
    fits = (last > 0) & (F.col("first_ix") >= lookback) & ((F.col("first_ix") - lookback) % step == 0) & (F.col("first_ix") - lookback <= last)
    inside = F.col("pred_ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    return marked.filter(fits & inside).withColumn("month", month_of(F.col("pred_ts"))).select("ticker", "first_ix", "pred_ts", "month")


