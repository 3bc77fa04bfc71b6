"""Candles and recursive indicators over streams of ticks (an extension: the batch operators have no streaming form)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def streaming_bars(ticks: DataFrame, minutes: int, lateness: str = "1 hour") -> DataFrame:
    """Bars of a tick stream (ticker, ts, price, size); a bar is final once the watermark has passed it."""
    timed = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return (
        timed.groupBy("ticker", F.window("ts", f"{minutes} minutes").alias("w"))
        .agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume"), F.sum(F.col("price") * F.col("size")).alias("amount"))
        .select("ticker", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "amount")
    )


def streaming_ema(bars: DataFrame, period: int = 14) -> DataFrame:
    """EMA of closes per ticker, carried from batch to batch in keyed state."""
    alpha = 2.0 / (period + 1)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for close in rows["close"]:
            last = close if last is None else last + alpha * (close - last)
            out.append(last)
        state.update((last,))
        yield pd.DataFrame({"ticker": key[0], "ts": rows["ts"].to_numpy(), "ema": out})

    return bars.groupBy("ticker").applyInPandasWithState(update, "ticker string, ts timestamp, ema double", "last double", "append", "NoTimeout")
