"""Recursive smoothing.

Where it resets by session, a session's values become one array in bar order, a
fold carries the state and appends each result, all in the JVM, and the array is
exploded again: arrays are a session long.  Over a whole history it is an ordered
scan, which holds a batch of rows at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.operators.expanding import ordered_scan
from barloom.operators.rolling import floor, true, true_range
from barloom.sources.bars import by_bar


def fold_bars(bars: DataFrame, keys: list[str], value: Column, fold, name: str, kept: list[str]) -> DataFrame:
    """Map each group's ordered values through ``fold`` (array to array of the same length)."""
    items = F.array_sort(F.collect_list(F.struct(F.col("bar_ix").alias("ix"), value.alias("value"), *[F.col(c) for c in kept])))
    grouped = bars.groupBy(*keys).agg(items.alias("items")).withColumn("found", fold(F.col("items.value")))
    each = F.explode(F.arrays_zip("items", "found")).alias("z")
    flat = grouped.select(*keys, each)
    return flat.select(*keys, F.col("z.items.ix").alias("bar_ix"), *[F.col(f"z.items.{c}").alias(c) for c in kept], F.col("z.found").alias(name))


def _scan(values: Column, seed_at: int, seed: Column, step) -> Column:
    """Nulls before ``seed_at``, the seed there, then ``step(last, value)``."""
    start = F.struct(seed.cast("double").alias("last"), F.array(seed.cast("double")).alias("out"))
    rest = F.slice(values, seed_at + 2, F.greatest(F.size(values) - seed_at - 1, F.lit(0)))

    def merge(acc, x):
        now = step(acc["last"], x)
        return F.struct(now.alias("last"), F.concat(acc["out"], F.array(now)).alias("out"))

    scanned = F.aggregate(rest, start, merge, lambda acc: acc["out"])
    head = F.array_repeat(F.lit(None).cast("double"), seed_at)
    return F.when(F.size(values) > seed_at, F.concat(head, scanned)).otherwise(F.array_repeat(F.lit(None).cast("double"), F.size(values)))


def ema_atr(bars: DataFrame, period: int = 14, lookback: int = 500) -> DataFrame:
    """EMA of true range seeded by the mean of ranges 1..period; rank among earlier values; three rises or falls."""
    alpha = 2.0 / (period + 1)

    def make():
        seen, total, last = 0, 0.0, None

        def step(rows: dict[str, list]) -> list[list]:
            nonlocal seen, total, last
            out = []
            for x in rows["tr"]:
                if 1 <= seen <= period:
                    total += x
                    last = total / period if seen == period else None
                elif seen:
                    last += alpha * (x - last)
                seen += 1
                out.append(last)
            return [out]

        return step

    found = ordered_scan(true_range(bars).select("ticker", "bar_ix", "close", "tr"), ["tr"], ["atr"], make).drop("tr")
    w = by_bar()
    earlier = F.collect_list("atr").over(w.rowsBetween(-(lookback - 1), -1))
    rank = F.when(F.size(earlier) >= 20, F.size(F.filter(earlier, lambda x: x < F.col("atr"))) / F.size(earlier)).otherwise(F.lit(0.5))
    lag = lambda n: F.lag("atr", n).over(w)
    steps = [(F.col("atr"), lag(1)), (lag(1), lag(2)), (lag(2), lag(3))]
    rising, falling = F.lit(True), F.lit(True)
    for a, b in steps:
        rising, falling = rising & (a > b), falling & (a < b)
    return (
        found.withColumn("atr_pct", rank)
        .withColumn("atr_rising", true(rising))
        .withColumn("atr_falling", true(falling))
        .withColumn("low_vol", F.col("atr_pct") < 0.3)
        .withColumn("high_vol", F.col("atr_pct") > 0.7)
    )


def wilder_rsi(bars: DataFrame, period: int = 14) -> DataFrame:
    """RSI with Wilder smoothing, reset at each session; null in a session's first ``period`` bars."""
    keys = ["ticker", "session_id"]

    def fold(close: Column) -> Column:
        changes = F.zip_with(F.slice(close, 2, F.greatest(F.size(close) - 1, F.lit(0))), F.slice(close, 1, F.greatest(F.size(close) - 1, F.lit(0))), lambda b, a: b - a)

        def side(sign: int) -> Column:
            moves = F.transform(changes, lambda d: F.greatest(sign * d, F.lit(0.0)))
            seed = F.aggregate(F.slice(moves, 1, period), F.lit(0.0), lambda a, x: a + x) / period
            return _scan(F.concat(F.array(F.lit(0.0)), moves), period, seed, lambda last, x: (last * (period - 1) + x) / period)

        return F.zip_with(side(1), side(-1), lambda gain, loss: 100.0 - 100.0 / (1.0 + gain / floor(loss)))

    return fold_bars(bars, keys, F.col("close"), fold, "rsi", ["close"])
