"""What a forecast needs around its model: complete inputs, scaling and back, and the times it is for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barloom.sources.bars import CLOSE_MINUTE, OHLC, OPEN_MINUTE, by_bar, minute_of_day, roll

# What is added to a deviation before dividing by it, and the bound of scaled values.
EPSILON, CLIP = 1e-5, 5.0
FIELDS = (*OHLC, "volume", "amount")


def completed(bars: DataFrame, refuse: bool = True) -> DataFrame:
    """Bars with volume and amount: both 0 without a volume, else an absent amount is volume times the mean of the four prices.

    With ``refuse`` an unknown price, volume or amount is an error when it is reached.
    """
    if missing := [c for c in OHLC if c not in bars.columns]:
        raise ValueError(f"missing price columns: {missing}")
    if "volume" not in bars.columns:
        bars = bars.withColumn("volume", F.lit(0.0)).withColumn("amount", F.lit(0.0))
    elif "amount" not in bars.columns:
        bars = bars.withColumn("amount", F.col("volume") * sum((F.col(c) for c in OHLC[1:]), F.col(OHLC[0])) / len(OHLC))
    if not refuse:
        return bars
    known = lambda c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.raise_error(F.lit(f"unknown {c}")).cast("double")).otherwise(F.col(c).cast("double"))
    return bars.withColumns({c: known(c) for c in FIELDS})


def scaling(bars: DataFrame, lookback: int, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Bars with ``scale``, a map from field to struct(mean, std) of the last ``lookback`` bars, where there are so many."""
    w = roll(lookback)
    stats = F.create_map(*[x for c in fields for x in (F.lit(c), F.struct(F.avg(c).over(w).alias("mean"), F.stddev_pop(c).over(w).alias("std")))])
    n = F.count(F.lit(1)).over(w)
    return bars.withColumn("scale", stats).withColumn("__n", n).filter(F.col("__n") == lookback).drop("__n")


def scaled(value: Column, scale: Column) -> Column:
    z = (value - scale["mean"]) / (scale["std"] + EPSILON)
    return F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), z))


def unscaled(z: Column, scale: Column) -> Column:
    return z * (scale["std"] + EPSILON) + scale["mean"]


def frequency(bars: DataFrame, default: int = 10) -> DataFrame:
    """(ticker, minutes): the commonest gap between bars, the smallest of equals; ``default`` for a single bar."""
    gap = F.timestamp_diff("MINUTE", F.lag("ts").over(by_bar()), F.col("ts")).cast("int")
    gaps = bars.select("ticker", gap.alias("gap")).groupBy("ticker", "gap").agg(F.count("*").alias("n"))
    own = F.max_by("gap", F.when(F.col("gap") > 0, F.struct("n", (-F.col("gap")).alias("less"))))
    return gaps.groupBy("ticker").agg(F.coalesce(own, F.lit(default)).alias("minutes"))


def future_times(last: Column, minutes: Column, n: int, open_minute: int = OPEN_MINUTE, close_minute: int = CLOSE_MINUTE) -> Column:
    """The next ``n`` times after ``last``, ``minutes`` apart from the session's opening on, on weekdays and within the session."""
    per_day = (F.lit(close_minute - open_minute) / minutes).cast("int") + 1
    day, at = F.to_date(last), minute_of_day(last)
    weekday = F.weekday(day)
    due = F.when(at < open_minute, 0).otherwise(F.floor((at - open_minute) / minutes) + 1)
    open_day = (weekday < 5) & (due < per_day)
    # Counted in sessions: day 0 is the last bar's own, or the next weekday if nothing is left of it.
    first = F.when(open_day, day).otherwise(F.date_add(day, F.when(weekday == 4, 3).when(weekday == 5, 2).otherwise(1)))
    begin = F.when(open_day, due).otherwise(0)

    def slot(j: Column) -> Column:
        k = begin + j
        sessions = F.floor(k / per_day)
        from_monday = F.weekday(first) + sessions
        days = sessions + 2 * F.floor(from_monday / 5)
        return F.timestamp_add("MINUTE", (F.lit(open_minute) + (k % per_day) * minutes).cast("int"), F.date_add(first, days.cast("int")).cast("timestamp_ntz"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), slot)


def regular_times(last: Column, minutes: Column, n: int) -> Column:
    """The next ``n`` times without regard to sessions."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda j: F.timestamp_add("MINUTE", (j * minutes).cast("int"), last))


def future_bars(bars: DataFrame, n: int, default: int = 10) -> DataFrame:
    """``bars`` with ``future``: the times of the next ``n`` bars of each bar's ticker."""
    return bars.join(F.broadcast(frequency(bars, default)), "ticker").withColumn("future", future_times(F.col("ts"), F.col("minutes"), n))


def last_of_session(bars: DataFrame) -> DataFrame:
    """The last bar of each session."""
    w = W.partitionBy("ticker").orderBy("bar_ix")
    return bars.withColumn("__next", F.lead("session_id").over(w)).filter("__next is null or __next <> session_id").drop("__next")
