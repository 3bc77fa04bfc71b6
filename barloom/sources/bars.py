"""Canonical bar tables: ticker, bar_ix, ts, session columns, OHLC, volume, amount."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

OPEN_MINUTE, CLOSE_MINUTE = 600, 1120  # 10:00 to 18:40, both included
OHLC = ("open", "high", "low", "close")


def by_bar() -> W:
    return W.partitionBy("ticker").orderBy("bar_ix")


def roll(n: int) -> W:
    """The last ``n`` bars, this one included."""
    return by_bar().rowsBetween(-(n - 1), 0)


def before() -> W:
    """All earlier bars."""
    return by_bar().rowsBetween(W.unboundedPreceding, -1)


def upto() -> W:
    return by_bar().rowsBetween(W.unboundedPreceding, W.currentRow)


def ticks_to_bars(ticks: DataFrame, minutes: int) -> DataFrame:
    """Bars of (ticker, ts, price, size) ticks; ``order`` breaks ties of ts.  One shuffle, partially aggregated."""
    place = F.struct("ts", "order") if "order" in ticks.columns else F.col("ts")
    return (
        ticks.groupBy("ticker", F.window("ts", f"{minutes} minutes").alias("w"))
        .agg(
            F.min_by("price", place).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", place).alias("close"),
            F.sum("size").alias("volume"),
            F.sum(F.col("price") * F.col("size")).alias("amount"),
        )
        .select("ticker", F.col("w.start").alias("ts"), *OHLC, "volume", "amount")
    )


def event_ticks(events: DataFrame, offset: float = 100.0) -> DataFrame:
    return events.select(F.col("event_type").alias("ticker"), "ts", (F.lit(offset) + F.col("value")).alias("price"), F.lit(1.0).alias("size"))


def daily_bars(lineitem: DataFrame) -> DataFrame:
    """Daily bars of unit prices by return flag; lines of one day in key order."""
    ticks = lineitem.select(
        F.col("l_returnflag").alias("ticker"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("order"),
    )
    return ticks_to_bars(ticks, 24 * 60)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def in_main_session(ts: Column) -> Column:
    return minute_of_day(ts).between(OPEN_MINUTE, CLOSE_MINUTE)


def in_main_session_seconds(ts: Column) -> Column:
    """The form that compares seconds too: 18:40:30 is out."""
    return (minute_of_day(ts) * 60 + F.second(ts)).between(OPEN_MINUTE * 60, CLOSE_MINUTE * 60)


def numbered(bars: DataFrame) -> DataFrame:
    """Add bar_ix, session_date, is_day_start and session_id (one shuffle by ticker, kept by later windows)."""
    by_ts = W.partitionBy("ticker").orderBy("ts")
    day = F.to_date("ts")
    starts = F.coalesce(day != F.lag(day).over(by_ts), F.lit(True))
    return (
        bars.withColumn("bar_ix", F.row_number().over(by_ts).cast("long") - 1)
        .withColumn("session_date", day)
        .withColumn("is_day_start", starts)
        .withColumn("session_id", F.sum(F.col("is_day_start").cast("long")).over(by_ts))
    )


def session_bars(events: DataFrame, minutes: int = 60, offset: float = 100.0) -> DataFrame:
    """Numbered main-session bars of an event feed."""
    bars = ticks_to_bars(event_ticks(events, offset), minutes)
    return numbered(bars.filter(in_main_session(F.col("ts"))))


def resample(bars: DataFrame, minutes: int = 5, true_ohlc: bool = False) -> DataFrame:
    """Coarser bars.  All four prices come from closes unless ``true_ohlc``."""
    high, low, first = ("high", "low", "open") if true_ohlc else ("close", "close", "close")
    return (
        bars.groupBy("ticker", F.window("ts", f"{minutes} minutes").alias("w"))
        .agg(
            F.min_by(first, "ts").alias("open"),
            F.max(high).alias("high"),
            F.min(low).alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
            F.sum("amount").alias("amount"),
        )
        .filter("close is not null")
        .select("ticker", F.col("w.start").alias("ts"), *OHLC, "volume", "amount")
    )


def with_amount(bars: DataFrame, lots: DataFrame) -> DataFrame:
    """amount = close * volume * lot; unknown tickers have lot 1."""
    return bars.join(lots.select("ticker", "lot"), "ticker", "left").withColumn("amount", F.col("close") * F.col("volume") * F.coalesce("lot", F.lit(1))).drop("lot")


def wide_to_long(wide: DataFrame, tickers: list[str], ts_col: str = "timestamp") -> DataFrame:
    """``{ticker}_{field}`` columns to one row per ticker and time; missing columns are an error."""
    fields = (*OHLC, "volume")
    if missing := [f"{t}_{f}" for t in tickers for f in fields if f"{t}_{f}" not in wide.columns]:
        raise ValueError(f"missing columns: {missing}")
    rows = F.array(*[F.struct(F.lit(t).alias("ticker"), *[F.col(f"{t}_{f}").alias(f) for f in fields]) for t in tickers])
    return wide.select(F.col(ts_col).alias("ts"), F.explode(rows).alias("r")).select("r.ticker", "ts", *[f"r.{f}" for f in fields])


def long_to_wide(bars: DataFrame, tickers: list[str]) -> DataFrame:
    """One row per time with ``{ticker}_{field}`` columns, for the listed tickers."""
    fields = (*OHLC, "volume")
    pivoted = bars.filter(F.col("ticker").isin(tickers)).groupBy(F.col("ts").alias("timestamp")).pivot("ticker", tickers).agg(*[F.first(f).alias(f) for f in fields])
    return pivoted


def common_times(bars: DataFrame) -> DataFrame:
    """Only the times that every ticker has."""
    n = bars.agg(F.count_distinct("ticker").alias("n_tickers"))
    times = bars.groupBy("ts").agg(F.count_distinct("ticker").alias("n_here")).join(F.broadcast(n), F.col("n_here") == F.col("n_tickers")).select("ts")
    return bars.join(times, "ts", "left_semi")


def month_chunks(start: str | Column, end: str | Column) -> Column:
    """Array of (begin, finish) dates that cut a range by calendar months."""
    a, b = ((x if isinstance(x, Column) else F.lit(x)).cast("date") for x in (start, end))
    months = F.sequence(F.trunc(a, "month"), F.trunc(b, "month"), F.expr("interval 1 month"))
    return F.transform(months, lambda m: F.struct(F.greatest(a, m).alias("begin"), F.least(b, F.last_day(m)).alias("finish")))


def expected_bars(begin: Column, finish: Column, per_day: int = 52) -> Column:
    """Bars that the weekdays of a range should have."""
    days = F.sequence(begin, finish, F.expr("interval 1 day"))
    return F.size(F.filter(days, lambda d: F.weekday(d) < 5)) * per_day


def manifest(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def quality_report(bars: DataFrame, min_bars: int = 500, step_minutes: int = 60) -> DataFrame:
    """Counts of broken rules per ticker."""
    by_ts = W.partitionBy("ticker").orderBy("ts")
    gap = (F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(by_ts).cast("timestamp"))) / 60
    same_day = F.to_date("ts") == F.to_date(F.lag("ts").over(by_ts))
    marked = bars.withColumn("gap", gap).withColumn("same_day", same_day)
    missing = F.lit(False)
    for c in (*OHLC, "volume"):
        missing |= F.col(c).isNull() | F.isnan(c)
    return marked.groupBy("ticker").agg(
        F.count_if(missing).alias("n_missing"),
        (F.count("*") < min_bars).alias("too_few"),
        F.count_if(F.col("gap") <= 0).alias("n_unordered"),
        F.count_if(F.col("same_day") & (F.col("gap") > step_minutes)).alias("n_gaps"),
        F.count_if(~in_main_session(F.col("ts"))).alias("n_off_session"),
        F.count_if(F.col("volume") <= 0).alias("n_no_volume"),
    )
