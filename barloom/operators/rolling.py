"""Indicators over trailing, expanding and session windows, a column for every bar.

All windows partition by ticker and order by bar_ix, so one shuffle (usually that
of ``numbered``) serves all of them, and equal specifications share a Window node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barloom.operators.expanding import Expanding, expanding_quantiles
from barloom.sources.bars import by_bar, roll, upto

TINY = 1e-10


def session(unbounded: bool = True) -> W:
    w = W.partitionBy("ticker", "session_id").orderBy("bar_ix")
    return w.rowsBetween(W.unboundedPreceding, W.currentRow) if unbounded else w


def floor(x: Column, least: float = TINY) -> Column:
    return F.greatest(x, F.lit(least))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def true(condition: Column) -> Column:
    """The condition, or false where it is unknown."""
    return F.coalesce(condition, F.lit(False))


def bollinger(bars: DataFrame, period: int = 20, k: float = 2.0) -> DataFrame:
    """Full-window bands: sma, upper, lower, width; null while the window is short."""
    w = roll(period)
    full = F.count("close").over(w) == period
    sma, std = F.when(full, F.avg("close").over(w)), F.when(full, F.stddev_samp("close").over(w))
    return (
        bars.withColumn("sma", sma)
        .withColumn("bb_std", std)
        .withColumn("upper", F.col("sma") + k * F.col("bb_std"))
        .withColumn("lower", F.col("sma") - k * F.col("bb_std"))
        .withColumn("width", (F.col("upper") - F.col("lower")) / (F.col("sma") + 1e-8))
    )


def bollinger_partial(bars: DataFrame, period: int = 20, k: float = 2.0) -> DataFrame:
    """Bands that start with one bar: bb_mid, bb_std, bb_upper, bb_lower, bb_width, bb_pct, touches."""
    w = roll(period)
    return (
        bars.withColumn("bb_mid", F.avg("close").over(w))
        .withColumn("bb_std", F.coalesce(F.stddev_samp("close").over(w), F.lit(0.0)))
        .withColumn("bb_upper", F.col("bb_mid") + k * F.col("bb_std"))
        .withColumn("bb_lower", F.col("bb_mid") - k * F.col("bb_std"))
        .withColumn("bb_width", (F.col("bb_upper") - F.col("bb_lower")) / floor(F.col("bb_mid")))
        .withColumn("bb_pct", (F.col("close") - F.col("bb_lower")) / floor(F.col("bb_upper") - F.col("bb_lower")))
        .withColumn("touch_lower", F.col("close") <= F.col("bb_lower") + 0.5 * F.col("bb_std"))
        .withColumn("touch_upper", F.col("close") >= F.col("bb_upper") - 0.5 * F.col("bb_std"))
    )


def band_zone(close: Column, upper: Column, lower: Column) -> tuple[Column, Column]:
    """Zone of a price in its bands, and its clipped place between them."""
    known = true(upper > lower)
    pct = clip((close - lower) / F.when(known, upper - lower), 0.0, 1.0)
    zone = (
        F.when(~known, "unknown")
        .when(close > upper, "above_upper")
        .when(close < lower, "below_lower")
        .when(pct >= 0.75, "near_upper")
        .when(pct <= 0.25, "near_lower")
        .otherwise("middle")
    )
    return zone, F.when(known, pct).otherwise(F.lit(0.5))


def squeeze(bars: DataFrame, width: str = "width", lookback: int = 20, percentile: float = 20.0) -> DataFrame:
    """squeeze_pct: share of the last widths below the current, in percent; is_squeeze."""
    w = roll(lookback)
    last = F.filter(F.collect_list(width).over(w), lambda x: x.isNotNull())
    enough = (F.count(F.lit(1)).over(w) == lookback) & (F.size(last) >= lookback // 2) & F.col(width).isNotNull()
    pct = F.size(F.filter(last, lambda x: x < F.col(width))) / F.size(last) * 100.0
    return bars.withColumn("squeeze_pct", F.when(enough, pct).otherwise(F.lit(50.0))).withColumn("is_squeeze", enough & (F.col("squeeze_pct") < percentile))


def linear_channel(bars: DataFrame, period: int = 20, k: float = 2.0) -> DataFrame:
    """Rolling regression of close on position: lr_slope, lr_r2, lr_mid, lr_std, lr_pct."""
    w = roll(period)
    x = F.col("bar_ix").cast("double")
    n = F.count("close").over(w)
    slope = F.when(n > 1, F.regr_slope("close", x).over(w)).otherwise(F.lit(0.0))
    sxx, syy = F.regr_sxx("close", x).over(w), F.regr_syy("close", x).over(w)
    return (
        bars.withColumn("lr_slope", slope)
        .withColumn("lr_ssr", F.greatest(syy - F.col("lr_slope") ** 2 * sxx, F.lit(0.0)))
        .withColumn("lr_r2", 1.0 - F.col("lr_ssr") / floor(syy))
        .withColumn("lr_mid", F.avg("close").over(w) + F.col("lr_slope") * (x - F.avg(x).over(w)))
        .withColumn("lr_std", F.when(n > 2, F.sqrt(F.col("lr_ssr") / (n - 2))).otherwise(F.lit(0.0)))
        .withColumn("lr_pct", (F.col("close") - (F.col("lr_mid") - k * F.col("lr_std"))) / floor(2 * k * F.col("lr_std")))
    )


def true_range(bars: DataFrame) -> DataFrame:
    last = F.lag("close").over(by_bar())
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last))
    return bars.withColumn("tr", F.when(last.isNotNull(), tr).otherwise(F.lit(0.0)))


def atr_sma(bars: DataFrame, period: int = 14) -> DataFrame:
    """Mean true range of the last ``period`` bars; early bars use what there is after the first."""
    early = F.sum("tr").over(upto()) / F.col("bar_ix")
    atr = F.when(F.col("bar_ix") >= period, F.avg("tr").over(roll(period))).when(F.col("bar_ix") > 1, early).otherwise(F.lit(0.0))
    return true_range(bars).withColumn("atr_sma", atr)


def rsi_simple(bars: DataFrame, period: int = 14) -> DataFrame:
    """RSI of plain means of the last ``period`` changes: 50 while short, 100 without losses."""
    change = F.col("close") - F.lag("close").over(by_bar())
    marked = bars.withColumn("gain", F.greatest(change, F.lit(0.0))).withColumn("loss", F.greatest(-change, F.lit(0.0)))
    gain, loss = F.avg("gain").over(roll(period)), F.avg("loss").over(roll(period))
    rsi = F.when(F.col("bar_ix") < period, 50.0).when(loss == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + gain / F.when(loss > 0, loss)))
    return marked.withColumn("rsi14", rsi).drop("gain", "loss")


def obv(bars: DataFrame, slope_bars: int = 5) -> DataFrame:
    """On-balance volume from the first volume on, and the slope of its last values."""
    change = F.coalesce(F.signum(F.col("close") - F.lag("close").over(by_bar())), F.lit(1.0))
    marked = bars.withColumn("signed", change * F.col("volume")).withColumn("obv", F.sum("signed").over(upto())).drop("signed")
    slope = F.when(F.count("obv").over(roll(slope_bars)) == slope_bars, F.regr_slope("obv", F.col("bar_ix").cast("double")).over(roll(slope_bars)))
    return marked.withColumn("obv_slope", F.coalesce(slope, F.lit(0.0)))


def mfi(bars: DataFrame, period: int = 14) -> DataFrame:
    """Money flow index within a session; null in its first ``period`` bars.  Equal prices count as falling."""
    s = session(False)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    marked = bars.withColumn("typical", typical).withColumn("flow", typical * F.col("volume"))
    rises = F.col("typical") > F.lag("typical").over(s)
    last = s.rowsBetween(-(period - 1), 0)
    marked = marked.withColumn("rises", rises).withColumn("up", F.when(F.col("rises"), F.col("flow")).otherwise(F.lit(0.0)))
    marked = marked.withColumn("down", F.when(F.col("rises"), F.lit(0.0)).otherwise(F.col("flow")))
    ratio = F.sum("up").over(last) / floor(F.sum("down").over(last))
    at = F.row_number().over(s)
    return marked.withColumn("mfi", F.when(at > period, 100.0 - 100.0 / (1.0 + ratio))).drop("typical", "flow", "rises", "up", "down")


def awesome(bars: DataFrame) -> DataFrame:
    """Mean of the last 5 midpoints less that of the last 34; 0 while short."""
    mid = (F.col("high") + F.col("low")) / 2.0
    enough = F.count(mid).over(roll(34)) == 34
    return bars.withColumn("ao", F.when(enough, F.avg(mid).over(roll(5)) - F.avg(mid).over(roll(34))).otherwise(F.lit(0.0)))


def vwap(bars: DataFrame, k: float = 2.0) -> DataFrame:
    """Session-anchored VWAP with bands, place, distance and crossings."""
    w, s = session(), session(False)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    volume = floor(F.sum("volume").over(w))
    at = F.row_number().over(s)
    c, v = F.col("close"), F.col("vwap")
    lag = lambda x, n: F.lag(x, n).over(s)
    before_up = F.when(at >= 3, lag("close", 2) > lag("vwap", 2)).otherwise(at == 2)
    before_down = F.when(at >= 3, lag("close", 2) < lag("vwap", 2)).otherwise(at == 2)
    return (
        bars.withColumn("vwap", F.sum(typical * F.col("volume")).over(w) / volume)
        .withColumn("vwap_sigma", F.sqrt(F.greatest(F.sum(typical**2 * F.col("volume")).over(w) / volume - v**2, F.lit(0.0))))
        .withColumn("vwap_upper", v + k * F.col("vwap_sigma"))
        .withColumn("vwap_lower", v - k * F.col("vwap_sigma"))
        .withColumn("vwap_z", (c - v) / floor(F.col("vwap_sigma")))
        .withColumn("vwap_pct", clip((c - F.col("vwap_lower")) / floor(F.col("vwap_upper") - F.col("vwap_lower")), 0.0, 1.0))
        .withColumn("near_lower", (c <= F.col("vwap_lower")) | (c <= v - 0.8 * k * F.col("vwap_sigma")))
        .withColumn("near_upper", (c >= F.col("vwap_upper")) | (c >= v + 0.8 * k * F.col("vwap_sigma")))
        .withColumn("crossed_up", true((lag("close", 1) <= lag("vwap", 1)) & before_up & (c > v)))
        .withColumn("crossed_down", true((lag("close", 1) >= lag("vwap", 1)) & before_down & (c < v)))
    )


def anchored_vwap(bars: DataFrame, anchor_ix: int) -> DataFrame:
    """VWAP from one bar on; null before."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    on = F.col("bar_ix") >= anchor_ix
    value = F.sum(F.when(on, typical * F.col("volume"))).over(upto()) / floor(F.sum(F.when(on, F.col("volume"))).over(upto()))
    return bars.withColumn("anchored_vwap", F.when(on, value))


def rising_twice(bars: DataFrame, column: str, name: str) -> DataFrame:
    """The column rose over each of the last two bars."""
    x, one, two = F.col(column), F.lag(column).over(by_bar()), F.lag(column, 2).over(by_bar())
    return bars.withColumn(name, true((x > one) & (one > two)))


def adr(bars: DataFrame, period: int = 20, threshold: float = 0.3) -> DataFrame:
    """Average daily range of completed days against the range so far today.

    Days are first aggregated, so the trailing window runs over days, not bars.
    """
    days = bars.groupBy("ticker", "session_id").agg((F.max("high") - F.min("low")).alias("day_range"))
    past = W.partitionBy("ticker").orderBy("session_id").rowsBetween(-period, -1)
    days = days.select("ticker", "session_id", F.collect_list("day_range").over(past).alias("ranges"))
    w = session()
    now = F.max("high").over(w) - F.min("low").over(w)
    enough = F.size("ranges") >= 3
    mean = F.aggregate("ranges", F.lit(0.0), lambda a, x: a + x) / F.size("ranges")
    place = F.size(F.filter("ranges", lambda x: x < F.col("current_range"))) / F.size("ranges")
    return (
        bars.withColumn("now", now)
        .join(days, ["ticker", "session_id"])
        .withColumn("adr", F.when(enough, mean).otherwise(F.lit(0.0)))
        .withColumn("current_range", F.when(enough, F.col("now")).otherwise(F.lit(0.0)))
        .withColumn("range_ratio", F.when(enough, F.col("current_range") / floor(F.col("adr"))).otherwise(F.lit(1.0)))
        .withColumn("adr_percentile", F.when(enough, place))
        .withColumn("low_range", true(F.col("adr_percentile") < threshold))
        .withColumn("high_range", true(F.col("adr_percentile") > 1.0 - threshold))
        .withColumn("above_adr", enough & (F.col("current_range") > F.col("adr")))
        .drop("now", "ranges")
    )


def volatility_regime(low_range: Column, high_range: Column, low_vol: Column, high_vol: Column) -> Column:
    return F.when(low_range & low_vol, "compression").when(high_range & high_vol, "expansion").otherwise("neutral")


def window_zscore(bars: DataFrame, column: str, lookback: int, bound: float = 5.0) -> DataFrame:
    """Per bar the last ``lookback`` values, all scaled by that window's mean and deviation and clipped."""
    w = roll(lookback)
    mean, std = F.avg(column).over(w), F.stddev_pop(column).over(w)
    values = F.collect_list(column).over(w)
    marked = bars.withColumn("mu", mean).withColumn("sd", std).withColumn("raw", values)
    scaled = F.transform("raw", lambda x: clip((x - F.col("mu")) / (F.col("sd") + 1e-5), -bound, bound))
    return marked.withColumn("scaled", scaled).drop("raw")


def calendar(bars: DataFrame) -> DataFrame:
    ts = F.col("ts")
    return bars.select("*", F.minute(ts).alias("minute"), F.hour(ts).alias("hour"), F.weekday(ts).alias("weekday"), F.dayofmonth(ts).alias("day"), F.month(ts).alias("month"))


def expanding_quantiles(df: DataFrame, column: str, probabilities: list[float], name: str, ix: str = "w", include: bool = False) -> DataFrame:
    """Array of exact quantiles of all earlier values (or, with ``include``, this one too).

    A window of the built-in exact percentile: right for short histories, but
    quadratic in their length; :mod:`barloom.operators.expanding` has the fast form.
    """
    w = W.partitionBy("ticker").orderBy(ix).rowsBetween(W.unboundedPreceding, 0 if include else -1)
    return df.withColumn(name, F.percentile(column, F.array(*[F.lit(p) for p in probabilities])).over(w))


def expanding_median(df: DataFrame, column: str, name: str, ix: str = "w", warm_up: int = 10, default: float = 0.001) -> DataFrame:
    """Median of all earlier values; ``default`` for the first ``warm_up`` + 1 rows."""
    found = expanding_quantiles(df, [Expanding(column, 0.5, name)], ix=ix)
    return found.withColumn(name, F.when(F.col(ix) <= warm_up, F.lit(default)).otherwise(F.col(name)))


def close_rising(bars: DataFrame) -> DataFrame:
    """Whether a bar closes above the one before; false for the first."""
    return bars.withColumn("close_rising", true(F.col("close") > F.lag("close").over(by_bar())))


def equity(returns: Column, window: W) -> Column:
    """Compounded value of returns over a window."""
    return F.product(1.0 + returns).over(window)


