"""Candle types and market-structure patterns, a verdict for every bar.

A pivot that needs bars to its right is only seen once these exist: its frame
ends that many bars before the current one, so no verdict looks ahead.  Frames
also express lookback and age limits, and ``last(..., ignorenulls)`` finds the
latest match, so no pattern needs a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barloom.operators.rolling import awesome, clip, floor, true
from barloom.sources.bars import by_bar, roll

# Candle types in the order of their rules.
CANDLES = (
    "doji", "marubozu", "bullish_engulf", "bearish_engulf", "bullish_harami", "bearish_harami", "inside", "outside",
    "hammer", "shooting_star", "long_lower", "long_upper", "big_bull", "big_bear", "neutral",
)


def frame(oldest: int, newest: int) -> W:
    """Bars from ``oldest`` to ``newest`` bars before the current one."""
    return by_bar().rowsBetween(-oldest, -newest)


def latest(value: Column, condition: Column, oldest: int, newest: int) -> Column:
    return F.last(F.when(condition, value), ignorenulls=True).over(frame(oldest, newest))


def gathered(value: Column, condition: Column, oldest: int, newest: int) -> Column:
    return F.collect_list(F.when(condition, value)).over(frame(oldest, newest))


def candle_type(bars: DataFrame, name: str = "candle") -> DataFrame:
    """Ordered rules over a bar and the one before; null for a ticker's first bar."""
    w = by_bar()
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    po, ph, pl, pc = (F.lag(x).over(w) for x in ("open", "high", "low", "close"))
    marked = bars.withColumns({"_po": po, "_ph": ph, "_pl": pl, "_pc": pc, "_body": F.abs(c - o), "_range": floor(h - l)})
    marked = marked.withColumns({"_up": h - F.greatest(o, c), "_down": F.least(o, c) - l, "_prev": F.abs(F.col("_pc") - F.col("_po"))})
    body, rng, up, down, prev = (F.col(x) for x in ("_body", "_range", "_up", "_down", "_prev"))
    po, ph, pl, pc = (F.col(x) for x in ("_po", "_ph", "_pl", "_pc"))
    small, large = (prev > 0) & (body < prev * 0.8), body > prev * 1.1
    rule = (
        F.when(pc.isNull(), None)
        .when(body / rng < 0.05, "doji")
        .when((body / rng > 0.9) & (up / rng < 0.05) & (down / rng < 0.05), "marubozu")
        .when(large & (c > o) & (o < pc) & (c > po), "bullish_engulf")
        .when(large & (o > c) & (o > pc) & (c < po), "bearish_engulf")
        .when(small & (c > o) & (o > po) & (c < pc), "bullish_harami")
        .when(small & (o > c) & (po > o) & (pc > c), "bearish_harami")
        .when((h < ph) & (l > pl), "inside")
        .when((h > ph) & (l < pl), "outside")
        .when((down > 2 * body) & (up < body), "hammer")
        .when((up > 2 * body) & (down < body), "shooting_star")
        .when(down > 2 * body, "long_lower")
        .when(up > 2 * body, "long_upper")
        .when((body > 3 * prev) & (c > o), "big_bull")
        .when((body > 3 * prev) & (o > c), "big_bear")
        .otherwise("neutral")
    )
    return marked.withColumn(name, rule).drop("_po", "_ph", "_pl", "_pc", "_body", "_range", "_up", "_down", "_prev")


def candle_odds(bars: DataFrame, lookback: int = 1000, min_samples: int = 15) -> DataFrame:
    """Per ticker and candle type: share of rises, mean next return and count over the last bars; all types appear."""
    w = by_bar()
    n = F.count(F.lit(1)).over(W.partitionBy("ticker"))
    typed = candle_type(bars).withColumn("n", n).withColumn("next_ret", (F.lead("close").over(w) - F.col("close")) / floor(F.col("close")))
    start = F.greatest(F.lit(2), F.col("n") - lookback) + 1
    used = typed.filter((F.col("n") >= 10) & (F.col("bar_ix") >= start) & (F.col("bar_ix") <= F.col("n") - 2))
    found = used.groupBy("ticker", "candle").agg(F.count("*").alias("count"), F.avg((F.col("next_ret") > 0).cast("double")).alias("p"), F.avg("next_ret").alias("r"))
    every = bars.select("ticker").distinct().withColumn("candle", F.explode(F.array(*[F.lit(t) for t in CANDLES])))
    enough = F.coalesce(F.col("count") >= min_samples, F.lit(False))
    return every.join(found, ["ticker", "candle"], "left").select(
        "ticker",
        "candle",
        F.when(enough, F.col("p")).otherwise(F.lit(0.5)).alias("p_up"),
        F.when(enough, F.col("r")).otherwise(F.lit(0.0)).alias("avg_ret"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def candle_signal(bars: DataFrame, odds: DataFrame, min_edge: float = 0.05) -> DataFrame:
    """Signal of each bar's type by its odds."""
    typed = candle_type(bars).withColumn("candle", F.coalesce("candle", F.lit("neutral")))
    edge = F.when(F.col("bar_ix") == 0, F.lit(0.0)).otherwise(F.col("p_up") - 0.5)
    signal = F.when(edge > min_edge, "bullish").when(edge < -min_edge, "bearish").otherwise("none")
    return typed.join(odds, ["ticker", "candle"]).withColumn("candle_signal", signal)


def swings(bars: DataFrame, n_bars: int = 3) -> DataFrame:
    """Flags of bars whose low (high) is the least (greatest) of the centred window; ties count."""
    half = n_bars // 2
    w = by_bar().rowsBetween(-half, half)
    full = F.count(F.lit(1)).over(w) == 2 * half + 1
    return bars.withColumn("swing_low", full & (F.col("low") == F.min("low").over(w))).withColumn("swing_high", full & (F.col("high") == F.max("high").over(w)))


def recent_swings(bars: DataFrame, n_bars: int = 3, max_age: int = 48, prefix: str = "") -> DataFrame:
    """The latest swing low and high: structs ``low_swing`` and ``high_swing`` of (ix, level)."""
    half = n_bars // 2
    marked = swings(bars, n_bars)
    point = lambda c: F.struct(F.col("bar_ix").alias("ix"), F.col(c).alias("level"))
    return marked.withColumn(f"{prefix}low_swing", latest(point("low"), F.col("swing_low"), max_age, half)).withColumn(
        f"{prefix}high_swing", latest(point("high"), F.col("swing_high"), max_age, half)
    )


def order_block(bars: DataFrame, lookback: int = 48, move: float = 0.003, max_age: int = 24, name: str = "ob") -> DataFrame:
    """The latest candle with a body before a bar of a wide range: struct (signal, high, low, ix, volume); null if none."""
    w = by_bar()
    reach = (F.lead("high").over(w) - F.lead("low").over(w)) / floor(F.col("close"))
    side = F.when(F.col("close") < F.col("open"), "bullish").when(F.col("close") > F.col("open"), "bearish")
    block = F.struct(F.col("_side").alias("signal"), "high", "low", F.col("bar_ix").alias("ix"), "volume")
    marked = bars.withColumn("_side", F.when((F.col("bar_ix") >= 1) & (reach >= move), side))
    return marked.withColumn(name, latest(block, F.col("_side").isNotNull(), min(lookback - 1, max_age), 1)).drop("_side")


def fair_value_gap(bars: DataFrame, lookback: int = 48, max_age: int = 24, name: str = "fvg") -> DataFrame:
    """The latest gap between a bar's neighbours: struct (signal, high, low, ix); null if none."""
    return _gap_flags(bars).withColumn(name, latest(F.col("_gap"), F.col("_gap").isNotNull(), min(lookback - 1, max_age), 1)).drop("_gap", "_bull", "_bear")


def _gap_flags(bars: DataFrame) -> DataFrame:
    w = by_bar()
    last_low, last_high, next_low, next_high = F.lag("low").over(w), F.lag("high").over(w), F.lead("low").over(w), F.lead("high").over(w)
    on = F.col("bar_ix") >= 2
    zone = lambda signal, high, low: F.struct(F.lit(signal).alias("signal"), high.alias("high"), low.alias("low"), F.col("bar_ix").alias("ix"))
    bull, bear = on & (last_low > next_high), on & (last_high < next_low)
    return (
        bars.withColumn("_bull", F.when(bull, F.struct(next_high.alias("low"), last_low.alias("high"), F.col("bar_ix").alias("ix"))))
        .withColumn("_bear", F.when(bear, F.struct(last_high.alias("low"), next_low.alias("high"), F.col("bar_ix").alias("ix"))))
        .withColumn("_gap", F.when(bull, zone("bullish", last_low, next_high)).when(bear, zone("bearish", next_low, last_high)))
    )


def _confluence(zones: Column, close: Column, bar_ix: Column, least: int) -> Column:
    """Of the pairwise intersections that hold the close, the first with the most overlapping zones."""
    aged = F.array_sort(F.transform(zones, lambda z: F.struct(z["low"].alias("low"), z["high"].alias("high"), (bar_ix - z["ix"]).alias("age"))))
    pairs = F.flatten(
        F.transform(aged, lambda a, i: F.transform(F.slice(aged, i + 2, F.size(aged)), lambda b: F.struct(F.greatest(a["low"], b["low"]).alias("low"), F.least(a["high"], b["high"]).alias("high"))))
    )
    inside = F.filter(pairs, lambda p: (p["low"] < p["high"]) & (p["low"] <= close) & (close <= p["high"]))

    def weighed(p: Column) -> Column:
        over = F.filter(aged, lambda z: (z["low"] < p["high"]) & (z["high"] > p["low"]))
        return F.struct(F.size(over).alias("n"), p["low"].alias("low"), p["high"].alias("high"), F.array_min(F.transform(over, lambda z: z["age"])).alias("age"))

    start = F.lit(None).cast("struct<n:int,low:double,high:double,age:bigint>")
    better = lambda best, x: F.when((x["n"] >= least) & (x["n"] > F.coalesce(best["n"], F.lit(0))), x).otherwise(best)
    return F.aggregate(F.transform(inside, weighed), start, better)


def gap_confluence(bars: DataFrame, lookback: int = 48, least: int = 2, max_age: int = 48) -> DataFrame:
    """Overlapping gaps that hold the close: fvg_signal, fvg_count, fvg_low, fvg_high, fvg_age; rising ones first."""
    oldest = min(lookback - 1, max_age)
    marked = _gap_flags(bars)
    marked = marked.withColumn("_bulls", gathered(F.col("_bull"), F.col("_bull").isNotNull(), oldest, 1)).withColumn("_bears", gathered(F.col("_bear"), F.col("_bear").isNotNull(), oldest, 1))
    for side in ("_bulls", "_bears"):
        marked = marked.withColumn(side, _confluence(F.col(side), F.col("close"), F.col("bar_ix"), least))
    best = F.coalesce("_bulls", "_bears")
    signal = F.when(F.col("_bulls").isNotNull(), "bullish").when(F.col("_bears").isNotNull(), "bearish").otherwise("none")
    return marked.withColumns(
        {"fvg_signal": signal, "fvg_count": F.coalesce(best["n"], F.lit(0)), "fvg_low": best["low"], "fvg_high": best["high"], "fvg_age": best["age"]}
    ).drop("_gap", "_bull", "_bear", "_bulls", "_bears")


def _closes_since(ix: Column, max_age: int) -> Column:
    """Closes from bar ``ix`` to this one."""
    return F.slice(F.collect_list("close").over(frame(max_age, 0)), -(F.col("bar_ix") - ix + 1).cast("int"), (F.col("bar_ix") - ix + 1).cast("int"))


def liquidity_sweep(bars: DataFrame, n_bars: int = 3, max_age: int = 24) -> DataFrame:
    """A close beyond the latest swing since it formed, and back now: sweep_signal, sweep_level."""
    s = recent_swings(bars, n_bars, max_age)
    low, high, c = F.col("low_swing"), F.col("high_swing"), F.col("close")
    s = s.withColumn("_since_low", F.array_min(_closes_since(low["ix"], max_age))).withColumn("_since_high", F.array_max(_closes_since(high["ix"], max_age)))
    bull = true((F.col("_since_low") < low["level"]) & (c > low["level"]))
    bear = true((F.col("_since_high") > high["level"]) & (c < high["level"]))
    return s.withColumn("sweep_signal", F.when(bull, "bullish").when(bear, "bearish").otherwise("none")).withColumn(
        "sweep_level", F.when(bull, low["level"]).when(bear, high["level"])
    ).drop("_since_low", "_since_high")


def premium_discount(bars: DataFrame, lookback: int = 96) -> DataFrame:
    """Place of the close between the latest swing low and high: pd_zone, pd_pct, pd_age."""
    s = recent_swings(bars, 3, lookback)
    low, high = F.col("low_swing"), F.col("high_swing")
    width = high["level"] - low["level"]
    known = true(width > 0)
    pct = F.when(known, clip((F.col("close") - low["level"]) / F.when(known, width), 0.0, 1.0)).otherwise(F.lit(0.5))
    age = F.col("bar_ix") - F.least(low["ix"], high["ix"])
    return s.withColumn("pd_pct", pct).withColumn("pd_zone", F.when(known & (F.col("pd_pct") < 0.5), "discount").when(known & (F.col("pd_pct") > 0.5), "premium").otherwise("none")).withColumn(
        "pd_age", F.when(known, age).otherwise(F.lit(-1))
    )


def structure_shift(bars: DataFrame, max_age: int = 24, n_bars: int = 3) -> DataFrame:
    """Close beyond the latest swing: mss_signal, mss_level."""
    s = recent_swings(bars, n_bars, max_age)
    low, high, c = F.col("low_swing"), F.col("high_swing"), F.col("close")
    up, down = true(c > high["level"]), true(c < low["level"])
    return s.withColumn("mss_signal", F.when(up, "bullish").when(down, "bearish").otherwise("none")).withColumn("mss_level", F.when(up, high["level"]).when(down, low["level"]))


def breaker_block(bars: DataFrame, lookback: int = 48, move: float = 0.002, max_age: int = 24) -> DataFrame:
    """A broken order block, retested: breaker_signal, breaker_level, breaker_age."""
    b = order_block(bars, lookback, move, max_age)
    ob, c = F.col("ob"), F.col("close")
    b = b.withColumn("_since", _closes_since(ob["ix"], max_age))
    worst = F.when(ob["signal"] == "bullish", F.array_min("_since")).otherwise(F.array_max("_since"))
    edge = F.when(ob["signal"] == "bullish", ob["low"]).otherwise(ob["high"])
    broken = F.when(ob["signal"] == "bullish", worst < ob["low"]).otherwise(worst > ob["high"])
    age = F.col("bar_ix") - (ob["ix"] + F.array_position("_since", worst) - 1)
    hit = true(ob.isNotNull() & broken & (F.abs(c - edge) <= ob["high"] - ob["low"]) & (age <= 2 * max_age))
    return (
        b.withColumn("breaker_signal", F.when(hit, F.when(ob["signal"] == "bullish", "bearish").otherwise("bullish")).otherwise("none"))
        .withColumn("breaker_level", F.when(hit, edge))
        .withColumn("breaker_age", F.when(hit, age).otherwise(F.lit(-1)))
        .drop("_since")
    )


def volume_order_block(bars: DataFrame, lookback: int = 48, move: float = 0.002, max_age: int = 24, multiple: float = 1.5) -> DataFrame:
    """An order block whose candle had enough volume: struct ``vob``; null otherwise."""
    b = order_block(bars, lookback, move, max_age, "vob")
    mean = F.avg("volume").over(roll(lookback))
    weak = (mean > 0) & (F.col("vob")["volume"] < mean * multiple)
    return b.withColumn("vob", F.when(~weak, F.col("vob")))


def cluster_means(levels: Column, tolerance: float) -> Column:
    """Means of runs of at least two sorted levels whose relative gaps stay within ``tolerance``, ascending."""
    start = F.struct(
        F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.array().cast("array<double>").alias("out")
    )
    closed = lambda a: F.when(a["n"] >= 2, F.concat(a["out"], F.array(a["sum"] / a["n"]))).otherwise(a["out"])

    def step(a: Column, x: Column) -> Column:
        joins = true(F.abs(x - a["last"]) / floor(F.abs(a["last"])) <= tolerance)
        return F.struct(
            x.alias("last"),
            F.when(joins, a["sum"] + x).otherwise(x).alias("sum"),
            F.when(joins, a["n"] + 1).otherwise(F.lit(1)).alias("n"),
            F.when(joins, a["out"]).otherwise(closed(a)).alias("out"),
        )

    return F.aggregate(F.array_sort(levels), start, step, closed)


def _cluster_verdict(marked: DataFrame, highs: Column, lows: Column, tolerance: float, name: str) -> DataFrame:
    c = F.col("close")
    m = marked.withColumn("_highs", cluster_means(highs, tolerance)).withColumn("_lows", cluster_means(lows, tolerance))
    m = m.withColumn("_above", F.array_max(F.filter("_highs", lambda x: x < c))).withColumn("_below", F.array_max(F.filter("_lows", lambda x: x > c)))
    up, down = F.col("_above").isNotNull(), F.col("_below").isNotNull()
    return (
        m.withColumn(f"{name}_signal", F.when(up, "bullish").when(down, "bearish").otherwise("none"))
        .withColumn(f"{name}_level", F.when(up, F.col("_above")).when(down, F.col("_below")))
        .drop("_highs", "_lows", "_above", "_below")
    )


def equal_levels(bars: DataFrame, lookback: int = 96, n_bars: int = 3, tolerance: float = 0.001) -> DataFrame:
    """Close beyond a level that two or more swings share: eq_signal, eq_level."""
    half = n_bars // 2
    s = swings(bars, n_bars)
    s = s.withColumn("_h", gathered(F.col("high"), F.col("swing_high"), lookback - 1, half)).withColumn("_l", gathered(F.col("low"), F.col("swing_low"), lookback - 1, half))
    return _cluster_verdict(s, F.col("_h"), F.col("_l"), tolerance, "eq").drop("_h", "_l")


def fractals(bars: DataFrame) -> DataFrame:
    """Strict pivots of five bars: fractal_low, fractal_high."""
    w = by_bar()
    around = lambda c: [F.lag(c, 2).over(w), F.lag(c).over(w), F.lead(c).over(w), F.lead(c, 2).over(w)]
    low, high = F.lit(True), F.lit(True)
    for x in around("low"):
        low &= F.col("low") < x
    for x in around("high"):
        high &= F.col("high") > x
    return bars.withColumn("fractal_low", true(low)).withColumn("fractal_high", true(high))


def _point(level: str) -> Column:
    return F.struct(F.col("bar_ix").alias("ix"), F.col(level).alias("level"))


def fractal_signal(bars: DataFrame, max_age: int = 12) -> DataFrame:
    """The latest fractal, a high one first: fractal_signal, fractal_age, fractal_level."""
    f = fractals(bars)
    f = f.withColumn("_h", latest(_point("high"), F.col("fractal_high"), max_age, 2)).withColumn("_l", latest(_point("low"), F.col("fractal_low"), max_age, 2))
    best = F.coalesce("_h", "_l")
    signal = F.when(F.col("_h").isNotNull(), "bearish").when(F.col("_l").isNotNull(), "bullish").otherwise("none")
    return (
        f.withColumn("fractal_signal", signal)
        .withColumn("fractal_age", F.coalesce(F.col("bar_ix") - best["ix"], F.lit(-1)))
        .withColumn("fractal_level", F.coalesce(best["level"], F.lit(0.0)))
        .drop("_h", "_l")
    )


def fractal_breakout(bars: DataFrame, max_age: int = 12) -> DataFrame:
    """The latest fractal that the close is beyond, older ones included: breakout_signal, breakout_level, breakout_age."""
    f, c = fractals(bars), F.col("close")
    f = f.withColumn("_h", gathered(_point("high"), F.col("fractal_high"), max_age, 2)).withColumn("_l", gathered(_point("low"), F.col("fractal_low"), max_age, 2))
    f = f.withColumn("_up", F.try_element_at(F.filter("_h", lambda p: p["level"] < c), F.lit(-1))).withColumn("_dn", F.try_element_at(F.filter("_l", lambda p: p["level"] > c), F.lit(-1)))
    best = F.coalesce("_up", "_dn")
    signal = F.when(F.col("_up").isNotNull(), "bullish").when(F.col("_dn").isNotNull(), "bearish").otherwise("none")
    return (
        f.withColumn("breakout_signal", signal)
        .withColumn("breakout_level", F.coalesce(best["level"], F.lit(0.0)))
        .withColumn("breakout_age", F.coalesce(F.col("bar_ix") - best["ix"], F.lit(-1)))
        .drop("_h", "_l", "_up", "_dn")
    )


def fractal_clusters(bars: DataFrame, max_age: int = 24, tolerance: float = 0.002) -> DataFrame:
    """Close beyond a level that two or more fractals share: cluster_signal, cluster_level."""
    f = fractals(bars)
    f = f.withColumn("_h", gathered(F.col("high"), F.col("fractal_high"), max_age - 1, 2)).withColumn("_l", gathered(F.col("low"), F.col("fractal_low"), max_age - 1, 2))
    return _cluster_verdict(f, F.col("_h"), F.col("_l"), tolerance, "cluster").drop("_h", "_l")


def awesome_fractal(bars: DataFrame, max_age: int = 12) -> DataFrame:
    """A fractal whose direction the awesome oscillator shares: ao_fractal_signal."""
    f = awesome(fractal_signal(bars, max_age))
    agrees = ((F.col("fractal_signal") == "bullish") & (F.col("ao") > 0)) | ((F.col("fractal_signal") == "bearish") & (F.col("ao") < 0))
    return f.withColumn("ao_fractal_signal", F.when(agrees, F.col("fractal_signal")).otherwise("none"))


def pivots(bars: DataFrame, column: str, order: int = 2) -> DataFrame:
    """Strict peaks and valleys of a column with ``order`` known neighbours on each side."""
    w = by_bar()
    peak, valley = F.col(column).isNotNull(), F.col(column).isNotNull()
    for k in range(1, order + 1):
        for x in (F.lag(column, k).over(w), F.lead(column, k).over(w)):
            peak, valley = peak & (F.col(column) > x), valley & (F.col(column) < x)
    return bars.withColumn("is_peak", true(peak)).withColumn("is_valley", true(valley))


def divergence(bars: DataFrame, indicator: str, price: str = "close", lookback: int = 24, order: int = 2, name: str = "div") -> DataFrame:
    """Price and indicator disagree at the last two pivots within the last ``lookback`` bars."""
    p = pivots(bars, price, order)
    pair = F.struct(F.col(price).alias("p"), F.col(indicator).alias("i"))
    p = p.withColumn("_peaks", gathered(pair, F.col("is_peak"), lookback - 1 - order, order)).withColumn("_valleys", gathered(pair, F.col("is_valley"), lookback - 1 - order, order))
    at = lambda c, k: F.try_element_at(F.col(c), F.lit(k))
    long_enough = F.col("bar_ix") + 1 >= lookback
    bear = true(long_enough & (at("_peaks", -1)["p"] > at("_peaks", -2)["p"]) & (at("_peaks", -1)["i"] < at("_peaks", -2)["i"]))
    bull = true(long_enough & (at("_valleys", -1)["p"] < at("_valleys", -2)["p"]) & (at("_valleys", -1)["i"] > at("_valleys", -2)["i"]))
    return p.withColumn(name, F.when(bear, "bearish").when(bull, "bullish").otherwise("none")).drop("_peaks", "_valleys", "is_peak", "is_valley")


