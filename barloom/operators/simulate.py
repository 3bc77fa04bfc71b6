"""Path-dependent trade simulation, in expressions over the horizon array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barloom.config import Horizon
from barloom.operators.rolling import true


def levels(sig: Column, mode: Column, price: Column, high: Column, low: Column) -> tuple[Column, Column]:
    """Take-profit and stop levels of a signal; those on the wrong side of the price, or off in this mode, are null."""
    tp = F.when(sig == 1, F.when(high > price, high)).otherwise(F.when(low < price, low))
    sl = F.when(sig == 1, F.when(low < price, low)).otherwise(F.when(high > price, high))
    return F.when(mode != "no_tp", tp), F.when(mode != "no_sl", sl)


def first_hit(sig: Column, entry: Column, tp: Column, sl: Column, horizon: Column) -> Column:
    """struct(reason, price, step, ret, holding): the stop goes first within a bar; else the last close."""
    long = sig == 1
    hit_sl = F.transform(horizon, lambda b: true(F.when(long, b["low"] <= sl).otherwise(b["high"] >= sl)))
    hit_tp = F.transform(horizon, lambda b: true(F.when(long, b["high"] >= tp).otherwise(b["low"] <= tp)))
    at_sl, at_tp, never = F.array_position(hit_sl, True), F.array_position(hit_tp, True), F.size(horizon) + 1
    at_sl, at_tp = F.when(at_sl > 0, at_sl).otherwise(never), F.when(at_tp > 0, at_tp).otherwise(never)
    stopped, taken = (at_sl < never) & (at_sl <= at_tp), at_tp < at_sl
    price = F.when(stopped, sl).when(taken, tp).otherwise(F.element_at(horizon, -1)["close"])
    held = F.when(stopped, at_sl).when(taken, at_tp).otherwise(F.size(horizon)).cast("int")
    reason = F.when(stopped, "sl").when(taken, "tp").otherwise("close")
    return F.struct(reason.alias("reason"), price.alias("price"), F.try_divide(sig * (price - entry), entry).alias("ret"), held.alias("holding"))


def simulate(signals: DataFrame) -> DataFrame:
    """Trades of signals (strategy, sig, mode, entry_close, entry_open, g_tp, g_sl, horizon); narrow."""
    tp, sl = levels(F.col("sig"), F.col("mode"), F.col("entry_close"), F.col("g_tp"), F.col("g_sl"))
    traded = signals.filter("sig <> 0 and entry_open > 0").withColumn("tp", tp).withColumn("sl", sl)
    traded = traded.withColumn("x", first_hit(F.col("sig"), F.col("entry_open"), F.col("tp"), F.col("sl"), F.col("horizon")))
    return traded.select("ticker", "strategy", "w", "pos", "pred_ts", "sig", "entry_open", "tp", "sl", F.col("x.reason").alias("reason"), F.col("x.price").alias("exit_price"), F.col("x.ret").alias("ret"), F.col("x.holding").alias("holding"))


def held_returns(trades: DataFrame, commission: float = 0.0) -> DataFrame:
    """(strategy, ticker, bar_ix, ret) for bars on which a trade is held: its return spread evenly over them, the mean where trades overlap.

    Trades whose return is exactly 0 don't count.
    """
    spread = (
        trades.filter("ret <> 0")
        .withColumn("part", (F.col("ret") - commission) / F.col("holding"))
        .withColumn("bar_ix", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + F.col("holding"))))
    )
    return spread.groupBy("strategy", "ticker", "bar_ix").agg((F.sum("part") / F.count("*")).alias("ret"))


def per_bar(trades: DataFrame, bars: DataFrame, strategies: list[str], commission: float = 0.0) -> DataFrame:
    """(strategy, ticker, bar_ix, ts, ret): each trade's return spread evenly over the bars it is held, the mean where trades overlap, zero elsewhere.

    Trades whose return is exactly 0 don't count; a strategy without other trades
    of a ticker has no rows there.  The strategies' names are given, so that the
    bars to fill are known without simulating twice.  This makes a row for each bar and
    strategy; :func:`barloom.operators.reports.trade_metrics` needs none for idle bars.
    """
    held = held_returns(trades, commission)
    spine = bars.select(F.explode(F.array(*[F.lit(s) for s in strategies])).alias("strategy"), "ticker", "bar_ix", "ts")
    filled = spine.join(held, ["strategy", "ticker", "bar_ix"], "left")
    traded = F.max("ret").over(W.partitionBy("strategy", "ticker")).isNotNull()
    return filled.withColumn("traded", traded).filter("traded").drop("traded").withColumn("ret", F.coalesce("ret", F.lit(0.0)))


def with_equity(returns: DataFrame, keys: tuple[str, ...] = ("strategy", "ticker")) -> DataFrame:
    w = W.partitionBy(*keys).orderBy("bar_ix").rowsBetween(W.unboundedPreceding, W.currentRow)
    e = returns.withColumn("equity", F.product(1.0 + F.col("ret")).over(w))
    return e.withColumn("peak", F.max("equity").over(w))


def stepwise_trade(
    sig: Column,
    entry: Column,
    horizon: Column,
    bounds: Column,
    flips: Column | None = None,
    entropy: Column | None = None,
    skip_first: int = 0,
    exit_factor: float = 1.5,
) -> Column:
    """struct(reason, price, step, ret) with levels that change from step to step.

    ``bounds`` has the levels of each step; ``flips`` the consensus direction of
    each step against the entry price; ``entropy`` the mean entropy of each step.
    An entry price of 0 has no return (null).
    Within a step the order is stop, target, flip, belief; else the last close.
    """
    long = sig == 1

    def look(b: Column, i: Column) -> Column:
        q = F.element_at(bounds, i + 1)
        sl, tp = F.when(long, q["sl_long"]).otherwise(q["sl_short"]), F.when(long, q["tp_long"]).otherwise(q["tp_short"])
        reason = F.when(true(F.when(long, b["low"] <= sl).otherwise(b["high"] >= sl)), "sl").when(true(F.when(long, b["high"] >= tp).otherwise(b["low"] <= tp)), "tp")
        if flips is not None:
            side = F.element_at(flips, i + 1)
            reason = reason.when(true((side != 0) & (side != sig)), "flip")
        if entropy is not None:
            grown = F.element_at(entropy, i + 1) > F.greatest(entropy[0] * exit_factor, F.lit(2.0))
            reason = reason.when(true((i >= 2) & grown), "belief_exit")
        reason = F.when(i >= skip_first, reason)
        price = F.when(reason == "sl", sl).when(reason == "tp", tp).otherwise(b["close"])
        return F.struct(reason.alias("reason"), price.alias("price"), i.alias("step"))

    seen = F.filter(F.transform(horizon, look), lambda s: s["reason"].isNotNull())
    last = F.struct(F.lit("close").alias("reason"), F.element_at(horizon, -1)["close"].alias("price"), (F.size(horizon) - 1).alias("step"))
    out = F.when(F.size(seen) > 0, F.try_element_at(seen, F.lit(1))).otherwise(last)
    return F.struct(out["reason"].alias("reason"), out["price"].alias("price"), out["step"].alias("step"), F.try_divide(sig * (out["price"] - entry), entry).alias("ret"))


def signals_won(f: DataFrame, horizon: Horizon) -> DataFrame:
    """Outcome of each signal as the win-rate filter sees it: raw levels, no target in the first bar, cut at the last window."""
    long, h = F.col("sig") == 1, F.col("horizon")
    sl, tp = F.when(long, F.col("g_sl")).otherwise(F.col("g_tp")), F.when(long, F.col("g_tp")).otherwise(F.col("g_sl"))
    place = lambda mask, shift: F.when(F.array_position(mask, True) > 0, F.array_position(mask, True) + shift).otherwise(F.lit(99))
    at_sl = place(F.transform(h, lambda b: F.when(long, b["low"] <= sl).otherwise(b["high"] >= sl)), 0)
    at_tp = place(F.transform(F.slice(h, 2, horizon.pred_len), lambda b: F.when(long, b["high"] >= tp).otherwise(b["low"] <= tp)), 1)
    most = F.col("n_bars") - (horizon.lookback + horizon.pred_len) - F.col("w")
    gain = lambda price: F.col("sig") * (price - F.col("entry_open")) > 0
    hit = F.least(at_sl, at_tp) <= F.least(F.lit(horizon.pred_len), most)
    won = F.when(hit, gain(F.when(at_sl <= at_tp, sl).otherwise(tp))).when(most >= horizon.pred_len, gain(F.element_at(h, -1)["close"])).otherwise(F.lit(False))
    return f.withColumn("won", (F.col("sig") != 0) & won)


def rolling_win_rate(signals: DataFrame, window: int = 50, causal: bool = False, pred_len: int = 6) -> DataFrame:
    """Whether at least half of the last simulated trades won; rows without a signal pass and don't count.

    By default a trade counts at the window where it is opened, though its outcome
    lies ahead; ``causal`` counts only trades that were closed by then.
    """
    w = W.partitionBy("ticker").orderBy("w")
    span = w.rowsBetween(-window, 0) if not causal else w.rowsBetween(-window - pred_len, -pred_len)
    won, traded = F.sum(F.when(F.col("sig") != 0, F.col("won").cast("int")).otherwise(0)).over(span), F.sum((F.col("sig") != 0).cast("int")).over(span)
    rate = F.coalesce(won, F.lit(0)) / F.greatest(F.coalesce(traded, F.lit(0)), F.lit(1))
    ok = F.when(F.col("sig") == 0, True).when(F.coalesce(traded, F.lit(0)) == 0, F.lit(causal)).otherwise(rate >= 0.5)
    return signals.withColumn("win_rate_ok", ok)


def portfolio_ranks(rets: DataFrame, top: int = 3, bottom: int = 2) -> DataFrame:
    """Cross-sectional extension: z-score over tickers per time; weights of the best and the worst."""
    per_ts = W.partitionBy("ts")
    z = (F.col("ret") - F.avg("ret").over(per_ts)) / F.greatest(F.stddev_pop("ret").over(per_ts), F.lit(1e-10))
    scored = rets.withColumn("z", z)
    best, worst = F.row_number().over(per_ts.orderBy(F.col("ret").desc(), "ticker")), F.row_number().over(per_ts.orderBy("ret", F.col("ticker").desc()))
    weight = F.when(F.col("best") <= top, 1.0 / top).when(F.col("worst") <= bottom, -1.0 / bottom).otherwise(F.lit(0.0))
    return scored.withColumn("best", best).withColumn("worst", worst).withColumn("weight", weight).drop("best", "worst")


