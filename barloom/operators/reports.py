"""Metric tables over per-bar returns and trades, by any keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barloom.config import PERIODS_QUARTER, PERIODS_STRATEGY, PERIODS_TRADE
from barloom.functions import metrics as m
from barloom.operators.simulate import held_returns, with_equity
from barloom.operators.windows import quarter_of


def strategy_metrics(per_bar: DataFrame, keys: tuple[str, ...] = ("strategy", "ticker"), trials: int = 1) -> DataFrame:
    """Sharpe, sortino, average return and active share over all bars; the other metrics over active ones.

    total_return is the last equity over the first, so the first bar's return
    doesn't show; n_trades counts active bars.
    """
    e = with_equity(per_bar, keys)
    ret, active = F.col("ret"), F.when(F.col("ret") != 0, F.col("ret"))
    mdd = m.max_drawdown(F.col("equity"), F.col("peak"))
    return e.groupBy(*keys).agg(
        m.sharpe(ret).alias("sharpe"),
        m.sortino(ret).alias("sortino"),
        m.average_return(ret).alias("avg_return"),
        m.active_share(ret).alias("trade_pct"),
        m.n_active(ret).alias("n_trades"),
        m.profit_factor(active).alias("profit_factor"),
        m.win_rate(active).alias("win_rate"),
        mdd.alias("max_dd"),
        m.calmar(active, mdd).alias("calmar"),
        m.probabilistic_sharpe(active).alias("psr"),
        m.deflated_sharpe(active, trials).alias("dsr"),
        (F.max_by("equity", "bar_ix") / F.min_by("equity", "bar_ix") - 1).alias("total_return"),
        F.coalesce(F.sum("ret"), F.lit(0.0)).alias("total_pnl"),
    )


def trade_metrics(trades: DataFrame, bars: DataFrame, commission: float = 0.0, trials: int = 1, periods: int = PERIODS_STRATEGY) -> DataFrame:
    """:func:`strategy_metrics` of :func:`simulate.per_bar`, from the held bars alone and each ticker's number of bars.

    Idle bars add nothing to sums and leave the curve where it is, so only their number
    counts: the deviation over all bars is put together from that of the held ones.
    """
    keys = ("strategy", "ticker")
    held = with_equity(held_returns(trades, commission), keys)
    ret, active = F.col("ret"), F.when(F.col("ret") != 0, F.col("ret"))
    # The curve stands at 1 until something is held, so that is its first peak, unless the very first bar is.
    first = F.min("bar_ix") == 0
    low, of_one = m.max_drawdown(F.col("equity"), F.col("peak")), m.max_drawdown(F.col("equity"), F.greatest("peak", F.lit(1.0)))
    own = held.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(ret).alias("mean"), F.stddev_pop(ret).alias("std"), F.sum(ret).alias("total_pnl"), F.sum(F.least(ret, F.lit(0.0)) ** 2).alias("down"),
        m.n_active(ret).alias("n_trades"), m.profit_factor(active).alias("profit_factor"), m.win_rate(active).alias("win_rate"), F.avg(active).alias("active_mean"),
        F.least(F.lit(0.0), F.when(first, low).otherwise(of_one)).alias("max_dd"), m.probabilistic_sharpe(active).alias("psr"), m.deflated_sharpe(active, trials).alias("dsr"),
        (F.max_by("equity", "bar_ix") / F.when(first, F.min_by("equity", "bar_ix")).otherwise(1.0) - 1).alias("total_return"),
    )
    of_ticker = bars.groupBy("ticker").agg(F.count("*").alias("all"))
    n, k = F.col("all").cast("double"), F.col("n")
    mean = F.col("total_pnl") / n
    std = F.sqrt((k * F.col("std") ** 2 + k * (F.col("mean") - mean) ** 2 + (n - k) * mean**2) / n)
    downside, scale = F.sqrt(F.col("down") / n), math.sqrt(periods)
    return own.join(of_ticker, "ticker").select(
        *keys,
        F.when(n < 2, 0.0).otherwise(scale * mean / (std + 1e-8)).alias("sharpe"),
        F.when(downside < 1e-8, 0.0).otherwise(scale * mean / F.greatest(downside, F.lit(1e-8))).alias("sortino"),
        (mean * periods).alias("avg_return"),
        (F.col("n_trades") / n).alias("trade_pct"),
        "n_trades", "profit_factor", "win_rate", "max_dd",
        (F.coalesce("active_mean", F.lit(0.0)) * periods / (F.abs("max_dd") + 1e-8)).alias("calmar"),
        "psr", "dsr", "total_return", "total_pnl",
    )


def before_and_after(per_bar: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(strategy, quarter, and of aver_ret, profit_factor and win_rate: before, after, delta): each strategy beside the version with a filter.

    Quarters and "overall" as in :func:`quarter_tuples`; what the filtered version lacks is 0.
    """
    values = ("aver_ret", "profit_factor", "win_rate")
    names = F.create_map(*[x for a, b in pairs for x in (F.lit(b), F.lit(a))])
    q = quarter_tuples(per_bar.filter(F.col("strategy").isin([x for p in pairs for x in p])))
    before = q.filter(F.col("strategy").isin([a for a, _ in pairs])).select("strategy", "quarter", *[F.col(c).alias(f"{c}_before") for c in values])
    after = q.filter(F.col("strategy").isin([b for _, b in pairs])).select(F.element_at(names, F.col("strategy")).alias("strategy"), "quarter", *[F.col(c).alias(f"{c}_after") for c in values])
    both = before.join(after, ["strategy", "quarter"], "left")
    later = lambda c: F.coalesce(f"{c}_after", F.lit(0.0))
    return both.select("strategy", "quarter", *[x for c in values for x in (F.col(f"{c}_before"), later(c).alias(f"{c}_after"), (later(c) - F.col(f"{c}_before")).alias(f"{c}_delta"))])


def trade_report(trades: DataFrame, *keys: str | Column, order: str = "w") -> DataFrame:
    """Counts, rates, means and risk of trades (ret, reason), compounded in the order of entry."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    e = trades.withColumn("equity", F.product(1.0 + F.col("ret")).over(w)).withColumn("peak", F.max("equity").over(w))
    ret, n = F.col("ret"), F.count("*")
    wins, losses = F.count_if(ret > 0), F.count_if(ret <= 0)
    gained, lost = F.coalesce(F.sum(F.when(ret > 0, ret)), F.lit(0.0)), F.abs(F.coalesce(F.sum(F.when(ret <= 0, ret)), F.lit(0.0)))
    count = lambda reason: F.count_if(F.col("reason") == reason)
    std = F.coalesce(F.stddev_samp(ret), F.lit(0.0))
    return e.groupBy(*keys).agg(
        n.alias("n"),
        count("tp").alias("tp_hits"),
        count("sl").alias("sl_hits"),
        count("close").alias("closes"),
        wins.alias("wins"),
        losses.alias("losses"),
        (wins / n).alias("win_rate"),
        (F.sum(ret) * 100).alias("total_return_pct"),
        (F.avg(ret) * 100).alias("avg_return_pct"),
        (std * 100).alias("std_return_pct"),
        (gained / F.greatest(wins, F.lit(1)) * 100).alias("avg_win_pct"),
        (-lost / F.greatest(losses, F.lit(1)) * 100).alias("avg_loss_pct"),
        (F.avg(ret) / F.greatest(std, F.lit(1e-10)) * (PERIODS_TRADE**0.5)).alias("sharpe"),
        (F.min((F.col("equity") - F.col("peak")) / F.col("peak")) * 100).alias("mdd_pct"),
        (gained / F.greatest(lost, F.lit(1e-10))).alias("profit_factor"),
    )


def quarterly(per_bar: DataFrame, least: int = 10) -> DataFrame:
    """Per strategy, quarter and overall: one ROLLUP over active bars."""
    q = per_bar.withColumn("quarter", quarter_of(F.col("ts"))).filter("ret <> 0")
    ret = F.col("ret")
    rolled = q.rollup("strategy", "quarter").agg(
        F.count("*").alias("n_active"),
        F.sum("ret").alias("total_pnl"),
        (F.coalesce(F.sum(F.when(ret > 0, ret)), F.lit(0.0)) / F.greatest(F.abs(F.coalesce(F.sum(F.when(ret < 0, ret)), F.lit(0.0))), F.lit(1e-12))).alias("profit_factor"),
        F.avg("ret").alias("aver_ret"),
        m.win_rate(ret).alias("win_rate"),
        m.sharpe(ret, PERIODS_QUARTER).alias("sharpe"),
    )
    return rolled.filter(F.col("strategy").isNotNull() & (F.col("n_active") >= least)).withColumn("quarter", F.coalesce("quarter", F.lit("overall")))


# Decimals of the quarterly CSV.
QUARTER_DIGITS = {"total_pnl": 6, "profit_factor": 4, "aver_ret": 8, "sharpe": 2}


def _by_quarter(per_bar: DataFrame) -> DataFrame:
    """Every quarter and "overall" with all its bars; means are over active bars."""
    q = per_bar.withColumn("quarter", quarter_of(F.col("ts")))
    active = F.when(F.col("ret") != 0, F.col("ret"))
    rolled = q.rollup("strategy", "quarter").agg(
        F.count("*").alias("n_bars"),
        F.count(active).alias("n_active"),
        F.sum("ret").alias("total_pnl"),
        (F.coalesce(F.sum(F.when(active > 0, active)), F.lit(0.0)) / F.greatest(F.abs(F.coalesce(F.sum(F.when(active < 0, active)), F.lit(0.0))), F.lit(1e-12))).alias("profit_factor"),
        F.avg(active).alias("aver_ret"),
        F.avg((active > 0).cast("double")).alias("win_rate"),
        (F.lit(PERIODS_QUARTER**0.5) * F.avg(active) / (F.stddev_pop(active) + 1e-8)).alias("sharpe"),
    )
    return rolled.filter("strategy is not null").withColumn("quarter", F.coalesce("quarter", F.lit("overall")))


def quarter_tables(per_bar: DataFrame) -> DataFrame:
    """Average returns of three active bars or more and Sharpe ratios of ten or more; null below that."""
    q = _by_quarter(per_bar)
    return q.withColumn("aver_ret", F.when(F.col("n_active") >= 3, F.col("aver_ret"))).withColumn("sharpe", F.when(F.col("n_active") >= 10, F.col("sharpe")))


def _at_least(q: DataFrame, n: int) -> DataFrame:
    """Quarters with ``n`` active bars or more; overall, more than ``n``."""
    return q.filter(F.col("n_active") >= F.when(F.col("quarter") == "overall", n + 1).otherwise(n))


def quarter_rows(per_bar: DataFrame) -> DataFrame:
    return _at_least(_by_quarter(per_bar), 10)


def quarter_tuples(per_bar: DataFrame) -> DataFrame:
    return _at_least(_by_quarter(per_bar), 5).withColumnRenamed("n_active", "n")


def metric_bundle(per_bar: DataFrame, signals: DataFrame, trades: DataFrame, keys: tuple[str, ...] = ("strategy", "ticker")) -> DataFrame:
    """:func:`strategy_metrics` with signal counts, the average return a signal, and counts, mean holding and win rate of trades."""
    by_signal = signals.groupBy(*keys).agg(F.count_if(F.col("sig") == 1).alias("n_long"), F.count_if(F.col("sig") == -1).alias("n_short"))
    by_trade = trades.groupBy(*keys).agg(
        F.count_if(F.col("sig") == 1).alias("longs"), F.count_if(F.col("sig") == -1).alias("shorts"), F.avg("holding").alias("mean_holding"), m.win_rate(F.col("ret")).alias("trade_win_rate")
    )
    found = strategy_metrics(per_bar, keys).join(by_signal, [*keys]).join(by_trade, [*keys])
    return found.withColumn("aver_ret", F.col("total_pnl") / F.greatest(F.col("n_long") + F.col("n_short"), F.lit(1)))


def by_hour_and_weekday(per_bar: DataFrame, least: int = 5) -> DataFrame:
    """Hour-of-day and weekday tables in one pass by grouping sets."""
    b = per_bar.filter("ret <> 0").withColumn("hour", F.hour("ts")).withColumn("weekday", F.weekday("ts"))
    grouped = b.groupingSets([["strategy", "hour"], ["strategy", "weekday"]], "strategy", "hour", "weekday").agg(
        F.count("*").alias("n"), F.sum("ret").alias("total_ret"), m.profit_factor(F.col("ret")).alias("profit_factor"), F.avg("ret").alias("aver_ret")
    )
    return grouped.filter(F.col("n") >= least)


def weekday_quarter(per_bar: DataFrame, hours: tuple[int, ...] = (15, 16), least: int = 3) -> DataFrame:
    """Strategy by weekday, by quarter and in all, at some hours only."""
    b = per_bar.filter((F.col("ret") != 0) & F.hour("ts").isin(list(hours))).withColumn("weekday", F.weekday("ts")).withColumn("quarter", quarter_of(F.col("ts")))
    rolled = b.rollup("strategy", "weekday", "quarter").agg(F.count("*").alias("n"), F.sum("ret").alias("total_ret"))
    return rolled.filter(F.col("strategy").isNotNull() & F.col("weekday").isNotNull() & (F.col("n") >= least)).withColumn("quarter", F.coalesce("quarter", F.lit("all")))


def half_year(per_bar: DataFrame, quarters: tuple[str, ...], least: int = 20) -> DataFrame:
    """Metrics of the bars in some quarters, the others set to zero."""
    inside = quarter_of(F.col("ts")).isin(list(quarters))
    masked = per_bar.withColumn("ret", F.when(inside, F.col("ret")).otherwise(F.lit(0.0)))
    e = with_equity(masked)
    ret, active = F.col("ret"), F.when(F.col("ret") != 0, F.col("ret"))
    out = e.groupBy("strategy", "ticker").agg(
        m.n_active(ret).alias("n_active"),
        m.sharpe(active, PERIODS_QUARTER).alias("sharpe"),
        (F.max_by("equity", "bar_ix") / F.min_by("equity", "bar_ix") - 1).alias("total_return"),
        m.profit_factor(active).alias("profit_factor"),
        m.win_rate(active).alias("win_rate"),
        F.avg(active).alias("aver_ret"),
        m.max_drawdown(F.col("equity"), F.col("peak")).alias("max_dd"),
    )
    return out.filter(F.col("n_active") >= least)


def best_half_year(metrics: DataFrame, top: int = 15) -> DataFrame:
    """The ``top`` rows of :func:`half_year` by Sharpe ratio, with their places."""
    order = [F.col("sharpe").desc(), F.col("strategy"), F.col("ticker")]
    return metrics.orderBy(*order).limit(top).withColumn("place", F.row_number().over(W.orderBy(*order)))


def hourly_trades(trades: DataFrame, least: int = 1) -> DataFrame:
    """Trades by hour of entry."""
    total = trades.groupBy("strategy").agg(F.count("*").alias("all_trades"))
    ret = F.col("ret")
    share = lambda reason: F.avg((F.col("reason") == reason).cast("double"))
    hours = trades.withColumn("hour", F.hour("pred_ts")).groupBy("strategy", "hour").agg(
        F.count("*").alias("n"),
        m.win_rate(ret).alias("win_rate"),
        F.avg(ret).alias("avg_ret"),
        (F.coalesce(F.sum(F.when(ret > 0, ret)), F.lit(0.0)) / F.greatest(F.abs(F.coalesce(F.sum(F.when(ret < 0, ret)), F.lit(0.0))), F.lit(1e-10))).alias("profit_factor"),
        (F.avg(ret) / F.greatest(F.coalesce(F.stddev_samp(ret), F.lit(0.0)), F.lit(1e-10)) * (PERIODS_TRADE**0.5)).alias("sharpe"),
        share("tp").alias("tp_share"),
        share("sl").alias("sl_share"),
        share("close").alias("close_share"),
    )
    return hours.join(total, "strategy").withColumn("trade_pct", F.col("n") / F.col("all_trades")).drop("all_trades").filter(F.col("n") >= least)


def hour_quarter_pivot(trades: DataFrame, quarters: list[str]) -> DataFrame:
    """Mean return over deviation by hour (rows) and quarter (columns)."""
    ret = F.col("ret")
    ratio = F.avg(ret) / F.greatest(F.coalesce(F.stddev_samp(ret), F.lit(0.0)), F.lit(1e-10)) * (PERIODS_TRADE**0.5)
    return trades.withColumn("hour", F.hour("pred_ts")).withColumn("quarter", quarter_of(F.col("pred_ts"))).groupBy("strategy", "hour").pivot("quarter", quarters).agg(ratio)


def gates(metrics: DataFrame, ic: Column | None = None) -> DataFrame:
    """Acceptance gates as boolean columns."""
    g = metrics.withColumn("gate_sharpe", F.col("sharpe") >= 0.5).withColumn("gate_win_rate", F.col("win_rate") >= 0.52)
    g = g.withColumn("gate_drawdown", F.abs("max_dd") <= 0.25).withColumn("gate_psr", F.col("psr") >= 0.7)
    return g if ic is None else g.withColumn("gate_ic", ic >= 0.02)


def compare(metrics: DataFrame, a: str, b: str, columns: list[str], keys: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Two strategies side by side: metric, a, b, delta."""
    long = metrics.unpivot(["strategy", *keys], columns, "metric", "value")
    side = lambda name, col: long.filter(F.col("strategy") == name).select(*keys, "metric", F.col("value").alias(col))
    return side(a, "a").join(side(b, "b"), [*keys, "metric"]).withColumn("delta", F.col("b") - F.col("a"))
