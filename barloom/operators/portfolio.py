"""A portfolio over all assets: weights by rank, positions held over time, costs, and its equity curve.

At each time assets are ranked by a score; the best are bought, the worst sold
short.  A position is entered at the open of the bar after its signal, held whatever
later signals say, and left at a close: at a stop, a target, the end of its horizon or
of the session.  Positions never outlast a session, so a session of an asset is a fold
over an array of its bars, and a long history spreads over its sessions.  The curve
takes prefix products in two levels, within days and over the few rows of the days.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barloom.operators.simulate import portfolio_ranks
from barloom.sources.bars import minute_of_day


@dataclass(frozen=True)
class Rules:
    """How positions are taken and left; times in minutes of the day, the cost in shares of a position's weight."""

    top: int = 3
    bottom: int = 2
    stop: float = 0.015
    target: float = 0.025
    horizon: int = 6
    cost: float = 0.0005
    enter_from: int = 600
    enter_until: int = 1090
    leave_at: int = 1115


_STATE = "struct<weight:double,entry:double,last:double,held:int,next:double,out:array<struct<bar_ix:bigint,ts:timestamp_ntz,weight:double,pnl:double,turnover:double,held:int,reason:string>>>"


def target_weights(scores: DataFrame, rules: Rules) -> DataFrame:
    """(ticker, ts, score) with ``z`` over the assets of a time and ``weight``; assets without a score are no part of it.

    With fewer assets than places an asset may be among both the best and the worst; it is bought then.
    """
    known = scores.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    return portfolio_ranks(known.withColumnRenamed("score", "ret"), rules.top, rules.bottom).withColumnRenamed("ret", "score")


def _session(bars: Column, rules: Rules) -> Column:
    """The positions of one session, a row for each bar on which there is one."""
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    begin = F.struct(zero.alias("weight"), none.alias("entry"), none.alias("last"), F.lit(0).alias("held"), zero.alias("next"), F.array().alias("out")).cast(_STATE)
    end = F.element_at(bars, -1)["bar_ix"]

    def step(a: Column, b: Column) -> Column:
        on = a["weight"] != 0
        enters = ~on & (a["next"] != 0) & b["minute"].between(rules.enter_from, rules.enter_until) & (b["open"] > 0)
        w = F.when(on, a["weight"]).when(enters, a["next"]).otherwise(zero)
        entry = F.when(on, a["entry"]).when(enters, b["open"])
        held = F.when(w == 0, 0).otherwise(a["held"] + 1)
        base = F.when(on, a["last"]).otherwise(b["open"])
        gain = F.signum(w) * F.try_divide(b["close"] - entry, entry)
        reason = F.when(
            w != 0,
            F.when(gain <= -rules.stop, "stop").when(gain >= rules.target, "target").when(held >= rules.horizon, "horizon").when((b["minute"] >= rules.leave_at) | (b["bar_ix"] == end), "session"),
        )
        left = reason.isNotNull()
        pnl = w * F.coalesce(F.try_divide(b["close"] - base, base), zero) - F.when(left, F.abs(w) * rules.cost).otherwise(zero)
        turnover = F.abs(w) * (F.when(on, 0.0).otherwise(1.0) + F.when(left, 1.0).otherwise(0.0))
        row = F.struct(b["bar_ix"].alias("bar_ix"), b["ts"].alias("ts"), w.alias("weight"), pnl.alias("pnl"), turnover.alias("turnover"), held.alias("held"), reason.alias("reason"))
        return F.struct(
            F.when(left, zero).otherwise(w).alias("weight"),
            entry.alias("entry"),
            b["close"].alias("last"),
            F.when(left, 0).otherwise(held).alias("held"),
            b["weight"].alias("next"),
            F.when(w != 0, F.concat(a["out"], F.array(row))).otherwise(a["out"]).alias("out"),
        ).cast(_STATE)

    return F.aggregate(bars, begin, step, lambda a: a["out"])


def positions(bars: DataFrame, weights: DataFrame, rules: Rules) -> DataFrame:
    """(ticker, session_date, bar_ix, ts, weight, pnl, turnover, held, reason) for each bar on which an asset is held.

    ``reason`` says why the position is left at that bar's close.  Bars without a
    weight give no signal.
    """
    w = weights.select("ticker", "ts", "weight")
    signalled = bars.join(w, ["ticker", "ts"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    bar = F.struct("bar_ix", "ts", minute_of_day(F.col("ts")).alias("minute"), "open", "close", "weight")
    sessions = signalled.groupBy("ticker", "session_date").agg(F.array_sort(F.collect_list(bar)).alias("bars"))
    return sessions.select("ticker", "session_date", F.explode(_session(F.col("bars"), rules)).alias("p")).select("ticker", "session_date", "p.*")


def equity_curve(held: DataFrame) -> DataFrame:
    """(ts, n_positions, exposure, turnover, pnl, equity, drawdown) for each time at which anything is held."""
    at = held.groupBy("session_date", "ts").agg(
        F.count("*").alias("n_positions"), F.sum(F.abs("weight")).alias("exposure"), F.sum("turnover").alias("turnover"), F.sum("pnl").alias("pnl")
    )
    in_day = W.partitionBy("session_date").orderBy("ts").rowsBetween(W.unboundedPreceding, W.currentRow)
    own = at.withColumn("own", F.product(1.0 + F.col("pnl")).over(in_day)).withColumn("own_peak", F.max("own").over(in_day))
    # A row a day from here to the join.
    days = own.groupBy("session_date").agg(F.max_by("own", "ts").alias("grown"), F.max("own").alias("most"))
    before = W.orderBy("session_date").rowsBetween(W.unboundedPreceding, -1)
    days = days.withColumn("base", F.coalesce(F.product("grown").over(before), F.lit(1.0)))
    days = days.withColumn("peak", F.greatest(F.coalesce(F.max(F.col("base") * F.col("most")).over(before), F.lit(1.0)), F.lit(1.0)))
    curve = own.join(days.select("session_date", "base", "peak"), "session_date")
    equity = F.col("base") * F.col("own")
    return curve.select("ts", "n_positions", "exposure", "turnover", "pnl", equity.alias("equity"), (equity / F.greatest("peak", F.col("base") * F.col("own_peak")) - 1).alias("drawdown"))
