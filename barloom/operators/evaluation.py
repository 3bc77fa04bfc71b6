"""Forecast quality of each window over its steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barloom.config import Horizon
from barloom.functions import metrics as m
from barloom.operators import atoms, forecast, windows

# Share of samples that agree, samples for which agreement is defined, trades a year, level quantiles.
CONSENSUS, SAMPLES, PERIODS, TP, SL = 0.8, 5, 104, 0.8, 0.2


def _steps(w: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A row for each step: returns, agreement, levels, hits, and the curve of trading each step's predicted direction."""
    both = F.posexplode(F.arrays_zip(F.col("horizon"), atoms.per_step(F.col("paths"), lambda v: v).alias("v")))
    e = w.select(*keys, "ticker", "w", "month", "entry_close", both.alias("h", "x")).withColumn("v", F.col("x.v"))
    ec, v = F.col("entry_close"), F.col("v")
    e = e.withColumns({
        "ar": (F.col("x.horizon.close") - ec) / ec,
        "pr": (forecast.mean(v) - ec) / ec,
        "up": atoms.share(v, lambda x: x > F.col("entry_close")),
        "dn": atoms.share(v, lambda x: x < F.col("entry_close")),
        "sp": forecast.std_pop(v) / ec,
        "above": forecast.quantile(v, TP),
        "below": forecast.quantile(v, SL),
    })
    e = e.withColumns({"above": F.when(F.col("above") > ec, F.col("above")), "below": F.when(F.col("below") < ec, F.col("below"))})
    side, high, low = F.signum("pr"), F.col("x.horizon.high"), F.col("x.horizon.low")
    stopped = F.coalesce(F.when(side == 1, low <= F.col("below")).when(side == -1, high >= F.col("above")), F.lit(False))
    taken = F.coalesce(F.when(side == 1, high >= F.col("above")).when(side == -1, low <= F.col("below")), F.lit(False)) & ~stopped
    five = F.size("v") == SAMPLES
    e = e.withColumns({"stopped": stopped, "taken": taken, "pnl": side * F.col("ar"), "agreed": five & ((F.col("up") >= CONSENSUS) | (F.col("dn") >= CONSENSUS)), "side": F.when(F.col("up") >= CONSENSUS, 1.0).otherwise(-1.0), "five": five})
    so_far = W.partitionBy(*keys, "ticker", "w").orderBy("h").rowsBetween(W.unboundedPreceding, W.currentRow)
    e = e.withColumn("equity", F.product(1.0 + F.col("pnl")).over(so_far)).withColumn("peak", F.max("equity").over(so_far))
    return e.withColumns({"rank_a": m.mean_rank(F.col("ar"), [*keys, "ticker", "w"]), "rank_p": m.mean_rank(F.col("pr"), [*keys, "ticker", "w"])})


def _correlation(a: Column, b: Column) -> Column:
    """Null where a side is constant."""
    return F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), m.correlation(a, b))


def _sharpe(pnl: Column) -> Column:
    return F.avg(pnl) / (F.stddev_pop(pnl) + 1e-8) * PERIODS**0.5


def _expectancy(where: Column) -> Column:
    """Share of targets among hits times the mean gain, less that of stops times the mean loss."""
    count = lambda c: F.count_if(where & c)
    hits = F.greatest(count(F.col("taken")) + count(F.col("stopped")), F.lit(1))
    mean = lambda c: F.coalesce(F.sum(F.when(where & c, F.abs("ar"))), F.lit(0.0)) / F.greatest(count(c), F.lit(1))
    return count(F.col("taken")) / hits * mean(F.col("ar") > 0) - count(F.col("stopped")) / hits * mean(F.col("ar") < 0)


def evaluate_windows(w: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """All metrics of each window (ticker, w, month, entry_close, horizon, paths); a window entered at 0 has none and no row.

    ``keys`` are columns that tell further versions of a window apart.  Agreement counts with five samples only; with another number its metrics are 0
    and the expectancy is that of all steps.
    """
    a, p, five, agreed = F.col("ar"), F.col("pr"), F.first("five"), F.col("agreed")
    zero = F.lit(0.0)
    with_five = lambda x: F.when(five, F.coalesce(x, zero)).otherwise(zero)
    return _steps(w.filter("entry_close <> 0"), keys).groupBy(*keys, "ticker", "w", "month").agg(
        m.direction_accuracy(a, p).alias("direction_accuracy"),
        F.avg((F.signum(p) == 0).cast("double")).alias("flat_rate"),
        with_five(F.avg(agreed.cast("double"))).alias("consensus_rate"),
        with_five(F.avg(F.greatest("up", "dn"))).alias("consensus_strength"),
        with_five(F.avg(F.when(agreed, (F.signum(a) == F.col("side")).cast("double")))).alias("consensus_dir_acc"),
        _sharpe(F.col("pnl")).alias("direction_sharpe"),
        _correlation(a, p).alias("return_correlation"),
        _correlation(F.col("rank_a"), F.col("rank_p")).alias("ic_rank"),
        m.bias(a, p).alias("bias"),
        m.mae(a, p).alias("mae"),
        F.avg("sp").alias("prediction_volatility"),
        F.count("*").cast("double").alias("unfiltered_trades"),
        _expectancy(F.lit(True)).alias("unfiltered_expectancy"),
        with_five(F.count_if(agreed).cast("double")).alias("consensus_trades"),
        F.when(five, _expectancy(agreed)).otherwise(_expectancy(F.lit(True))).alias("expectancy"),
        with_five(_sharpe(F.when(agreed, F.col("side") * a))).alias("consensus_sharpe"),
        F.min((F.col("equity") - F.col("peak")) / F.col("peak")).alias("max_drawdown_simple"),
    )


def metric_names(evaluated: DataFrame) -> list[str]:
    return evaluated.columns[evaluated.columns.index("direction_accuracy") :]


def monthly_means(evaluated: DataFrame, keys: tuple[str, ...] = ("ticker", "month")) -> DataFrame:
    """Means over the windows of a month, unknown values left out, and how many windows there are."""
    known = lambda c: F.avg(F.nanvl(F.col(c), F.lit(None).cast("double"))).alias(c)
    return evaluated.groupBy(*keys).agg(F.count("*").alias("n_windows"), *map(known, metric_names(evaluated)))


def best_month(monthly: DataFrame, by: tuple[str, ...] = ("consensus_dir_acc", "expectancy")) -> DataFrame:
    """The best month of each ticker."""
    order = W.partitionBy("ticker").orderBy(*[F.col(c).desc_nulls_last() for c in by], "month")
    return monthly.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def walk_forward(bars: DataFrame, horizon: Horizon, forecaster: str = "analog") -> DataFrame:
    """From bars to each ticker's best month (best_month, n_windows, its metrics) and its mean direction accuracy over months."""
    paths = forecast.get_forecaster(forecaster).transform(bars, horizon)
    monthly = monthly_means(evaluate_windows(windows.sliding_windows(paths, horizon)))
    # Rounded, so that months whose means differ in the last bits only are ties.
    rounded = monthly.withColumns({c: F.round(c, 9) for c in ("consensus_dir_acc", "expectancy")})
    averages = monthly.groupBy("ticker").agg(F.avg("consensus_dir_acc").alias("mean_dir_acc"))
    return best_month(rounded).withColumnRenamed("month", "best_month").join(averages, "ticker")
