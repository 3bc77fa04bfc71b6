"""Risk and forecast metrics as named aggregate columns.

``ret`` columns may have nulls, which don't count.  Guards and annualisations
follow each metric's own definition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from barloom.config import PERIODS_STRATEGY
from barloom.functions import normal

EULER = 0.5772156649015329


def sharpe(ret: Column, periods: int = PERIODS_STRATEGY, rf: float = 0.0) -> Column:
    n = F.count(ret)
    return F.when(n < 2, F.lit(0.0)).otherwise(F.lit(math.sqrt(periods)) * (F.avg(ret) - rf / periods) / (F.stddev_pop(ret) + 1e-8))


def max_drawdown(equity: Column, peak: Column) -> Column:
    return F.min((equity - peak) / peak)


def profit_factor(ret: Column) -> Column:
    return F.coalesce(F.sum(F.when(ret > 0, ret)), F.lit(0.0)) / (F.abs(F.coalesce(F.sum(F.when(ret < 0, ret)), F.lit(0.0))) + 1e-8)


def win_rate(ret: Column) -> Column:
    return F.coalesce(F.avg((ret > 0).cast("double")), F.lit(0.0))


def calmar(ret: Column, drawdown: Column, periods: int = PERIODS_STRATEGY) -> Column:
    return F.coalesce(F.avg(ret), F.lit(0.0)) * periods / (F.abs(drawdown) + 1e-8)


def sortino(ret: Column, periods: int = PERIODS_STRATEGY) -> Column:
    downside = F.sqrt(F.avg(F.least(ret, F.lit(0.0)) ** 2))
    return F.when(downside < 1e-8, F.lit(0.0)).otherwise(F.lit(math.sqrt(periods)) * F.avg(ret) / F.greatest(downside, F.lit(1e-8)))


def average_return(ret: Column, periods: int = PERIODS_STRATEGY) -> Column:
    return F.avg(ret) * periods


def n_active(ret: Column) -> Column:
    return F.count_if(ret != 0)


def active_share(ret: Column) -> Column:
    return F.count_if(ret != 0) / F.greatest(F.count(ret), F.lit(1))


def direction_accuracy(actual: Column, predicted: Column) -> Column:
    hit = F.when(F.signum(predicted) != 0, (F.signum(actual) == F.signum(predicted)).cast("double"))
    return F.coalesce(F.avg(hit), F.lit(0.0))


def pearson(a: Column | str, b: Column | str) -> Column:
    """Correlation over rows where both sides are known; null where one is constant (the built-in one fails there)."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    known = a.isNotNull() & b.isNotNull()
    a, b = F.when(known, a), F.when(known, b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlation(a: Column, b: Column) -> Column:
    both = a.isNotNull() & b.isNotNull()
    return F.when(F.count_if(both) < 3, F.lit(0.0)).otherwise(pearson(a, b))


def bias(actual: Column, predicted: Column) -> Column:
    return F.avg(predicted - actual)


def mae(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(predicted - actual))


def _moments(ret: Column) -> tuple[Column, Column, Column, Column]:
    """Mean, deviation, skewness and excess kurtosis; the last two 0 where the deviation vanishes."""
    sd = F.stddev_pop(ret)
    return F.avg(ret), sd, F.when(sd < 1e-12, F.lit(0.0)).otherwise(F.skewness(ret)), F.when(sd < 1e-12, F.lit(0.0)).otherwise(F.kurtosis(ret))


def sharpe_variance(ret: Column) -> Column:
    mu, sd, skew, kurt = _moments(ret)
    sr = mu / F.greatest(sd, F.lit(1e-12))
    return (1.0 + 0.5 * sr**2 - skew * sr + kurt * sr**2 / 4.0) / F.greatest(F.count(ret) - 1, F.lit(1))


def probabilistic_sharpe(ret: Column, target: float = 0.0) -> Column:
    """Probability that the Sharpe ratio exceeds the target."""
    sr = F.avg(ret) / F.greatest(F.stddev_pop(ret), F.lit(1e-12))
    z = (sr - target) / (F.sqrt(F.greatest(sharpe_variance(ret), F.lit(0.0))) + 1e-8)
    flat = F.when(F.avg(ret) > target, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(F.count(ret) < 2, F.lit(0.0)).when(F.stddev_pop(ret) < 1e-12, flat).otherwise(normal.cdf(z))


def deflated_sharpe(ret: Column, trials: int = 1) -> Column:
    """Against the best of so many trials."""
    if trials < 2:
        return probabilistic_sharpe(ret)
    z_max = (1 - EULER) * normal.quantile(1 - 1 / trials) + EULER * normal.quantile(1 - 1 / (trials * math.e))
    n = F.count(ret)
    sr = F.avg(ret) / F.greatest(F.stddev_pop(ret), F.lit(1e-12))
    z = (sr * F.sqrt(n - 1.0) - z_max) / (F.sqrt(F.greatest(sharpe_variance(ret) * (n - 1), F.lit(0.0))) + 1e-8)
    return F.when(n < 2, F.lit(0.0)).otherwise(normal.cdf(z))


def mean_rank(order: Column, partition: list[str]) -> Column:
    """Average rank of ties."""
    from pyspark.sql import Window as W

    low = F.rank().over(W.partitionBy(*partition).orderBy(order))
    peers = F.count(F.lit(1)).over(W.partitionBy(*partition, order))
    return low + (peers - 1) / 2.0
