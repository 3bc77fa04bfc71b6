"""Sources of forecast samples and beliefs.

A forecaster is anything that maps windows to sample paths.  The analog
forecaster needs no model: sample s repeats the relative moves that followed the
bar ``pred_len * (s + 1)`` bars ago.  Models plug in through
:class:`Forecaster` and run Arrow batch by batch.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from barloom.config import Horizon
from barloom.operators.rolling import floor
from barloom.sources.bars import by_bar


class Forecaster(ABC):
    """Adds ``paths`` (array of sample paths of closes) to windows or bars."""

    @abstractmethod
    def transform(self, df: DataFrame, horizon: Horizon) -> DataFrame: ...


_FORECASTERS: dict[str, Callable[[], Forecaster]] = {}


def register_forecaster(name: str) -> Callable[[Callable[[], Forecaster]], Callable[[], Forecaster]]:
    def register(make):
        _FORECASTERS[name] = make
        return make

    return register


def get_forecaster(name: str) -> Forecaster:
    if name not in _FORECASTERS:
        raise KeyError(f"no forecaster {name!r}; there are {sorted(_FORECASTERS)}")
    return _FORECASTERS[name]()


def list_forecasters() -> list[str]:
    return sorted(_FORECASTERS)


@register_forecaster("analog")
class AnalogForecaster(Forecaster):
    """A move from a price of 0 is unknown, and null."""

    def transform(self, df: DataFrame, horizon: Horizon) -> DataFrame:
        w = by_bar()

        def path(s: int) -> Column:
            back = horizon.pred_len * (s + 1)
            return F.array(*[F.try_divide(F.col("close") * F.lag("close", back - h).over(w), F.lag("close", back).over(w)) for h in range(1, horizon.pred_len + 1)])

        return df.withColumn("paths", F.array(*[path(s) for s in range(horizon.samples)]))


class BatchForecaster(Forecaster):
    """A model as a function of contexts: (n, lookback) closes to (n, samples, pred_len) paths.

    ``load`` runs once per task; batches follow Arrow's batch size.
    """

    def __init__(self, load: Callable[[], Callable[[np.ndarray], np.ndarray]]):
        self.load = load

    def transform(self, df: DataFrame, horizon: Horizon) -> DataFrame:
        load = self.load
        marked = df.withColumn("context", F.collect_list("close").over(by_bar().rowsBetween(-(horizon.lookback - 1), 0)))
        full = marked.filter(F.size("context") == horizon.lookback)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for batch in batches:
                if len(batch):
                    paths = model(np.stack(batch["context"].to_numpy()))
                    batch = batch.assign(paths=[p.tolist() for p in paths])
                    yield batch.drop(columns="context")

        schema = full.drop("context").withColumn("paths", F.lit(None).cast("array<array<double>>")).schema
        return full.mapInPandas(run, schema)


def last_step(paths: Column) -> Column:
    """The final value of each sample."""
    return F.transform(paths, lambda p: F.element_at(p, -1))


def at_step(paths: Column, h: Column) -> Column:
    return F.transform(paths, lambda p: F.element_at(p, h))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def std_pop(values: Column) -> Column:
    return F.sqrt(F.greatest(mean(F.transform(values, lambda x: (x - mean(values)) ** 2)), F.lit(0.0)))


def quantile(values: Column, q: float | Column) -> Column:
    """Linearly interpolated quantile of a small array."""
    q = F.lit(q) if isinstance(q, float) else q
    ordered = F.array_sort(values)
    place = q * (F.size(values) - 1)
    low = F.floor(place).cast("int")
    a = F.element_at(ordered, low + 1)
    b = F.element_at(ordered, F.least(low + 2, F.size(values)))
    return a + (b - a) * (place - low)


def distribution(codes: Column) -> Column:
    """Shares of the distinct codes."""
    return F.transform(F.array_distinct(codes), lambda x: F.size(F.filter(codes, lambda y: y == x)) / F.size(codes))


def entropy_bits(shares: Column) -> Column:
    """Entropy; a share of 0 adds 0."""
    return -F.aggregate(shares, F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)))


def belief_of(coarse: Column, fine: Column) -> Column:
    """confidence, entropy_s1, top3_mass, entropy_ratio of two levels of code distributions."""
    p, q = distribution(coarse), distribution(fine)
    top = F.aggregate(F.slice(F.sort_array(p, asc=False), 1, 3), F.lit(0.0), lambda a, x: a + x)
    return F.struct(
        F.array_max(p).alias("confidence"),
        entropy_bits(p).alias("entropy_s1"),
        top.alias("top3_mass"),
        (entropy_bits(q) / (entropy_bits(p) + 1e-10)).alias("entropy_ratio"),
    )


def return_codes(bars: DataFrame) -> DataFrame:
    """Coarse and fine codes of each bar's return: 2 % and 0.5 % wide, 11 and 41 of them."""
    ret = F.coalesce(F.col("close") / floor(F.lag("close").over(by_bar())) - 1, F.lit(0.0))
    code = lambda width, most: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(F.col("ret") / F.lit(width))))
    return bars.withColumn("ret", ret).withColumn("code", code(0.02, 5)).withColumn("fine", code(0.005, 20))


def beliefs(bars: DataFrame, horizon: Horizon) -> DataFrame:
    """(ticker, bar_ix, s, h, belief columns) from how often return codes occurred in the last 6 (s + 1) + h bars."""
    longest = 6 * horizon.samples + horizon.pred_len - 1
    w = by_bar().rowsBetween(-(longest - 1), 0)
    coded = return_codes(bars).withColumn("codes", F.collect_list("code").over(w)).withColumn("fines", F.collect_list("fine").over(w))
    full = coded.filter(F.size("codes") == longest).select("ticker", "bar_ix", "codes", "fines")
    steps = F.explode(F.sequence(F.lit(0), F.lit(horizon.samples * horizon.pred_len - 1)))
    each = full.select("*", steps.alias("k")).withColumn("s", F.expr(f"k div {horizon.pred_len}").cast("int")).withColumn("h", (F.col("k") % horizon.pred_len).cast("int"))
    size = 6 * (F.col("s") + 1) + F.col("h")
    last = lambda c: F.slice(c, -size, size)
    return each.select("ticker", "bar_ix", "s", "h", belief_of(last(F.col("codes")), last(F.col("fines"))).alias("b")).select("ticker", "bar_ix", "s", "h", "b.*")


def confidence_per_sample(codes: Column, horizon: Horizon) -> Column:
    """Mean confidence of each sample, from a bar's list of return codes: what :func:`beliefs` averages to, without its rows."""

    def at(s: Column, h: Column) -> Column:
        size = 6 * (s + 1) + h
        return F.array_max(distribution(F.slice(codes, -size, size)))

    steps = F.sequence(F.lit(0), F.lit(horizon.pred_len - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(horizon.samples - 1)), lambda s: mean(F.transform(steps, lambda h: at(s, h))))


def nucleus(tokens: DataFrame, keys: list[str], p: float) -> DataFrame:
    """Rows of a token distribution (columns code, prob) that a nucleus of mass ``p`` keeps, renormalised."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(F.col("prob").desc(), "code")
    before = F.coalesce(F.sum("prob").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    kept = tokens.withColumn("before", before).filter(F.col("before") <= p).drop("before")
    return kept.withColumn("prob", F.col("prob") / F.sum("prob").over(W.partitionBy(*keys)))
