"""Parameter grids, calibration and seeded choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from barloom.config import Horizon
from barloom.operators import evaluation, generate, windows


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """All combinations of the given values, one column each (a small dimension)."""
    dims = [spark.createDataFrame([(v,) for v in vs], [name]) for name, vs in values.items()]
    return reduce(lambda a, b: a.crossJoin(b), dims)


def merged_params(defaults: Column, fixed: Column, override: Column) -> Column:
    """Maps merged, the last wins."""
    keys = F.array_distinct(F.concat(F.map_keys(defaults), F.map_keys(fixed), F.map_keys(override)))
    pick = lambda k: F.coalesce(F.try_element_at(override, k), F.try_element_at(fixed, k), F.try_element_at(defaults, k))
    return F.map_from_arrays(keys, F.transform(keys, pick))


def best_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def calibrate(scores: DataFrame, params: list[str], by: list[str]) -> DataFrame:
    """Mean scores per parameter set over the windows where they are known, and whether the set is best by ``by``."""
    means = scores.groupBy(*params).agg(*[F.avg(F.nanvl(F.col(c), F.lit(None))).alias(c) for c in by], F.count("*").alias("n"))
    rank = F.row_number().over(W.orderBy(*[F.col(c).desc_nulls_last() for c in by], *params))
    return means.withColumn("is_best", rank == 1)


def windows_per_ticker(df: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` windows of each ticker (column ``w``) by a seeded hash, as many as there are at most."""
    order = F.md5(F.concat_ws(":", "ticker", "w", F.lit(str(seed))).cast("binary"))
    return df.withColumn("_rank", F.row_number().over(W.partitionBy("ticker").orderBy(order, "w"))).filter(F.col("_rank") <= n).drop("_rank")


_SCORES = ("consensus_dir_acc", "expectancy", "direction_accuracy", "consensus_rate")


def two_pass(
    bars: DataFrame,
    lookback: int,
    pred_lens: list[int],
    temperatures: list[float],
    top_ps: list[float],
    sample_counts: list[int],
    n_windows: int = 50,
    seed: int = 42,
    fixed: tuple[float, float, int] = (1.0, 0.9, 5),
) -> DataFrame:
    """Calibration in two passes: (pass, ticker, pred_len, temperature, top_p, samples, n, the scores, is_best).

    Pass 1 tries the forecast lengths with the ``fixed`` temperature, nucleus and samples.
    Pass 2 tries all combinations of those with each ticker's best length, which it gets
    by a join.  Both score the same windows, those that the longest forecast fits, by
    consensus_dir_acc, then expectancy.  A draw depends on the window, the step and the
    sample alone, so a shorter or narrower forecast is a part of a longer one, and is
    generated once.
    """
    longest, most = max(pred_lens), max(*sample_counts, fixed[2])
    whole = windows.sliding_windows(generate.code_contexts(bars, lookback), Horizon(lookback, longest, most))
    chosen = windows_per_ticker(whole, n_windows, seed)
    window = ("ticker", "w", "month", "bar_ix", "close", "codes", "fines", "entry_close", "horizon")
    params = ("pred_len", "temperature", "top_p", "samples")

    def scored(rows: DataFrame) -> DataFrame:
        cut = rows.withColumn("paths", F.transform(F.slice("paths", 1, F.col("samples")), lambda p: F.slice(p, 1, F.col("pred_len")))).withColumn("horizon", F.slice("horizon", 1, F.col("pred_len")))
        found = evaluation.evaluate_windows(cut, params)
        mean = lambda c: F.avg(F.nanvl(F.col(c), F.lit(None).cast("double"))).alias(c)
        means = found.groupBy("ticker", *params).agg(F.count("*").alias("n"), *map(mean, _SCORES))
        # Rounded, so that scores that differ in the last bits only are ties.
        order = [F.round(c, 9).desc_nulls_last() for c in _SCORES[:2]]
        return means.withColumn("is_best", F.row_number().over(W.partitionBy("ticker").orderBy(*order, *params)) == 1)

    def drawn(rows: DataFrame, samples: int, t: Column | float, p: Column | float) -> DataFrame:
        return generate.generate(rows, longest, samples, lookback, seed, t, 0, p).withColumn("paths", generate.paths_of(F.col("generated")))

    one = drawn(chosen.select(*window), fixed[2], fixed[0], fixed[1])
    lengths = F.explode(F.array(*map(F.lit, pred_lens))).alias("pred_len")
    first = scored(one.select("*", lengths, F.lit(fixed[0]).alias("temperature"), F.lit(fixed[1]).alias("top_p"), F.lit(fixed[2]).alias("samples")))

    cells = F.array(*[F.struct(F.lit(t).alias("temperature"), F.lit(p).alias("top_p")) for t in temperatures for p in top_ps])
    tried = chosen.select(*window, F.explode(cells).alias("cell")).select(*window, "cell.*")
    many = drawn(tried, max(sample_counts), F.col("temperature"), F.col("top_p"))
    lengths = first.filter("is_best").select("ticker", "pred_len")
    second = scored(many.join(lengths, "ticker").withColumn("samples", F.explode(F.array(*map(F.lit, sample_counts)))))
    return first.withColumn("pass", F.lit(1)).unionByName(second.withColumn("pass", F.lit(2))).select("pass", "ticker", *params, "n", *_SCORES, "is_best")


def sample_windows(df: DataFrame, n: int, seed: int, keys: tuple[str, ...] = ("ticker", "w")) -> DataFrame:
    """``n`` windows chosen without replacement by a seeded hash, in order: reruns agree on any cluster."""
    return df.orderBy(F.md5(F.concat_ws(":", *keys, F.lit(str(seed))).cast("binary")), *keys).limit(n).orderBy(*keys)
