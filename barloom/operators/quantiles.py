"""Exact quantiles of whole columns without gathering a column in one task.

A first pass counts values in bins between a group's least and greatest value; the
counts tell in which bins the wanted ranks lie.  A second pass looks at the values of
those bins alone, equal ones counted together beforehand.  What meets in one task is the
bins of a group, then the distinct values of one bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BINS = 4096


def exact_quantiles(df: DataFrame, column: str, probabilities: list[float], keys: tuple[str, ...] = (), bins: int = BINS) -> DataFrame:
    """(keys, quantiles): per group an array of interpolated quantiles, as ``percentile`` gives them.

    Unknown values don't count, NaN is larger than any other; a group without values has no row.
    """
    k = [f"_k{n}" for n in range(len(keys))]
    rows = df.filter(F.col(column).isNotNull()).select(*[F.col(c).alias(a) for c, a in zip(keys, k, strict=True)], F.col(column).cast("double").alias("_x"))
    same = lambda other: [F.col(f"l.{a}").eqNullSafe(F.col(f"{other}.{a}")) for a in k] or [F.lit(True)]
    x = F.col("_x")
    finite = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    spans = rows.groupBy(*k).agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"), F.count("*").alias("_n"))

    def placed(of: DataFrame) -> DataFrame:
        width = F.col("_hi") - F.col("_lo")
        at = F.least(F.lit(bins - 1), F.floor(F.try_divide(x - F.col("_lo"), width) * bins))
        place = F.when(F.isnan(x), bins + 1).when(x == float("inf"), bins).when(x == float("-inf"), -1).otherwise(F.coalesce(F.greatest(F.lit(0), at), F.lit(0)))
        return of.withColumn("_bin", place.cast("int"))

    # Groups without keys are a single row here.
    with_span = rows.alias("l").join(F.broadcast(spans).alias("s"), same("s")).select("l.*", "_lo", "_hi") if k else rows.join(F.broadcast(spans.drop("_n")))
    binned = placed(with_span).select(*k, "_bin", "_x")
    counts = binned.groupBy(*k, "_bin").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*k).orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow))
    held = counts.withColumn("_upto", upto).withColumn("_before", F.col("_upto") - F.col("_c"))

    ps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probabilities)])
    wanted = spans.select(*k, "_n", F.explode(ps).alias("q")).withColumn("_place", F.col("q.p") * (F.col("_n") - 1))
    wanted = wanted.select(*k, F.col("q.i").alias("_i"), "_place", F.explode(F.array_distinct(F.array(F.floor("_place"), F.ceil("_place")))).alias("_rank"))
    found = wanted.alias("l").join(held.alias("h"), [*same("h"), F.col("_rank") >= F.col("_before"), F.col("_rank") < F.col("_upto")]).select("l.*", "_bin", "_before")
    needed = found.select(*k, "_bin", "_before").distinct()
    both = [*same("n"), F.col("l._bin") == F.col("n._bin")]
    values = binned.alias("l").join(F.broadcast(needed).alias("n"), both).select("l.*", "_before").groupBy(*k, "_bin", "_before", "_x").agg(F.count("*").alias("_c"))
    end = F.sum("_c").over(W.partitionBy(*k, "_bin").orderBy("_x").rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("_before")
    ranked = values.withColumn("_end", end)
    at = found.alias("l").join(ranked.alias("r"), [*same("r"), F.col("l._bin") == F.col("r._bin"), F.col("_rank") < F.col("_end"), F.col("_rank") >= F.col("_end") - F.col("_c")]).select("l.*", "_x")
    part = F.first("_place") - F.floor(F.first("_place"))
    low, high = F.min_by("_x", "_rank"), F.max_by("_x", "_rank")
    each = at.groupBy(*k, "_i").agg(F.when((part == 0) | (low == high), low).otherwise((1 - part) * low + part * high).alias("_q"))
    out = each.groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"]).alias("quantiles"))
    return out.select(*[F.col(a).alias(c) for c, a in zip(keys, k, strict=True)], "quantiles")


def deciles(df: DataFrame, column: str, name: str = "decile", n: int = 10) -> DataFrame:
    """``df`` with the number of inner edges of ``n`` equal parts that the value reaches, so equal values share a part."""
    edges = exact_quantiles(df, column, [j / n for j in range(1, n)]).withColumnRenamed("quantiles", "_edges")
    return df.join(F.broadcast(edges)).withColumn(name, _reached(F.col("_edges"), F.col(column))).drop("_edges")


def _reached(edges: Column, value: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e <= value))
