"""Summaries of sample paths, as expressions over ``paths`` and a reference price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barloom.operators.forecast import at_step, last_step, mean, quantile, std_pop
from barloom.operators.rolling import clip, floor


def per_step(paths: Column, f) -> Column:
    """Array over steps of ``f(values across samples)``."""
    steps = F.sequence(F.lit(1), F.size(paths[0]))
    return F.transform(steps, lambda h: f(at_step(paths, h)))


def share(values: Column, test) -> Column:
    return F.size(F.filter(values, test)) / F.size(values)


def consensus(paths: Column, price: Column, threshold: float = 0.8) -> Column:
    """Per step (up, down, has, dir, strength)."""

    def verdict(values: Column) -> Column:
        up, down = share(values, lambda x: x > price), share(values, lambda x: x < price)
        side = F.when(up >= threshold, 1).when(down >= threshold, -1).otherwise(0)
        return F.struct(up.alias("up"), down.alias("down"), (side != 0).alias("has"), side.alias("dir"), F.greatest(up, down).alias("strength"))

    return per_step(paths, verdict)


def boundaries(paths: Column, price: Column, tp_q: float = 0.8, sl_q: float = 0.2) -> Column:
    """Per step (tp_long, sl_long, tp_short, sl_short); null disables a level."""

    def levels(values: Column) -> Column:
        hi, lo = quantile(values, tp_q), quantile(values, sl_q)
        above, below = F.when(hi > price, hi), F.when(lo < price, lo)
        return F.struct(above.alias("tp_long"), below.alias("sl_long"), below.alias("tp_short"), above.alias("sl_short"))

    return per_step(paths, levels)


def dispersion(paths: Column, price: Column) -> Column:
    """(per-step deviation of returns, their mean, relative spread per step)."""
    std = per_step(paths, lambda v: std_pop(F.transform(v, lambda x: (x - price) / price)))
    spread = per_step(paths, lambda v: (F.array_max(v) - F.array_min(v)) / price)
    return F.struct(std.alias("std"), mean(std).alias("mean_std"), spread.alias("spread"))


def trend_strength(paths: Column, price: Column) -> Column:
    last = last_step(paths)
    return F.struct(F.abs(mean(F.transform(last, lambda x: F.signum(x - price)))).alias("strength"), mean(F.transform(last, lambda x: (x - price) / price)).alias("mean_ret"))


def linearity(paths: Column) -> Column:
    """Mean R² of the paths against their steps; a flat path counts as 1."""

    def r2(path: Column) -> Column:
        n = F.size(path)
        mx, my = (n - 1) / 2.0, mean(path)
        sxy = F.aggregate(F.transform(path, lambda y, i: (i - mx) * (y - my)), F.lit(0.0), lambda a, x: a + x)
        sxx = F.aggregate(F.transform(path, lambda y, i: (i - mx) * (i - mx)), F.lit(0.0), lambda a, x: a + x)
        syy = F.aggregate(F.transform(path, lambda y: (y - my) ** 2), F.lit(0.0), lambda a, x: a + x)
        return 1.0 - F.greatest(syy - sxy * sxy / sxx, F.lit(0.0)) / floor(syy)

    return mean(F.transform(paths, r2))


def asymmetry(paths: Column, price: Column) -> Column:
    """Mean return, mean rise, mean fall, their ratio and direction at the last step."""
    rets = F.transform(last_step(paths), lambda x: (x - price) / price)
    ups, downs = F.filter(rets, lambda x: x > 0), F.transform(F.filter(rets, lambda x: x < 0), lambda x: -x)
    up, down = F.when(F.size(ups) > 0, mean(ups)).otherwise(F.lit(0.0)), F.when(F.size(downs) > 0, mean(downs)).otherwise(F.lit(0.0))
    return F.struct(mean(rets).alias("mean_ret"), up.alias("up"), down.alias("down"), (up / floor(down)).alias("ratio"), F.when(mean(rets) > 0, 1).otherwise(-1).alias("dir"))


def expectancy(paths: Column, price: Column) -> Column:
    """Mean over steps of mean return over its deviation."""
    return mean(per_step(paths, lambda v: mean(F.transform(v, lambda x: (x - price) / price)) / (std_pop(F.transform(v, lambda x: (x - price) / price)) + 1e-10)))


def agreement(paths: Column, price: Column) -> Column:
    return F.abs(F.aggregate(last_step(paths), F.lit(0.0), lambda a, x: a + F.signum(x - price)))


def weighted_quantile(values: Column, weights: Column, q: float) -> Column:
    """Interpolated at the midpoints of the cumulated weights (sorted by value), clamped at the ends."""
    pairs = F.array_sort(F.zip_with(values, weights, lambda v, w: F.struct(v.alias("v"), w.alias("w"))))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<struct<v:double,at:double>>").alias("out"))
    points = F.aggregate(
        pairs,
        start,
        lambda a, p: F.struct((a["sum"] + p["w"]).alias("sum"), F.concat(a["out"], F.array(F.struct(p["v"].alias("v"), (a["sum"] + p["w"] / 2).alias("at")))).alias("out")),
        lambda a: a["out"],
    )
    lo, hi = F.try_element_at(F.filter(points, lambda p: p["at"] <= q), F.lit(-1)), F.try_element_at(F.filter(points, lambda p: p["at"] > q), F.lit(1))
    inner = lo["v"] + (hi["v"] - lo["v"]) * (q - lo["at"]) / F.greatest(hi["at"] - lo["at"], F.lit(1e-300))
    return F.when(lo.isNull(), hi["v"]).when(hi.isNull(), lo["v"]).otherwise(inner)


def normalised(weights: Column) -> Column:
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x) + 1e-8
    return F.transform(weights, lambda w: w / total)


def weighted_mean(values: Column, weights: Column) -> Column:
    return F.aggregate(F.zip_with(values, weights, lambda v, w: v * w), F.lit(0.0), lambda a, x: a + x)


def best_sample(values: Column, confidence: Column) -> Column:
    """Value of the most confident sample; the first of equals."""
    return F.element_at(values, F.array_position(confidence, F.array_max(confidence)).cast("int"))


def confident_mean(values: Column, confidence: Column, least: float) -> Column:
    """Mean over samples with confidence above ``least``, or over all if there are none."""
    kept = F.transform(F.filter(F.zip_with(values, confidence, lambda v, c: F.struct(v.alias("v"), c.alias("c"))), lambda p: p["c"] > least), lambda p: p["v"])
    return F.when(F.size(kept) > 0, mean(kept)).otherwise(mean(values))


def belief_weight(beliefs: DataFrame, keys: list[str], weight: float = 1.0, penalty: float = 0.3, exit_factor: float = 1.5) -> DataFrame:
    """belief_score in [0, 2] and early_exit per key, from long beliefs (s, h and the four channels)."""
    last = beliefs.groupBy(*keys).agg(F.max("h").alias("last_h"))
    b = beliefs.join(last, keys)
    steps = b.groupBy(*keys).agg(
        F.avg(F.when((F.col("h") == 0) & (F.col("s") < 3), F.col("confidence"))).alias("conf_init"),
        F.avg(F.when(F.col("h") < 2, F.col("entropy_s1"))).alias("ent_init"),
        F.avg(F.when(F.col("h") == F.col("last_h"), F.col("entropy_s1"))).alias("ent_term"),
        F.avg(F.when(F.col("h") == F.col("last_h"), F.col("top3_mass"))).alias("top3_term"),
        F.abs(F.avg("entropy_ratio") - 1.0).alias("ratio_dev"),
    )
    cost = clip(F.col("ent_term") / 10.0, 0.0, 1.0) * penalty
    score = F.col("conf_init") * (1.0 - cost) * clip(F.col("top3_term") / 0.5, 0.5, 1.5)
    growth = F.col("ent_term") - F.col("ent_init")
    early = (growth > F.greatest(F.col("ent_init") * exit_factor, F.lit(1.5))) | ((F.col("ratio_dev") > 0.5) & (growth > 1.0))
    return steps.withColumn("belief_score", clip(score * 2.0 * weight, 0.0, 2.0)).withColumn("early_exit", early)
