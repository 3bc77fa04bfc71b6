"""Drawing codes and generating paths step by step.

A distribution is an array of (code, prob), the most probable first, ties by code.
Random numbers come from a counter: a hash of the row's keys, the step and the seed.
So a draw depends on nothing else, and partitions, batches and retries don't change it.

:func:`generate` is a fold over the steps of a forecast: a state holds the last codes
of each path, a step draws the coarse code from what followed the last one in them,
then the fine code given the coarse one, and appends both.  It is narrow, and runs as
expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from barloom.config import Horizon
from barloom.operators import forecast
from barloom.sources.bars import by_bar

# How much more a code counts that followed the last one than one that is just there.
FOLLOWED = 4.0
FINE_WIDTH = 0.005
_DISTRIBUTION = "array<struct<code:int,prob:double>>"
_STEP = "array<struct<h:int,code:int,fine:int,close:double,confidence:double,entropy_s1:double,top3_mass:double,entropy_ratio:double>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def uniform(*keys: Column | str) -> Column:
    """A number in [0, 1) from a hash of the keys."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *keys).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def ranked(weights: Column) -> Column:
    """A distribution from an array of (code, prob) in any order and of any sum."""
    turned = F.array_sort(F.transform(weights, lambda x: F.struct((-x["prob"].cast("double")).alias("less"), x["code"].cast("int").alias("code"))))
    return let(turned, lambda t: let(_sum(F.transform(t, lambda x: -x["less"])), lambda n: F.transform(t, lambda x: F.struct(x["code"].alias("code"), (-x["less"] / n).alias("prob")))))


def tempered(dist: Column, temperature: Column | float) -> Column:
    """Probabilities to the power of 1 / temperature: logits divided by it."""
    t = F.lit(float(temperature)) if not isinstance(temperature, Column) else temperature
    return ranked(F.transform(dist, lambda x: F.struct(x["code"].alias("code"), F.pow(x["prob"], 1.0 / t).alias("prob"))))


def top_k(dist: Column, k: int) -> Column:
    """The ``k`` most probable codes, with all that tie with the last of them."""
    return F.filter(dist, lambda x: x["prob"] >= F.element_at(dist, F.least(F.lit(k), F.size(dist)))["prob"])


def top_p(dist: Column, p: Column | float) -> Column:
    """The codes before which the mass is at most ``p``; the first always stays."""
    p = F.lit(float(p)) if not isinstance(p, Column) else p
    return F.filter(dist, lambda x, i: (i == 0) | (_sum(F.transform(F.slice(dist, 1, i), lambda y: y["prob"])) <= p))


def filtered(dist: Column, temperature: Column | float = 1.0, k: int = 0, p: Column | float = 1.0) -> Column:
    """Tempered, then cut to the top ``k`` if there is a ``k``, else to the nucleus of mass ``p``; not renormalised."""
    if isinstance(temperature, Column) or temperature != 1.0:
        dist = tempered(dist, temperature)
    if k > 0:
        return let(dist, lambda d: top_k(d, k))
    return let(dist, lambda d: top_p(d, p)) if isinstance(p, Column) or p < 1.0 else dist


def draw(dist: Column, u: Column, temperature: Column | float = 1.0, k: int = 0, p: Column | float = 1.0, sample: bool = True) -> Column:
    """The code at which the running sums of the filtered distribution pass ``u`` of their total; without ``sample`` the most probable.

    Null for an empty distribution.
    """
    kept = filtered(dist, temperature, k, p)
    if not sample:
        return F.try_element_at(kept, F.lit(1))["code"]

    def pick(d: Column) -> Column:
        mass = F.transform(d, lambda x: x["prob"])
        passed = lambda n: F.filter(d, lambda x, i: _sum(F.slice(mass, 1, i + 1)) > u * n)
        return let(_sum(mass), lambda n: F.coalesce(F.try_element_at(passed(n), F.lit(1)), F.try_element_at(d, F.lit(-1)))["code"])

    return let(kept, pick)


def next_codes(codes: Column) -> Column:
    """What may follow the last of some codes: all that are among them, more so if they have followed it before."""
    last, n = F.element_at(codes, -1), F.size(codes)
    pairs = F.zip_with(F.slice(codes, 1, n - 1), F.slice(codes, 2, n), lambda a, b: F.when(a == last, b))
    count = lambda values, c: F.size(F.filter(values, lambda x: x == c))
    return let(pairs, lambda after: ranked(F.transform(F.array_distinct(codes), lambda c: F.struct(c.alias("code"), (count(codes, c) + FOLLOWED * count(after, c)).alias("prob")))))


def fine_codes(codes: Column, fines: Column, code: Column) -> Column:
    """Fine codes that some places with this coarse code have."""
    own = F.filter(F.zip_with(codes, fines, lambda a, b: F.when(a == code, b)), lambda x: x.isNotNull())
    return let(own, lambda f: ranked(F.transform(F.array_distinct(f), lambda c: F.struct(c.alias("code"), F.size(F.filter(f, lambda x: x == c)).cast("double").alias("prob")))))


def _entropy(dist: Column) -> Column:
    return forecast.entropy_bits(F.transform(dist, lambda x: x["prob"]))


def generate(
    contexts: DataFrame,
    steps: int,
    samples: int,
    max_context: int,
    seed: int = 42,
    temperature: Column | float = 1.0,
    k: int = 0,
    p: Column | float = 0.9,
    keys: tuple[str, ...] = ("ticker", "bar_ix"),
) -> DataFrame:
    """``contexts`` (codes, fines, close, the keys) with ``generated``: per sample the drawn steps.

    A step has its codes, the close they lead to, and the beliefs of the unfiltered
    distributions it was drawn from.  Step i takes the seeds ``seed + 1000 i`` and one
    more; a longer or wider run begins like a shorter or narrower one.
    """

    def path(s: Column) -> Column:
        number = lambda h, more: uniform(*keys, s.cast("string"), (F.lit(seed + more) + 1000 * h).cast("string"))
        slid = lambda values, new: let(F.concat(values, F.array(new)), lambda a: F.when(F.size(a) > max_context, F.slice(a, -max_context, max_context)).otherwise(a))

        def step(acc: Column, h: Column) -> Column:
            def with_coarse(d1: Column) -> Column:
                def with_code(c: Column) -> Column:
                    def with_fine(d2: Column) -> Column:
                        def grown(f: Column) -> Column:
                            close = acc["close"] * (1.0 + (f + 0.5) * FINE_WIDTH)
                            e1 = _entropy(d1)
                            new = F.struct(
                                h.alias("h"),
                                c.alias("code"),
                                f.alias("fine"),
                                close.alias("close"),
                                d1[0]["prob"].alias("confidence"),
                                e1.alias("entropy_s1"),
                                _sum(F.transform(F.slice(d1, 1, 3), lambda x: x["prob"])).alias("top3_mass"),
                                (_entropy(d2) / (e1 + 1e-8)).alias("entropy_ratio"),
                            )
                            return F.struct(slid(acc["codes"], c).alias("codes"), slid(acc["fines"], f).alias("fines"), close.alias("close"), F.concat(acc["out"], F.array(new)).alias("out"))

                        return let(draw(d2, number(h, 1), temperature, k, p), grown)

                    return let(fine_codes(acc["codes"], acc["fines"], c), with_fine)

                return let(draw(d1, number(h, 0), temperature, k, p), with_code)

            return let(next_codes(acc["codes"]), with_coarse)

        begin = F.struct(
            F.slice("codes", -F.least(F.size("codes"), F.lit(max_context)), max_context).cast("array<int>").alias("codes"),
            F.slice("fines", -F.least(F.size("fines"), F.lit(max_context)), max_context).cast("array<int>").alias("fines"),
            F.col("close").cast("double").alias("close"),
            F.array().cast(_STEP).alias("out"),
        )
        return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), begin, step, lambda acc: acc["out"])

    return contexts.withColumn("generated", F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), path))


def code_contexts(bars: DataFrame, lookback: int) -> DataFrame:
    """Bars with at least ``lookback`` bars, and the codes of those."""
    w = by_bar().rowsBetween(-(lookback - 1), 0)
    coded = forecast.return_codes(bars)
    listed = coded.withColumn("codes", F.collect_list(F.col("code").cast("int")).over(w)).withColumn("fines", F.collect_list(F.col("fine").cast("int")).over(w))
    return listed.filter(F.size("codes") == lookback).drop("ret", "code", "fine")


def paths_of(generated: Column) -> Column:
    """The closes of each sample."""
    return F.transform(generated, lambda g: F.transform(g, lambda x: x["close"]))


def mean_path(generated: Column) -> Column:
    """The mean close of each step over the samples."""
    steps = F.sequence(F.lit(1), F.size(F.element_at(generated, 1)))
    return F.transform(steps, lambda h: forecast.mean(F.transform(generated, lambda g: F.element_at(g, h)["close"])))


@forecast.register_forecaster("stepwise")
class StepwiseForecaster(forecast.Forecaster):
    """Paths drawn code by code from each bar's own context; no model and no weights."""

    def __init__(self, seed: int = 42, temperature: float = 1.0, k: int = 0, p: float = 0.9):
        self.seed, self.temperature, self.k, self.p = seed, temperature, k, p

    def transform(self, df: DataFrame, horizon: Horizon) -> DataFrame:
        contexts = code_contexts(df, horizon.lookback)
        found = generate(contexts, horizon.pred_len, horizon.samples, horizon.lookback, self.seed, self.temperature, self.k, self.p)
        return found.withColumn("paths", paths_of(F.col("generated"))).drop("codes", "fines", "generated")


# The codec of coarse and fine ids: a bit for the sign of each feature, packed lowest first.
S1_BITS, S2_BITS = 10, 10


def bits_to_ids(features: Column) -> Column:
    """struct(s1, s2) of ``S1_BITS + S2_BITS`` features: a bit is set where a feature is above 0."""

    def packed(begin: int, n: int) -> Column:
        bits = F.slice(features, begin + 1, n)
        return F.aggregate(F.transform(bits, lambda x, i: F.when(x > 0, F.pow(F.lit(2.0), i)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x).cast("int")

    return F.struct(packed(0, S1_BITS).alias("s1"), packed(S1_BITS, S2_BITS).alias("s2"))


def ids_to_bits(s1: Column, s2: Column) -> Column:
    """Features of two ids, 1 or -1 over the root of their number."""
    scale = (S1_BITS + S2_BITS) ** -0.5
    value = lambda id_, i: F.when(F.getbit(id_, i) == 1, scale).otherwise(-scale)
    unpacked = lambda id_, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: value(id_, i))
    return F.concat(unpacked(s1, S1_BITS), unpacked(s2, S2_BITS))
