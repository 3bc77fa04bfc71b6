"""Drawing, stepwise generation and the bit codec, against plain loops."""

import collections
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from barloom.config import Horizon
from barloom.operators import forecast, generate

DIST = [(1, 0.4), (3, 0.25), (0, 0.15), (2, 0.15), (7, 0.05)]


def uniform(*keys):
    return int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:13], 16) / 16**13


def brute_ranked(weights):
    total = sum(w for _, w in sorted(weights, key=lambda x: (-x[1], x[0])))
    return sorted(((c, w / total) for c, w in weights), key=lambda x: (-x[1], x[0]))


def brute_draw(dist, u, t=1.0, k=0, p=1.0, sample=True):
    if t != 1.0:
        dist = brute_ranked([(c, q ** (1 / t)) for c, q in dist])
    if k:
        dist = [x for x in dist if x[1] >= dist[min(k, len(dist)) - 1][1]]
    elif p < 1.0:
        dist = [x for i, x in enumerate(dist) if i == 0 or sum(q for _, q in dist[:i]) <= p]
    if not sample:
        return dist[0][0]
    total, seen = sum(q for _, q in dist), 0.0
    for c, q in dist:
        seen += q
        if seen > u * total:
            return c
    return dist[-1][0]


@pytest.fixture(scope="module")
def rows(spark):
    d = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(p).alias("prob")) for c, p in DIST])
    return spark.range(20_000).withColumn("dist", generate.ranked(d)).withColumn("u", generate.uniform(F.col("id").cast("string"), F.lit("9")))


@pytest.mark.parametrize("how", [{}, {"temperature": 0.5}, {"temperature": 2.0, "p": 0.7}, {"k": 3}, {"k": 4}, {"k": 99}, {"p": 0.0}, {"p": 0.4}, {"sample": False}])
def test_draws(rows, how):
    plain = {"t": how.get("temperature", 1.0), **{k: v for k, v in how.items() if k != "temperature"}}
    got = [{r.id: r.code for r in rows.repartition(n).select("id", generate.draw(F.col("dist"), F.col("u"), **how).alias("code")).collect()} for n in (2, 7)]
    assert got[0] == got[1] == {i: brute_draw(DIST, uniform(i, 9), **plain) for i in range(20_000)}
    if how in ({}, {"k": 4}):  # codes 0 and 2 tie, so three are four
        kept = dict(DIST if not how else DIST[:4])
        n = collections.Counter(got[0].values())
        assert set(n) == set(kept) and all(abs(n[c] / 20_000 - q / sum(kept.values())) < 0.012 for c, q in kept.items())


def test_draw_from_little(spark):
    d = spark.createDataFrame([([],), ([(5, 0.0)],), ([(5, 2.0)],), (None,)], "d array<struct<code:int,prob:double>>")
    got = [r.c for r in d.select(generate.draw(generate.ranked(F.filter("d", lambda x: x["prob"] > 0)), F.lit(0.3), 0.7, 0, 0.5).alias("c")).collect()]
    assert got == [None, None, 5, None]
    assert generate.uniform("a", "b") is not None


def brute_paths(closes, ticker, steps, samples, lookback, seed, t, p):
    codes, fines = [], []
    for i, c in enumerate(closes):
        ret = c / closes[i - 1] - 1 if i else 0.0
        codes.append(max(-5, min(5, math.floor(ret / 0.02))))
        fines.append(max(-20, min(20, math.floor(ret / 0.005))))
    entropy = lambda d: -sum(q * math.log2(q) for _, q in d if q)
    out = {}
    for at in range(lookback - 1, len(closes)):
        for s in range(samples):
            cs, fs, close = codes[at - lookback + 1 : at + 1], fines[at - lookback + 1 : at + 1], closes[at]
            for h in range(steps):
                follow = collections.Counter(b for a, b in zip(cs, cs[1:]) if a == cs[-1])
                d1 = brute_ranked([(c, n + 4 * follow[c]) for c, n in collections.Counter(cs).items()])
                c = brute_draw(d1, uniform(ticker, at, s, seed + 1000 * h), t, 0, p)
                d2 = brute_ranked(list(collections.Counter(f for a, f in zip(cs, fs) if a == c).items()))
                f = brute_draw(d2, uniform(ticker, at, s, seed + 1000 * h + 1), t, 0, p)
                close *= 1 + (f + 0.5) * 0.005
                cs, fs = (cs + [c])[-lookback:], (fs + [f])[-lookback:]
                out[at, s, h] = (c, f, pytest.approx(close), pytest.approx(d1[0][1]), pytest.approx(entropy(d1), abs=1e-9), pytest.approx(sum(q for _, q in d1[:3])), pytest.approx(entropy(d2) / (entropy(d1) + 1e-8), abs=1e-6))
    return out


def test_paths_by_brute_force(spark, make_bars):
    closes = [100 + 5 * math.sin(i * 1.7) + (i * 7919 % 13) / 3 for i in range(40)]
    bars = make_bars([(c, c, c, c) for c in closes]).select("ticker", "bar_ix", "close")
    contexts = generate.code_contexts(bars, 12)
    got = {}
    for parts in (1, 5):
        found = generate.generate(contexts.repartition(parts), 4, 3, 12, 7, 0.8, 0, 0.9)
        each = found.select("bar_ix", F.posexplode("generated").alias("s", "g")).select("bar_ix", "s", F.explode("g").alias("x")).select("bar_ix", "s", "x.*").collect()
        got[parts] = {(r.bar_ix, r.s, r.h): (r.code, r.fine, r.close, r.confidence, r.entropy_s1, r.top3_mass, r.entropy_ratio) for r in each}
    assert got[1] == got[5] == brute_paths(closes, "T", 4, 3, 12, 7, 0.8, 0.9)
    longer = generate.generate(contexts, 6, 5, 12, 7, 0.8, 0, 0.9).select("bar_ix", F.posexplode("generated").alias("s", "g")).select("bar_ix", "s", F.explode("g").alias("x")).select("bar_ix", "s", "x.*")
    assert {(r.bar_ix, r.s, r.h): r.close for r in longer.filter("s < 3 and h < 4").collect()} == {k: v[2] for k, v in got[1].items()}
    means = {(r.bar_ix, r.h): r.c for r in generate.generate(contexts, 4, 3, 12, 7, 0.8, 0, 0.9).select("bar_ix", F.posexplode(generate.mean_path(F.col("generated"))).alias("h", "c")).collect()}
    assert all(v == pytest.approx(sum(got[1][i, s, h][2] for s in range(3)) / 3) for (i, h), v in means.items())


def test_stepwise_is_a_forecaster(make_bars):
    bars = make_bars([(c, c, c, c) for c in (100 + i % 5 for i in range(20))])
    found = forecast.get_forecaster("stepwise").transform(bars, Horizon(lookback=10, pred_len=3, samples=2))
    rows = found.collect()
    assert len(rows) == 11 and all(len(r.paths) == 2 and len(r.paths[0]) == 3 for r in rows) and "codes" not in found.columns


def test_every_code_there_and_back(spark):
    ids = spark.range(1 << 20).select((F.col("id") % 1024).cast("int").alias("s1"), F.expr("int(id div 1024)").alias("s2"))
    back = ids.select("s1", "s2", generate.bits_to_ids(generate.ids_to_bits(F.col("s1"), F.col("s2"))).alias("b"))
    assert back.filter("b.s1 <> s1 or b.s2 <> s2 or b is null").count() == 0
    one = spark.range(1).select(generate.ids_to_bits(F.lit(1), F.lit(512)).alias("v")).first().v
    assert one == pytest.approx([(1 if i in (0, 19) else -1) / math.sqrt(20) for i in range(20)])


def test_nan_is_the_largest(spark):
    """Medians of all earlier values, as the built-in percentile has them."""
    from barloom.operators.expanding import Expanding, Quantile, expanding_quantiles

    nan = math.nan
    values = [1.0, 2.0, nan, 3.0, 0.5, 0.2, nan, nan, nan, 4.0, None, nan, nan]
    df = spark.createDataFrame([("T", i, v) for i, v in enumerate(values)], "ticker string, w bigint, x double")
    for p in (0.1, 0.5, 0.9):
        got = [r.q for r in expanding_quantiles(df, [Expanding("x", p, "q")]).orderBy("w").collect()]
        for i, q in enumerate(got):
            want = df.filter(F.col("w") < i).agg(F.percentile("x", p)).first()[0]
            assert (q is None and want is None) or q == pytest.approx(want, nan_ok=True), (p, i)
    q = Quantile(0.5)
    q.add(nan)
    assert math.isnan(q.value())


def test_nothing_is_entered_at_nought(spark, make_bars):
    """Prices of 0 give no window, no return and no sample, and stop nothing."""
    from barloom.operators import evaluation, simulate, windows

    h = Horizon(lookback=4, pred_len=2, samples=2)
    closes = [1, 2, 3, 0, 0, 2, 3, 4, 5, 6, 7, 8]
    bars = forecast.get_forecaster("analog").transform(make_bars([(c, c, c, c) for c in closes]), h)
    found = evaluation.evaluate_windows(windows.sliding_windows(bars, h)).collect()
    assert {r.w + 3 for r in found} == set(range(3, 10)) - {3, 4}
    empty = F.array(F.struct(*[F.lit(1.0).alias(c) for c in ("open", "high", "low", "close")]))
    bound = F.array(F.struct(*[F.lit(None).cast("double").alias(c) for c in ("sl_long", "sl_short", "tp_long", "tp_short")]))
    assert spark.range(1).select(simulate.stepwise_trade(F.lit(1), F.lit(0.0), empty, bound).alias("t")).first().t.ret is None
