"""Trades by hand: who wins in a bar, overlaps, disabled levels."""

import pytest
from pyspark.sql import functions as F

from barloom.operators import atoms, signals, simulate


def trade(spark, sig, entry, tp, sl, horizon):
    df = spark.createDataFrame([(sig, float(entry), tp, sl, [tuple(map(float, b)) for b in horizon])], "sig int, entry double, tp double, sl double, horizon array<struct<open:double,high:double,low:double,close:double>>")
    x = df.select(simulate.first_hit(F.col("sig"), F.col("entry"), F.col("tp"), F.col("sl"), F.col("horizon")).alias("x")).first().x
    return x.reason, round(x.ret, 6), x.holding


def test_stop_wins_within_a_bar(spark):
    assert trade(spark, 1, 100, 101.5, 99.0, [(100, 101, 99.5, 100), (100, 102, 98.5, 100)]) == ("sl", -0.01, 2)


def test_target_then_close(spark):
    assert trade(spark, -1, 100, 98.0, None, [(100, 101, 99, 100), (100, 100, 97, 98)]) == ("tp", 0.02, 2)
    assert trade(spark, 1, 100, None, None, [(100, 101, 99, 100), (100, 100, 97, 103)]) == ("close", 0.03, 2)


def test_overlaps_share_and_zero_returns_drop(spark, make_bars):
    bars = make_bars([(1, 1, 1, 1)] * 6)
    rows = [("S", "T", 0, 0.02, 2), ("S", "T", 1, 0.06, 2), ("S", "T", 2, 0.0, 1)]
    trades = spark.createDataFrame(rows, "strategy string, ticker string, pos bigint, ret double, holding int")
    got = {r.bar_ix: round(r.ret, 6) for r in simulate.per_bar(trades, bars, ["S", "never"]).collect()}
    assert got == {0: 0.0, 1: 0.01, 2: 0.02, 3: 0.03, 4: 0.0, 5: 0.0}


@pytest.fixture(scope="module")
def paths(spark):
    df = spark.createDataFrame([([[101.0], [102.0], [103.0], [104.0], [99.0]], [[101.0], [102.0], [103.0], [104.0], [105.0]])], "a array<array<double>>, b array<array<double>>")
    price = F.lit(100.0)
    return df.select(
        atoms.consensus(F.col("a"), price)[0].alias("ca"), atoms.boundaries(F.col("b"), price)[0].alias("bb"), atoms.agreement(F.col("a"), price).alias("agree")
    ).first()


def test_consensus_at_four_of_five(paths):
    assert paths.ca.has and paths.ca.dir == 1 and paths.ca.up == 0.8 and paths.agree == 3.0


def test_levels_on_one_side_only(paths):
    assert paths.bb.sl_long is None and paths.bb.tp_short is None and paths.bb.tp_long == paths.bb.sl_short == pytest.approx(104.2)


def test_weighted_quantile_clamps(spark):
    df = spark.range(1).select(F.array(*map(F.lit, (3.0, 1.0, 2.0))).alias("v"), F.array(*map(F.lit, (0.5, 0.2, 0.3))).alias("w"))
    got = df.select(*[atoms.weighted_quantile(F.col("v"), F.col("w"), q).alias(f"q{k}") for k, q in enumerate((0.0, 0.1, 0.35, 0.55, 0.99))]).first()
    assert [round(x, 6) for x in got] == [1.0, 1.0, 2.0, 2.5, 3.0]


def test_flat_paths_are_linear(spark):
    df = spark.createDataFrame([([[5.0, 5.0, 5.0], [1.0, 2.0, 3.0]],)], "p array<array<double>>")
    assert df.select(atoms.linearity(F.col("p"))).first()[0] == 1.0


def test_stepwise_order(spark):
    bar = "struct<open:double,high:double,low:double,close:double>"
    level = "struct<tp_long:double,sl_long:double,tp_short:double,sl_short:double>"
    df = spark.createDataFrame([([(1.0, 1.0, 1.0, 1.0), (1.0, 3.0, 0.5, 2.0)], [(2.0, 0.9, None, None), (2.5, 0.6, None, None)])], f"h array<{bar}>, b array<{level}>")
    x = df.select(simulate.stepwise_trade(F.lit(1), F.lit(1.0), F.col("h"), F.col("b")).alias("x"), simulate.stepwise_trade(F.lit(1), F.lit(1.0), F.col("h"), F.col("b"), skip_first=2).alias("y")).first()
    assert (x.x.reason, x.x.step, round(x.x.ret, 6)) == ("sl", 1, -0.4) and (x.y.reason, x.y.ret) == ("close", 1.0)


def test_win_rate_looks_ahead_only_when_asked(spark):
    rows = [("T", w, 1, w >= 3) for w in range(6)]
    df = spark.createDataFrame(rows, "ticker string, w bigint, sig int, won boolean")
    ahead = [r.win_rate_ok for r in simulate.rolling_win_rate(df, 50).orderBy("w").collect()]
    causal = [r.win_rate_ok for r in simulate.rolling_win_rate(df, 50, causal=True, pred_len=2).orderBy("w").collect()]
    assert ahead == [False, False, False, False, False, True] and causal == [True, True, False, False, False, False]


def test_expanding_bounds_branches(spark):
    import numpy as np

    values = np.random.default_rng(1).normal(size=102)
    df = spark.createDataFrame([("T", k, float(v)) for k, v in enumerate(values)], "ticker string, w bigint, x double")
    got = signals.expanding_bounds(df, "x", "q").orderBy("w").toPandas()
    assert got.q_hi[10] == 0.001 and got.q_lo[10] == -0.001
    for w, seen in ((11, 12), (99, 100), (100, 100), (101, 101)):
        assert got.q_hi[w] == pytest.approx(np.quantile(values[:seen], 0.9)) and got.q_lo[w] == pytest.approx(np.quantile(values[:seen], 0.1))


def test_metrics_without_idle_bars(spark, make_bars):
    """The same as from a row for every bar, also where the first bar is held or all is lost."""
    import random

    from barloom.operators import reports

    rng = random.Random(6)
    bars = make_bars([(1, 1, 1, 1)] * 60).unionByName(make_bars([(1, 1, 1, 1)] * 20, ticker="U"))
    rows = [("S", "T", k, 1 + k % 3, rng.uniform(-0.03, 0.03)) for k in range(3, 50, 2)] + [("S", "U", -1, 2, -0.1), ("S", "U", 4, 1, 0.05), ("down", "T", 5, 2, -0.2), ("one", "U", 7, 1, 0.01), ("none", "U", 3, 2, 0.0), ("late", "T", 30, 4, 0.3), ("late", "T", 40, 4, -0.3)]
    trades = spark.createDataFrame(rows, "strategy string, ticker string, pos long, holding int, ret double")
    for commission in (0.0, 0.001):
        dense = reports.strategy_metrics(simulate.per_bar(trades, bars, ["S", "down", "one", "none", "late"], commission), trials=5)
        sparse = reports.trade_metrics(trades, bars, commission, trials=5)
        assert set(sparse.columns) == set(dense.columns)
        want, got = ({(r.strategy, r.ticker): r.asDict() for r in df.collect()} for df in (dense, sparse))
        assert got.keys() == want.keys() and len(want) == 5
        for key, row in want.items():
            for c, v in row.items():
                assert got[key][c] == (v if isinstance(v, str) else pytest.approx(v, rel=1e-6, abs=1e-9)), (key, c)


@pytest.mark.parametrize("bins", [1, 3, 4096])
def test_quantiles_are_those_of_percentile(spark, bins):
    import math
    import random

    from barloom.operators.quantiles import deciles, exact_quantiles

    rng = random.Random(7)
    values = {"a": [rng.gauss(0, 1) for _ in range(300)], "b": [2.5] * 40, "c": [1.0], "d": [math.nan, 1.0, math.inf, -math.inf, 2.0, 3.0, math.nan], None: [1e300, -1e300, 0.0, 1e-300, 5.0] * 3, "e": [None, None], "f": [rng.choice([1.0, 2.0, 7.0]) for _ in range(100)]}
    d = spark.createDataFrame([(k, v) for k, own in values.items() for v in own], "k string, x double").repartition(5)
    ps = [0.0, 0.05, 0.5, 0.77, 1.0]
    want = {r.k: r.q for r in d.filter("x is not null").groupBy("k").agg(F.percentile("x", F.array(*map(F.lit, ps))).alias("q")).collect()}
    got = {r.k: r.quantiles for r in exact_quantiles(d, "x", ps, ("k",), bins).collect()}
    assert got.keys() == want.keys()
    for k, q in want.items():
        assert got[k] == pytest.approx(q, rel=1e-12, nan_ok=True), k
    a = d.filter("k = 'a'")
    assert exact_quantiles(a, "x", [0.3], bins=bins).first().quantiles == pytest.approx([a.agg(F.percentile("x", 0.3)).first()[0]])
    assert exact_quantiles(d.limit(0), "x", [0.3], ("k",), bins).count() == 0
    n = {r.decile: r["count"] for r in deciles(a, "x").groupBy("decile").count().collect()}
    assert n == dict.fromkeys(range(10), 30)
    assert [r.decile for r in deciles(d.filter("k = 'b'"), "x").distinct().collect()] == [9]
