"""Indicators and patterns against scalar restatements, by hand, and for look-ahead."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from barloom.operators import asof, expanding, patterns, recursive, rolling
from barloom.sources import bars as source


def random_rows(n, seed=1):
    rng, price, out = random.Random(seed), 100.0, []
    for _ in range(n):
        o, c = price, price * (1 + rng.uniform(-0.02, 0.02))
        out.append((o, max(o, c) * (1 + rng.uniform(0, 0.01)), min(o, c) * (1 - rng.uniform(0, 0.01)), c, rng.randint(1, 9)))
        price = c
    return out


def column(df, name):
    return [r[name] for r in df.orderBy("bar_ix").collect()]


def test_rsi_resets_and_needs_a_full_session(make_bars):
    rows = random_rows(14)
    got = column(recursive.wilder_rsi(make_bars(rows), 5), "rsi")  # nine bars, then five
    closes = [r[3] for r in rows[:9]]
    moves = [b - a for a, b in zip(closes, closes[1:])]
    gain, loss = sum(max(m, 0) for m in moves[:5]) / 5, sum(max(-m, 0) for m in moves[:5]) / 5
    want = [None] * 5 + [100 - 100 / (1 + gain / max(loss, 1e-10))]
    for m in moves[5:]:
        gain, loss = (gain * 4 + max(m, 0)) / 5, (loss * 4 + max(-m, 0)) / 5
        want.append(100 - 100 / (1 + gain / max(loss, 1e-10)))
    assert got[:5] == [None] * 5 and got[5:9] == pytest.approx(want[5:]) and got[9:] == [None] * 5


def test_vwap_resets_and_survives_no_volume(make_bars):
    rows = [(10, 10, 10, 10, 0), (12, 12, 12, 12, 2)] + [(12, 12, 12, 12, 1)] * 7 + [(20, 20, 20, 20, 5)]
    got = column(rolling.vwap(make_bars(rows)), "vwap")
    assert got[0] == 0.0 and got[1] == 12.0 and got[9] == 20.0


def test_ema_atr_by_hand(make_bars):
    rows = random_rows(30, 2)
    got = column(recursive.ema_atr(make_bars(rows), 14), "atr")
    tr = [0.0] + [max(b[1] - b[2], abs(b[1] - a[3]), abs(b[2] - a[3])) for a, b in zip(rows, rows[1:])]
    atr = sum(tr[1:15]) / 14
    want = [atr]
    for x in tr[15:]:
        atr += 2 / 15 * (x - atr)
        want.append(atr)
    assert got[:14] == [None] * 14 and got[14:] == pytest.approx(want)


def test_constant_prices(make_bars):
    b = make_bars([(5, 5, 5, 5)] * 40)
    assert set(column(rolling.rsi_simple(b), "rsi14")[14:]) == {100.0}
    assert column(rolling.linear_channel(b), "lr_r2")[-1] == 1.0
    assert column(rolling.bollinger(b), "width")[-1] == 0.0
    assert column(rolling.squeeze(rolling.bollinger(b)), "squeeze_pct")[-1] == 0.0


def test_swing_takes_ties_and_fractal_does_not(make_bars):
    lows = [5, 4, 3, 3, 4, 5]
    b = make_bars([(6, 7, low, 6) for low in lows])
    assert column(patterns.swings(b), "swing_low")[2] and not any(column(patterns.fractals(b), "fractal_low"))


def test_breakout_goes_on_to_older_fractals(make_bars):
    highs = [5, 6, 8, 6, 5, 6, 12, 6, 5, 9]
    b = make_bars([(5, h, 4, 5) for h in highs[:-1]] + [(5, 9.5, 4, 9)])
    got = patterns.fractal_breakout(b).orderBy(F.desc("bar_ix")).first()
    assert (got.breakout_signal, got.breakout_level) == ("bullish", 8.0)


def test_clusters_chain(spark):
    df = spark.createDataFrame([([103.0, 100.0, 100.1, 100.05],)], "x array<double>")
    assert df.select(patterns.cluster_means(F.col("x"), 0.001)).first()[0] == pytest.approx([100.05])


def test_candle_rules_in_order(make_bars):
    pairs = [
        ((10, 12, 8, 11), (10, 11, 9, 10.05), "doji"), ((10, 12, 8, 11), (10, 11, 10, 11), "marubozu"), ((11, 11.5, 9.5, 10), (9.9, 11.6, 9.7, 11.2), "bullish_engulf"),
        ((10, 11.5, 9.5, 11), (11.1, 11.4, 9.6, 9.9), "bearish_engulf"), ((10, 12, 9, 12), (10.5, 11.5, 10, 11), "bullish_harami"), ((10, 12, 8, 11), (10.2, 11.9, 8.1, 11.1), "inside"),
        ((10, 12, 8, 11), (10.2, 12.5, 7.5, 11.1), "outside"),
    ]
    for first, second, want in pairs:
        assert column(patterns.candle_type(make_bars([first, second])), "candle") == [None, want]


def test_divergence_needs_neighbours_inside(make_bars):
    closes = [10.0] * 5 + [12, 11, 10, 10, 13, 11, 10] + [10 - k * 0.01 for k in range(14)]
    volumes = [1] * 7 + [50, 1, 2, 50, 1] + [1] * 14
    b = rolling.obv(make_bars([(c, c, c, c, v) for c, v in zip(closes, volumes)]))
    got = column(patterns.divergence(b, "obv", lookback=24), "div")
    assert got[25] == "bearish" and set(got[:23]) == {"none"}


def test_session_bounds(spark):
    times = ["09:59:00", "10:00:00", "18:40:00", "18:40:30", "18:41:00"]
    df = spark.createDataFrame([(datetime.fromisoformat(f"2024-01-01 {t}"),) for t in times], "ts timestamp_ntz")
    assert [r[0] for r in df.select(source.in_main_session(F.col("ts"))).collect()] == [False, True, True, True, False]
    assert [r[0] for r in df.select(source.in_main_session_seconds(F.col("ts"))).collect()] == [False, True, True, False, False]


def test_resample_modes(spark):
    rows = [("T", datetime(2024, 1, 1, 10, k), 10.0 + k, 20.0 + k, 1.0, 11.0 + k, 1.0, 1.0) for k in range(5)]
    df = spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, open double, high double, low double, close double, volume double, amount double")
    a, b = source.resample(df).first(), source.resample(df, true_ohlc=True).first()
    assert (a.open, a.high, a.low, a.close, a.volume) == (11.0, 15.0, 11.0, 15.0, 5.0) and (b.open, b.high, b.low, b.close) == (10.0, 24.0, 1.0, 15.0)


def test_asof_is_strict(spark):
    left = spark.createDataFrame([("T", datetime(2024, 1, 1, k)) for k in (9, 10, 11)], "k string, t timestamp_ntz")
    right = spark.createDataFrame([("T", datetime(2024, 1, 1, 10), 1.0)], "k string, ts timestamp_ntz, x double")
    got = lambda **o: [r.x for r in asof.asof_join(left, right, "k", "t", "ts", ["x"], **o).orderBy("t").collect()]
    assert got() == [None, None, 1.0] and got(strict=False) == [None, 1.0, 1.0]
    assert got(forward=True) == [1.0, None, None] and got(strict=False, forward=True) == [1.0, 1.0, None]


def test_nearest_within_tolerance(spark):
    left = spark.createDataFrame([("T", datetime(2024, 1, 1, 10, k)) for k in (0, 20, 50)] + [("T", datetime(2024, 1, 1, 14))], "k string, t timestamp_ntz")
    right = spark.createDataFrame([("T", datetime(2024, 1, 1, 10), 1.0), ("T", datetime(2024, 1, 1, 11), 2.0)], "k string, ts timestamp_ntz, x double")
    assert [r.x for r in asof.nearest_join(left, right, "k", "t", "ts", ["x"]).orderBy("t").collect()] == [1.0, 1.0, 2.0, None]


def test_expanding_forms_agree(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([("T", k, rng.choice([rng.gauss(0, 1), 0.5])) for k in range(60)], "ticker string, w bigint, x double")
    slow = {r.w: r.q for r in rolling.expanding_quantiles(df, "x", [0.1, 0.5, 0.9], "q").collect()}
    for r in expanding.expanding_quantiles_fast(df, "x", [0.1, 0.5, 0.9], ["a", "b", "c"]).collect():
        assert [r.a, r.b, r.c] == (pytest.approx(slow[r.w]) if r.w else [None] * 3)


FEATURES = {
    "bollinger": lambda b: rolling.bollinger(b).select("bar_ix", "upper", "width"),
    "channel": lambda b: rolling.linear_channel(b).select("bar_ix", "lr_slope", "lr_r2"),
    "vwap": lambda b: rolling.vwap(b).select("bar_ix", "vwap", "crossed_up"),
    "adr": lambda b: rolling.adr(b).select("bar_ix", "adr", "low_range"),
    "atr": lambda b: recursive.ema_atr(b).select("bar_ix", "atr", "atr_pct"),
    "blocks": lambda b: patterns.order_block(b).select("bar_ix", "ob.signal", "ob.ix"),
    "gaps": lambda b: patterns.gap_confluence(b).select("bar_ix", "fvg_signal", "fvg_count"),
    "sweeps": lambda b: patterns.liquidity_sweep(b).select("bar_ix", "sweep_signal"),
    "breakers": lambda b: patterns.breaker_block(b).select("bar_ix", "breaker_signal"),
    "levels": lambda b: patterns.equal_levels(b).select("bar_ix", "eq_signal"),
    "fractals": lambda b: patterns.awesome_fractal(b).select("bar_ix", "fractal_signal", "ao_fractal_signal"),
    "breakouts": lambda b: patterns.fractal_breakout(b).select("bar_ix", "breakout_signal"),
    "divergence": lambda b: patterns.divergence(rolling.obv(b), "obv").select("bar_ix", "div"),
}


@pytest.mark.parametrize("name", sorted(FEATURES))
def test_nothing_looks_ahead(make_bars, name):
    rows = random_rows(70, 4)
    whole = FEATURES[name](make_bars(rows)).orderBy("bar_ix").collect()
    cut = FEATURES[name](make_bars(rows[:50])).orderBy("bar_ix").collect()
    for a, b in zip(whole, cut):
        for x, y in zip(a, b):
            assert x == y or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)


def test_tickers_do_not_mix(make_bars):
    one, two = make_bars(random_rows(40, 6), "A"), make_bars(random_rows(40, 7), "B")
    alone = column(rolling.vwap(rolling.bollinger(one)), "upper")
    both = rolling.vwap(rolling.bollinger(one.unionByName(two))).filter("ticker = 'A'")
    assert column(both, "upper") == alone


@pytest.mark.parametrize("bucket", [None, "day", "week", "month"])
def test_asof_in_buckets(spark, bucket):
    """By brute force, with ties, empty stretches, keys on one side only and unknown times."""
    from datetime import datetime, timedelta

    rng = random.Random(11)
    at = lambda: datetime(2024, 1, 1) + timedelta(hours=rng.choice([rng.randrange(48), rng.randrange(24 * 70, 24 * 90)]))
    left = [(n, rng.choice("abc"), at()) for n in range(150)] + [(900, "a", None), (901, "z", at()), (902, None, at())]
    right = [(k, t, float(n)) for n, (k, t) in enumerate({(rng.choice("abd"), at()) for _ in range(120)})] + [("a", None, -1.0)]
    a, b = spark.createDataFrame(left, "n int, k string, t timestamp_ntz"), spark.createDataFrame(right, "k string, ts timestamp_ntz, x double")
    for strict in (True, False):
        for forward in (True, False):
            got = {r.n: (r.asof_ts, r.x) for r in asof.asof_join(a, b, "k", "t", "ts", ["x"], strict, forward, bucket).collect()}
            for n, k, t in left:
                fits = [(ts, x) for q, ts, x in right if q == k and ts and t and ((ts > t or (ts == t and not strict)) if forward else (ts < t or (ts == t and not strict)))]
                assert got[n] == ((min if forward else max)(fits) if fits else (None, None)), (n, strict, forward)
    near = {r.n: r.x for r in asof.nearest_join(a, b, "k", "t", "ts", ["x"], 3 * 3600, bucket).collect()}
    for n, k, t in left:
        fits = [(abs(ts - t), ts, x) for q, ts, x in right if q == k and ts and t and abs(ts - t) <= timedelta(hours=3)]
        assert near[n] == (min(fits)[2] if fits else None), n


def test_scan_of_several_keys(spark):
    """Keys that share a partition, batches that end within a key, and filters that come after the scan."""
    from pyspark.sql import functions as F

    from barloom.operators.expanding import ordered_scan

    def make():
        total = 0.0

        def step(rows):
            nonlocal total
            out = []
            for x in rows["x"]:
                total += x or 0.0
                out.append(total)
            return [out, [len(rows["x"]) * 1.0] * len(out)]

        return step

    data = [(k, i, float(i % 7) if i % 5 else None, [i] * 3) for k in ("a", "b", "c", None) for i in range(50)] + [("d", 0, 1.0, [])]
    df = spark.createDataFrame(data, "ticker string, bar_ix long, x double, wide array<long>").repartition(3)
    expect, total = {}, {}
    for k, i, x, _ in data:
        total[k] = total.get(k, 0.0) + (x or 0.0)
        expect[k, i] = total[k]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            found = ordered_scan(df, ["x"], ["total", "rows"], make)
            assert found.columns == ["ticker", "bar_ix", "x", "wide", "total", "rows"]
            assert {(r.ticker, r.bar_ix): r.total for r in found.collect()} == expect
            kept = found.filter((F.col("bar_ix") % 2 == 1) & F.col("x").isNotNull()).select("ticker", "bar_ix", "total").collect()
            assert {(r.ticker, r.bar_ix): r.total for r in kept} == {(k, i): expect[k, i] for k, i, x, _ in data if i % 2 and x is not None}
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert ordered_scan(df.filter("false"), ["x"], ["total", "rows"], make).collect() == []
