"""The portfolio, a forecast's inputs and times, and calibration in two passes, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import evaluation, generate, inference, portfolio, sweep, windows
from barloom.config import Horizon
from barloom.sources.bars import numbered

BARS = "ticker string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def market(spark, tickers, days, seed=1, step=30, gap=0.1, jump=0.02):
    """Bars of several tickers from 10:00 to 18:30, some of them missing."""
    rng, rows = random.Random(seed), []
    for t in tickers:
        close = 100.0
        for d in range(days):
            for k in range(18 * 30 // step):
                ts = datetime(2024, 1, 1, 10) + timedelta(days=d, minutes=step * k)
                if rng.random() < gap or ts.hour * 60 + ts.minute > 1110:
                    continue
                o = close * (1 + rng.uniform(-jump, jump) / 4)
                close = o * (1 + rng.uniform(-jump, jump))
                rows.append((t, ts, o, max(o, close), min(o, close), close, 1.0))
    return numbered(spark.createDataFrame(rows, BARS))


def brute_portfolio(bars, scores, rules):
    at, weights = {}, {}
    for (t, ts), s in scores.items():
        if s is not None:
            at.setdefault(ts, []).append((s, t))
    for ts, own in at.items():
        best = [t for _, t in sorted(own, key=lambda x: (-x[0], x[1]))]
        worst = [t for _, t in sorted(sorted(own, key=lambda x: x[1], reverse=True), key=lambda x: x[0])]
        for t in worst[: rules.bottom]:
            weights[t, ts] = -1 / rules.bottom
        for t in best[: rules.top]:
            weights[t, ts] = 1 / rules.top
    out, sessions = {}, {}
    for b in bars:
        sessions.setdefault((b.ticker, b.ts.date()), []).append(b)
    for (t, _), own in sessions.items():
        held, signal = None, 0.0
        for n, b in enumerate(sorted(own, key=lambda b: b.ts)):
            minute = b.ts.hour * 60 + b.ts.minute
            paid = 0.0
            if held is None and signal and rules.enter_from <= minute <= rules.enter_until and b.open > 0:
                held, paid = [signal, b.open, b.open, 0], abs(signal)
            if held:
                w, entry, last, k = held
                held = [w, entry, b.close, k + 1]
                gain = (1 if w > 0 else -1) * (b.close - entry) / entry
                reason = "stop" if gain <= -rules.stop else "target" if gain >= rules.target else "horizon" if k + 1 >= rules.horizon else "session" if minute >= rules.leave_at or n == len(own) - 1 else None
                pnl = w * ((b.close - last) / last if last else 0.0) - (abs(w) * rules.cost if reason else 0)
                out[t, b.ts] = (w, pytest.approx(pnl, abs=1e-12), pytest.approx(paid + (abs(w) if reason else 0)), k + 1, reason)
                if reason:
                    held = None
            signal = weights.get((t, b.ts), 0.0)
    return out


@pytest.mark.parametrize("rules", [portfolio.Rules(), portfolio.Rules(top=1, bottom=1, horizon=2, cost=0.0), portfolio.Rules(stop=0.05, target=0.05, horizon=30, leave_at=1080, enter_from=660, enter_until=900)])
def test_portfolio_by_brute_force(spark, rules):
    bars = market(spark, "abcdefg", 4, step=30)
    rows = bars.collect()
    rng = random.Random(2)
    scores = {(b.ticker, b.ts): rng.choice([None, 0.0, 0.1, -0.2, 0.3]) for b in rows if rng.random() < 0.9}
    table = spark.createDataFrame([(t, ts, s) for (t, ts), s in scores.items()], "ticker string, ts timestamp_ntz, score double")
    held = portfolio.positions(bars, portfolio.target_weights(table, rules), rules)
    got = {(r.ticker, r.ts): (r.weight, r.pnl, r.turnover, r.held, r.reason) for r in held.collect()}
    want = brute_portfolio(rows, scores, rules)
    assert got == want and len({r for *_, r in want.values()}) >= 3
    equity, peak, curve = 1.0, 1.0, []
    pnl = {}
    for (_, ts), x in got.items():
        pnl[ts] = pnl.get(ts, 0.0) + x[1]
    for ts in sorted(pnl):
        equity *= 1 + pnl[ts]
        peak = max(peak, equity)
        curve.append((ts, pytest.approx(equity), pytest.approx(equity / peak - 1, abs=1e-12)))
    assert [(r.ts, r.equity, r.drawdown) for r in portfolio.equity_curve(held).orderBy("ts").collect()] == curve


def test_portfolio_of_nothing(spark):
    bars = market(spark, "ab", 1)
    none = spark.createDataFrame([], "ticker string, ts timestamp_ntz, score double")
    rules = portfolio.Rules()
    held = portfolio.positions(bars, portfolio.target_weights(none, rules), rules)
    assert held.count() == 0 and portfolio.equity_curve(held).count() == 0
    assert portfolio.positions(bars.limit(0), portfolio.target_weights(none, rules), rules).count() == 0


def brute_times(last, minutes, n, first=600, end=1120):
    out, day, k = [], last.date(), 0
    at = datetime(day.year, day.month, day.day)
    while len(out) < n:
        t = at + timedelta(minutes=first + k * minutes)
        if t.date() > at.date() or t.hour * 60 + t.minute > end or at.weekday() >= 5:
            at, k = at + timedelta(days=1), 0
            continue
        k += 1
        if t > last:
            out.append(t)
    return out


def test_future_times(spark):
    rng = random.Random(3)
    rows = [(datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(60 * 24 * 14)), rng.choice([1, 7, 10, 30, 60, 240, 600, 1440])) for _ in range(300)]
    rows += [(datetime(2024, 1, 5, 18, 40), 10), (datetime(2024, 1, 6, 12), 10), (datetime(2024, 1, 5, 9), 60), (datetime(2024, 1, 5, 10), 60), (datetime(2023, 12, 29, 18), 60)]
    d = spark.createDataFrame(rows, "ts timestamp_ntz, minutes int")
    for r in d.withColumn("f", inference.future_times(F.col("ts"), F.col("minutes"), 25)).collect():
        assert r.f == brute_times(r.ts, r.minutes, 25), (r.ts, r.minutes)
    one = d.limit(1).select("ts", inference.regular_times(F.col("ts"), F.lit(10), 3).alias("f")).first()
    assert one.f == [one.ts + timedelta(minutes=10 * k) for k in (1, 2, 3)]


def test_frequency(spark):
    at = lambda *m: [datetime(2024, 1, 1, 10) + timedelta(minutes=x) for x in m]
    rows = [("a", t) for t in at(0, 10, 20, 80, 140, 150)] + [("b", t) for t in at(0)] + [("c", t) for t in at(0, 30, 40)] + [("d", t) for t in at(0, 0, 0, 5)]
    bars = numbered(spark.createDataFrame([(t, ts, *[1.0] * 5) for t, ts in rows], BARS))
    assert {r.ticker: r.minutes for r in inference.frequency(bars, 15).collect()} == {"a": 10, "b": 15, "c": 10, "d": 5}


def test_complete_inputs(spark):
    prices = spark.createDataFrame([(1.0, 4.0, 1.0, 2.0)], "open double, high double, low double, close double")
    assert inference.completed(prices).first()[4:] == (0.0, 0.0)
    assert inference.completed(prices.withColumn("volume", F.lit(3.0))).first()[4:] == (3.0, 6.0)
    assert inference.completed(prices.withColumn("volume", F.lit(3)).withColumn("amount", F.lit(5.0))).first()[4:] == (3.0, 5.0)
    with pytest.raises(ValueError, match="high"):
        inference.completed(prices.drop("high"))
    for bad in (F.lit(None).cast("double"), F.lit(float("nan"))):
        with pytest.raises(Exception, match="unknown close"):
            inference.completed(prices.withColumn("close", bad)).collect()
        assert inference.completed(prices.withColumn("close", bad), refuse=False).count() == 1


def test_scaled_and_back(make_bars):
    rng = random.Random(4)
    closes = [100 + rng.gauss(0, 3) for _ in range(80)] + [400.0] + [100.0] * 30
    bars = make_bars([(c, c, c, c, 1 + k % 7) for k, c in enumerate(closes)])
    found = inference.scaling(inference.completed(bars), 12)
    z = inference.scaled(F.col("close"), F.col("scale")["close"])
    rows = found.select("bar_ix", "close", z.alias("z"), inference.unscaled(z, F.col("scale")["close"]).alias("back")).collect()
    assert min(r.bar_ix for r in rows) == 11 and all(abs(r.z) <= 5 and r.back == pytest.approx(r.close, rel=1e-9) for r in rows if abs(r.z) < 5)
    assert [r.z for r in rows if r.bar_ix == 110] == [0.0]


def test_two_passes_are_separate_runs(spark):
    """Every row of both passes equals a run with those parameters alone, and pass 2 takes each ticker's winner."""
    bars = market(spark, "ab", 6, seed=9, step=60, gap=0.0).drop("volume")
    how = {"pred_lens": [2, 3], "temperatures": [0.5, 1.5], "top_ps": [0.6, 1.0], "sample_counts": [2, 5]}
    got = sweep.two_pass(bars, 12, **how, n_windows=7, seed=5).collect()
    assert sum(r["pass"] == 1 for r in got) == 4 and sum(r["pass"] == 2 for r in got) == 16 and all(r.n == 7 for r in got)
    winner = {r.ticker: r.pred_len for r in got if r["pass"] == 1 and r.is_best}
    whole = windows.sliding_windows(generate.code_contexts(bars, 12), Horizon(12, 3, 5))
    chosen = sweep.windows_per_ticker(whole, 7, 5).cache()

    def alone(length, t, p, samples):
        drawn = generate.generate(chosen, length, samples, 12, 5, t, 0, p).withColumn("paths", generate.paths_of(F.col("generated"))).withColumn("horizon", F.slice("horizon", 1, length))
        found = evaluation.evaluate_windows(drawn).toPandas()
        return {t: (g.consensus_dir_acc.mean(), g.expectancy.mean(), g.direction_accuracy.mean()) for t, g in found.groupby("ticker")}

    runs = {}
    for r in got:
        key = (r.pred_len, r.temperature, r.top_p, r.samples)
        if key not in runs:
            runs[key] = alone(*key)
        assert (r.consensus_dir_acc, r.expectancy, r.direction_accuracy) == pytest.approx(runs[key][r.ticker]), r
        assert r["pass"] == 1 or r.pred_len == winner[r.ticker]
    for n in (1, 2):
        for t in winner:
            own = [r for r in got if r["pass"] == n and r.ticker == t]
            best = [r for r in own if r.is_best]
            assert len(best) == 1 and all((round(best[0].consensus_dir_acc, 9), round(best[0].expectancy, 9)) >= (round(r.consensus_dir_acc, 9), round(r.expectancy, 9)) for r in own)
