"""The batch run: its list of variants, and signals against plain loops over the windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.config import SHORT
from barloom.operators import atoms, signals
from barloom.plans import batch, reports as plans, trading

from .conftest import SMALL


@pytest.fixture(scope="module")
def run(spark):
    f = signals.batch_features(trading.feats(spark, SMALL), SHORT).cache()
    sig = signals.batch_signals(f, signals.batch_run()).select("strategy", "ticker", "w", "sig", "mode", F.col("g_tp").alias("tp"), F.col("g_sl").alias("sl")).toPandas()
    windows = f.select(
        "ticker", "w", "pos", "rets", "last", "conf_per_sample", "conf", "agree", "pred_ret", "entry_close", "g_tp", "g_sl", "bb_pct", "bb_width", "bb_mom", "wf_width", "mc_std", "conf_up", "rsi14", "win_rate_ok"
    ).toPandas()
    close = {(r.ticker, r.bar_ix): r.close for r in trading.bars(spark, SMALL).select("ticker", "bar_ix", "close").collect()}
    return {t: g.sort_values("w").reset_index(drop=True) for t, g in windows.groupby("ticker")}, sig, close


def bounded(x):
    """1 above the walk-forward bound, -1 below."""
    out = []
    for i, v in enumerate(x):
        seen = x[: i + 1] if i < 100 else x[:i]
        hi, lo = (np.quantile(seen, 0.9), np.quantile(seen, 0.1)) if i > 10 else (0.001, -0.001)
        out.append(1 if v > hi else -1 if v < lo else 0)
    return np.array(out)


def ratio(g, k):
    up, down = (g.g_tp - g.entry_close).to_numpy(), (g.entry_close - g.g_sl).to_numpy()
    return np.where((up > 0) & (up > k * down), 1, np.where((down > 0) & (down > k * up), -1, 0))


def check(run, name, expected):
    windows, sig, close = run
    for ticker, g in windows.items():
        mine = sig[(sig.strategy == name) & (sig.ticker == ticker)].set_index("w").sig
        assert mine.reindex(g.w, fill_value=0).tolist() == list(expected(ticker, g, close)), (name, ticker)


def drop(g, t):
    return np.array([np.mean([r for r, c in zip(rets, conf, strict=True) if c > t] or list(rets)) for rets, conf in zip(g.rets, g.conf_per_sample, strict=True)])


def inside(sig, g, hi=0.7, lo=0.3):
    return np.where(((sig == 1) & (g.bb_pct <= lo)) | ((sig == -1) & (g.bb_pct >= hi)), sig, 0)


def regime_before(g):
    """Whether the window before is wide, oversold, overbought, expanding; the first one's is wide, middle and expanding."""
    wide, pct, grows = (g.bb_width >= g.wf_width).to_numpy(), g.bb_pct.to_numpy(), g.bb_mom.to_numpy()
    return np.append(True, wide[:-1]), np.append(0.5, pct[:-1]), np.append(True, grows[:-1])


def test_every_variant_is_there():
    names = [s.name for s in signals.batch_run()]
    assert len(names) == len(set(names)) == 99 + 8
    tier2 = ("confTrend", "mcSmall", "mcBig", "rsi14", "zGt1", "rollWR", "rsiExtreme", "confTrend+mcSmall", "zGt1+rsi14", "confTrend+mcSmall+rsi14")
    assert {f"WF+BB%B+BBmom+{t} noTP" for t in tier2} | {f"H5+BBwidth+BBmom+{t} noTP" for t in ("confTrend", "mcSmall", "confTrend+mcSmall+rsi14")} <= set(names)
    assert {"V+WF: ratio>3.0", "WF+skipBadReg noTP", "WF+onlyBestReg noTP", "WF+BB%B+skipBadReg noTP"} <= set(names) and sum(n.endswith("+4regFilter") for n in names) == 5
    assert [s.mode for s in signals.batch_run() if s.name.startswith("H2")] == ["weighted"]


@pytest.mark.parametrize("level", signals.DROP_LEVELS)
def test_drop_levels(run, level):
    check(run, f"H5: drop MC<{level:.1f} conf", lambda t, g, close: bounded(drop(g, level)))


def test_h5_base_is_the_drop_return(run):
    check(run, "H5<0.4+BBwidth", lambda t, g, close: np.where(g.bb_width >= g.wf_width, bounded(drop(g, 0.4)), 0))


def test_momentum(run):
    def expected(t, g, close):
        rise = np.array([close[t, p] > close[t, p - 1] for p in g.pos])
        v = ratio(g, 3.0)
        return np.where(((v == 1) & rise) | ((v == -1) & ~rise), v, 0)

    check(run, "V+WF: ratio>3.0", expected)


def test_champion_and_second_tier(run):
    best = lambda g: np.where(g.bb_mom, inside(bounded(g.pred_ret.to_numpy()), g), 0)
    check(run, "WF+BB%B+BBmom+rollWR noTP", lambda t, g, close: np.where(g.win_rate_ok, best(g), 0))
    skip = lambda s, g: ((s == 1) & (g.rsi14 > 70)) | ((s == -1) & (g.rsi14 < 30))
    check(run, "WF+BB%B+BBmom+rsi14 noTP", lambda t, g, close: np.where(skip(best(g), g), 0, best(g)))
    check(run, "H1×V: agree≥5 + ratio>3.0", lambda t, g, close: np.where((g.agree >= 5) & (bounded(g.pred_ret.to_numpy()) == ratio(g, 3.0)), ratio(g, 3.0), 0))


def test_confidence_needs_thirty_windows(run):
    for level in signals.CONF_LEVELS:
        check(run, f"wf+conf≥{level:.2f}", lambda t, g, close, level=level: np.where((g.conf >= level) & ((g.conf >= level).sum() >= 30), bounded(g.pred_ret.to_numpy()), 0))


def test_regime_variants(run):
    def bad(g):
        wide, pct, grows = regime_before(g)
        return wide & (pct < 0.3) & grows

    def bad4(g):
        wide, pct, grows = regime_before(g)
        return (wide & (pct > 0.7) & ~grows) | (wide & (pct < 0.3)) | (~wide & (pct < 0.3) & grows)

    def best(g):
        wide, pct, grows = regime_before(g)
        return wide & (pct >= 0.3) & (pct < 0.7) & ~grows

    wf = lambda g: bounded(g.pred_ret.to_numpy())
    check(run, "WF+skipBadReg noTP", lambda t, g, close: np.where(bad(g), 0, wf(g)))
    check(run, "WF+onlyBestReg noTP", lambda t, g, close: np.where(best(g), wf(g), 0))
    spread = lambda g: np.array([i <= 10 or s >= np.median(g.mc_std[:i]) for i, s in enumerate(g.mc_std)])
    check(run, "WF+BB%B+BBmom+mcBig noTP+4regFilter", lambda t, g, close: np.where(~bad4(g) & g.bb_mom & spread(g), inside(wf(g), g), 0))
    check(run, "H5<0.4+BBwidth+BBmom noTP+4regFilter", lambda t, g, close: np.where(~bad4(g) & g.bb_mom & (g.bb_width >= g.wf_width), bounded(drop(g, 0.4)), 0))


def test_weighted_levels(run):
    windows, sig, _ = run
    mine = sig[sig.strategy == "H2: weighted by conf"]
    assert len(mine)
    for row in mine.head(40).itertuples():
        g = windows[row.ticker].set_index("w").loc[row.w]
        order = np.argsort(g["last"], kind="stable")
        values, weights = np.array(g["last"])[order], np.array(g.conf_per_sample)[order] / (sum(g.conf_per_sample) + 1e-8)
        middle = np.cumsum(weights) - weights / 2
        assert (row.tp, row.sl) == pytest.approx((np.interp(0.8, middle, values), np.interp(0.2, middle, values)))


def test_query_gives_all_rows(spark):
    rows = batch.t04(spark, SMALL).collect()
    assert {"WF+BB%B+BBmom noTP", "H5: drop MC<0.6 conf", "H2: weighted by conf"} <= {r.strategy for r in rows} and min(r.n_trades for r in rows) <= 20


def test_train_test_table(spark):
    """Against each threshold and each part of the windows taken alone."""
    got = {(r.strategy, r.split): r for r in plans.t16(spark, SMALL).collect()}
    assert set(got) == {(label, split) for label, _, _ in plans.CONFIGURATIONS for split in ("train", "test")} and len(got) == 18
    f = plans.window_features(spark, SMALL).cache()
    chosen = {s[0]: s for s in plans.PER_WINDOW + plans.MORE_PER_WINDOW}
    traded = 0
    for ct in (0.8, 1.0):
        mine = f.withColumn("dir", atoms.consensus(F.col("paths"), F.col("entry_close"), ct)[0]["dir"])
        t = plans.per_window_trades(mine, tuple(chosen.values())).toPandas()
        for label, name, own in plans.CONFIGURATIONS:
            for split in ("train", "test"):
                rets = t[(t.strategy == name) & ((t.pred_ts < plans.TEST_FROM) == (split == "train"))].ret
                if own == ct:
                    traded += len(rets)
                    assert got[label, split].n == len(rets) and got[label, split].total_return_pct == pytest.approx(rets.sum() * 100, abs=1e-4), label
    assert traded and got["Vanilla ct=0.8", "train"].n and got["Vanilla ct=0.8", "test"].n


def test_flagship_knows_every_metric(spark):
    """Few trades leave no metric of the flagship unknown (F4)."""
    found = trading.x3(spark, SMALL).collect()
    assert any(row.n_trades <= 20 for row in found)
    assert [row for row in found if None in tuple(row)] == []
