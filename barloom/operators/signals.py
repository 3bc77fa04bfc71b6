"""Window features, filter gates, and strategies as rows.

A strategy is a name, a signal expression over feature columns and a level mode.
All strategies of a batch become rows of one table, so one simulation pass serves
them all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from barloom.config import Horizon
from barloom.operators import atoms, forecast, rolling, simulate, windows
from barloom.operators.expanding import Expanding, expanding_quantiles
from barloom.operators.rolling import floor, true
from barloom.sources.bars import by_bar


def by_window() -> W:
    return W.partitionBy("ticker").orderBy("w")


def expanding_bounds(df: DataFrame, column: str, name: str, q_high: float = 0.9, q_low: float = 0.1) -> DataFrame:
    """``{name}_hi`` and ``{name}_lo``: ±0.001 up to w = 10, quantiles with the current value below w = 100, of earlier values from then on."""
    return _walk_forward(df, {}, {name: column}, q_high, q_low)


def _walk_forward(df: DataFrame, medians: dict[str, str], bounds: dict[str, str], q_high: float = 0.9, q_low: float = 0.1) -> DataFrame:
    """Medians of earlier values and bounds of several columns, by name, in one scan of each ticker."""
    wanted, first = [Expanding(column, 0.5, name) for name, column in medians.items()], dict.fromkeys(medians, 0.001)
    for name, column in bounds.items():
        wanted += [Expanding(column, q_high, f"{name}_hi", 100), Expanding(column, q_low, f"{name}_lo", 100)]
        first |= {f"{name}_hi": 0.001, f"{name}_lo": -0.001}
    found = expanding_quantiles(df, wanted)
    return found.withColumns({name: F.when(F.col("w") <= 10, F.lit(value)).otherwise(F.col(name)) for name, value in first.items()})


def features(bars: DataFrame, horizon: Horizon, forecaster: str = "analog") -> DataFrame:
    """All window features of a bar table, one row per (ticker, w).

    One shuffle by ticker serves all of it: every feature is a window, an expression
    over the bar's own row or, for expanding quantiles, part of one scan of the ticker.
    """
    b = rolling.linear_channel(rolling.atr_sma(rolling.rsi_simple(rolling.rising_twice(rolling.bollinger_partial(bars), "bb_width", "_unused"))))
    b = b.withColumn("prev_close", F.lag("close").over(by_bar()))
    b = forecast.get_forecaster(forecaster).transform(b.drop("_unused"), horizon)
    longest = 6 * horizon.samples + horizon.pred_len - 1
    b = forecast.return_codes(b).withColumn("codes", F.collect_list("code").over(by_bar().rowsBetween(-(longest - 1), 0))).drop("ret", "code", "fine")
    f = windows.sliding_windows(b, horizon).withColumn("conf_per_sample", forecast.confidence_per_sample(F.col("codes"), horizon)).drop("codes")
    f = f.withColumn("conf", forecast.mean(F.col("conf_per_sample")))
    ec = F.col("entry_close")
    ret = lambda value: (value - ec) / floor(ec, 1e-8)
    last = forecast.last_step(F.col("paths"))
    f = (
        f.withColumn("last", last)
        .withColumn("rets", F.transform("last", lambda x: ret(x)))
        .withColumn("pred_ret", ret(forecast.mean(F.col("last"))))
        .withColumn("g_tp", forecast.quantile(F.col("last"), 0.8))
        .withColumn("g_sl", forecast.quantile(F.col("last"), 0.2))
        .withColumn("mc_std", forecast.std_pop(F.col("last")))
        .withColumn("agree", atoms.agreement(F.col("paths"), ec))
        .withColumn("weights", atoms.normalised(F.col("conf_per_sample")))
        .withColumn("w_ret", atoms.weighted_mean(F.col("rets"), F.col("weights")))
        .withColumn("best_ret", atoms.best_sample(F.col("rets"), F.col("conf_per_sample")))
        .withColumn("drop_ret", atoms.confident_mean(F.col("rets"), F.col("conf_per_sample"), 0.4))
        .withColumn("prev_conf", F.lag("conf").over(by_window()))
        .withColumn("conf_up", F.coalesce(F.col("conf") > F.col("prev_conf"), F.lit(True)))
    )
    w = by_window()
    rising = lambda c: true((F.col(c) > F.lag(c).over(w)) & (F.lag(c).over(w) > F.lag(c, 2).over(w)))
    past = w.rowsBetween(W.unboundedPreceding, -1)
    z = (F.col("pred_ret") - F.avg("pred_ret").over(past)) / floor(F.stddev_pop("pred_ret").over(past))
    f = f.withColumn("bb_mom", rising("bb_width")).withColumn("pred_z", F.when(F.col("w") > 20, z).otherwise(F.lit(0.5)))
    medians = {"wf_width": "bb_width", "wf_r2": "lr_r2", "wf_atr": "atr_sma", "wf_vol": "volume", "wf_mc": "mc_std"}
    f = _walk_forward(f, medians, {"wf": "pred_ret", "wq": "w_ret", "bq": "best_ret", "dq": "drop_ret"})
    f = f.withColumn("mc_big", F.when(F.col("w") > 10, F.col("mc_std") > F.col("wf_mc")).otherwise(F.lit(True)))
    return f.withColumn("mc_small", F.when(F.col("w") > 10, F.col("mc_std") < F.col("wf_mc")).otherwise(F.lit(True)))


@dataclass(frozen=True)
class Strategy:
    """``signal`` and ``gate`` are SQL over feature columns; in a gate, ``sig`` is the signal."""

    name: str
    signal: str
    gate: str = "true"
    mode: str = "default"


def bounded(value: str, name: str) -> str:
    """1 above the upper bound, -1 below the lower."""
    return f"(CASE WHEN {value} > {name}_hi THEN 1 WHEN {value} < {name}_lo THEN -1 ELSE 0 END)"


def reward_ratio(k: float) -> str:
    return f"(CASE WHEN g_tp - entry_close > {k!r} * (entry_close - g_sl) THEN 1 WHEN entry_close - g_sl > {k!r} * (g_tp - entry_close) THEN -1 ELSE 0 END)"


WF = bounded("pred_ret", "wf")
PCT = "((sig = 1 AND bb_pct <= 0.3D) OR (sig = -1 AND bb_pct >= 0.7D))"
TOUCH = "((sig = 1 AND touch_lower) OR (sig = -1 AND touch_upper))"
LR_PCT = "((sig = 1 AND lr_pct <= 0.3D) OR (sig = -1 AND lr_pct >= 0.7D))"
RSI = "((sig = 1 AND rsi14 <= 30) OR (sig = -1 AND rsi14 >= 70))"
WIDTH, R2, ATR, VOLUME = "bb_width >= wf_width", "lr_r2 >= wf_r2", "atr_sma >= wf_atr", "volume >= wf_vol"


def catalogue() -> list[Strategy]:
    """A choice of variants in families; :func:`batch_run` has those of the batch run."""
    bases = {"WF": (WF, "true"), "agree5": (WF, "agree >= 5"), "conf<.3": (WF, "conf < 0.3D"), "V3": (reward_ratio(3.0), "true")}
    out = [Strategy("WF", WF)]
    out += [Strategy(f"conf>={t}", WF, f"conf >= {t}D") for t in (0.2, 0.3, 0.4, 0.45, 0.5, 0.55, 0.6)]
    out += [Strategy(f"agree>={n}", WF, f"agree >= {n}") for n in (3, 5)]
    out += [Strategy("conf_weighted", bounded("w_ret", "wq")), Strategy("best_mc", bounded("best_ret", "bq")), Strategy("drop_mc", bounded("drop_ret", "dq"))]
    out += [Strategy(f"V>{k:g}", reward_ratio(k)) for k in (1.0, 1.5, 2.0, 3.0, 5.0)]
    out += [Strategy("V1_up", reward_ratio(1.0), "conf_up"), Strategy("agree3_V2", reward_ratio(2.0), "agree >= 3")]
    for name, (signal, gate) in bases.items():
        out += [Strategy(f"{name}+{g}", signal, f"{gate} AND {test}") for g, test in (("width", WIDTH), ("pct", PCT), ("touch", TOUCH))]
        out += [Strategy(f"{name}_noSL", signal, gate, "no_sl"), Strategy(f"{name}_noTP", signal, gate, "no_tp")]
        out += [Strategy(f"{name}+{g}", signal, f"{gate} AND {test}") for g, test in (("r2", R2), ("lrpct", LR_PCT), ("r2_lrpct", f"{R2} AND {LR_PCT}"))]
        out += [Strategy(f"{name}+{g}", signal, f"{gate} AND {test}") for g, test in (("atr", ATR), ("volume", VOLUME), ("bbmom", "bb_mom"))]
    out += [Strategy("WF+pct_noTP", WF, PCT, "no_tp"), Strategy("WF+pct+bbmom_noTP", WF, f"{PCT} AND bb_mom", "no_tp")]
    out += [Strategy(f"WF+pct+{g}_noTP", WF, f"{PCT} AND {test}", "no_tp") for g, test in (("conf_up", "conf_up"), ("mc_big", "mc_big"), ("mc_small", "mc_small"), ("rsi", RSI), ("z", "abs(pred_z) > 1"), ("volume", VOLUME), ("width", WIDTH))]
    out += [Strategy("WF+width+volume", WF, f"{WIDTH} AND {VOLUME}"), Strategy("WF+pct+r2", WF, f"{PCT} AND {R2}"), Strategy("WF+atr+bbmom", WF, f"{ATR} AND bb_mom")]
    return out


DROP_LEVELS, CONF_LEVELS, LEAST_WINDOWS = (0.4, 0.6, 0.8, 1.0), (0.2, 0.3, 0.4, 0.45, 0.5, 0.55, 0.6), 30
BAD, BEST = "high_vol_oversold_expanding", "high_vol_middle_contracting"
BAD4 = ("high_vol_overbought_contracting", "high_vol_oversold_contracting", BAD, "low_vol_oversold_expanding")


def batch_features(f: DataFrame, horizon: Horizon) -> DataFrame:
    """What :func:`batch_run` needs besides :func:`features`: means of confident samples with bounds, weighted levels,
    windows per confidence threshold, the rolling win rate of the baseline, and the regime of the window before."""
    names = {f"d{t * 10:.0f}": t for t in DROP_LEVELS[1:]}
    f = f.withColumns({f"{name}_ret": atoms.confident_mean(F.col("rets"), F.col("conf_per_sample"), t) for name, t in names.items()})
    f = f.withColumns({f"{level}_w": atoms.weighted_quantile(F.col("last"), F.col("weights"), q) for level, q in (("g_tp", 0.8), ("g_sl", 0.2))})
    f = f.withColumns({f"n_conf{t * 100:.0f}": F.count_if(F.col("conf") >= t).over(W.partitionBy("ticker")) for t in CONF_LEVELS})
    f = simulate.rolling_win_rate(simulate.signals_won(f.withColumn("sig", F.expr(WF)), horizon)).drop("sig", "won")
    vol = F.when(F.col("bb_width") >= F.col("wf_width"), "high_vol").otherwise("low_vol")
    # At exactly 0.7 a place is neither of the best regime nor of a bad one.
    place = F.when(F.col("bb_pct") < 0.3, "oversold").when(F.col("bb_pct") > 0.7, "overbought").when(F.col("bb_pct") < 0.7, "middle").otherwise("edge")
    label = F.concat_ws("_", vol, place, F.when(F.col("bb_mom"), "expanding").otherwise("contracting"))
    # The first window has none before it and passes as wide, middle, expanding.
    f = f.withColumn("regime", label).withColumn("regime", F.lag("regime", 1, "high_vol_middle_expanding").over(by_window()))
    # The scan comes last, since a window after it would shuffle the rows anew.
    return _walk_forward(f, {}, {name: f"{name}_ret" for name in names})


def batch_run() -> list[Strategy]:
    """Every variant of the batch run under its published label, over :func:`batch_features`.

    100 variants and eight by regime, one of which, "WF+BB%B+vol noTP", is run twice there and once here.
    """
    h5, v3 = bounded("drop_ret", "dq"), reward_ratio(3.0)
    bases = {"WF": (WF, "true"), "H1≥5": (WF, "agree >= 5"), "H5<0.4": (h5, "true"), "V>3.0": (v3, "true")}
    overbought = "((sig = 1 AND rsi14 > 70) OR (sig = -1 AND rsi14 < 30))"
    filters = {
        "BBwidth": WIDTH, "BB%B": PCT, "BBtouch": TOUCH, "LRr2": R2, "LR%B": LR_PCT, "LRr2%B": f"{R2} AND {LR_PCT}", "ATR": ATR, "vol": VOLUME, "BBmom": "bb_mom", "confTrend": "conf_up",
        "mcSmall": "mc_small", "mcBig": "mc_big", "rsi14": f"NOT {overbought}", "zGt1": "abs(pred_z) > 1", "rollWR": "win_rate_ok", "rsiExtreme": "((sig = 1 AND rsi14 < 30) OR (sig = -1 AND rsi14 > 70))",
    }

    def variant(base: str, *names: str, mode: str = "no_tp", label: str | None = None, also: str = "true") -> Strategy:
        signal, gate = bases[base]
        suffix = {"no_tp": " noTP", "no_sl": " noSL", "default": ""}[mode]
        return Strategy((label or "+".join((base, *names))) + suffix, signal, " AND ".join((gate, *(filters[n] for n in names), also)), mode)

    out = [Strategy("wf (FIX)", WF)]
    out += [Strategy(f"wf+conf≥{t:.2f}", WF, f"conf >= {t}D AND n_conf{t * 100:.0f} >= {LEAST_WINDOWS}") for t in CONF_LEVELS]
    out += [Strategy(f"H1: MC agree≥{n}", WF, f"agree >= {n}") for n in (3, 5)]
    out += [Strategy("H2: weighted by conf", bounded("w_ret", "wq"), mode="weighted")]
    out += [Strategy(f"V: TP/SL ratio>{k:.1f}", reward_ratio(k)) for k in (1.0, 1.5, 2.0, 3.0, 5.0)]
    out += [Strategy("V+WF: ratio>3.0", v3, "((sig = 1 AND entry_close > prev_close) OR (sig = -1 AND NOT entry_close > prev_close))")]
    out += [Strategy("H4: best MC", bounded("best_ret", "bq"))]
    out += [Strategy(f"H5: drop MC<{t:.1f} conf", h5 if t == 0.4 else bounded(f"d{t * 10:.0f}_ret", f"d{t * 10:.0f}")) for t in DROP_LEVELS]
    out += [Strategy("H1×V: agree≥5 + ratio>3.0", WF, f"agree >= 5 AND sig = {v3}")]
    out += [variant(b, g, mode="default") for b in bases for g in ("BBwidth", "BB%B", "BBtouch")]
    out += [variant(b, "BBwidth", mode="no_sl") for b in bases] + [variant("V>3.0", mode="no_sl")]
    out += [variant(b) for b in bases] + [variant(b, "BBwidth") for b in bases] + [variant(b, "BB%B") for b in ("WF", "V>3.0")]
    out += [variant(b, g) for b in bases for g in ("LRr2", "LR%B", "LRr2%B")]
    out += [variant(b, g) for b in bases for g in ("ATR", "vol", "BBmom")]
    best, second = ("WF", "BB%B"), ("H5<0.4", "BBwidth")
    out += [variant(*b, *more) for b in (best, second) for more in (("ATR",), ("vol",), ("BBmom",), ("ATR", "vol"))]
    out += [variant(*b, "vol") for b in ((*best, "BBmom"), (*second, "BBmom"), ("H5<0.4", "BBmom"), ("WF", "BBmom"))]
    tier2 = [(n,) for n in ("confTrend", "mcSmall", "mcBig", "rsi14", "zGt1", "rollWR", "rsiExtreme")]
    tier2 += [("confTrend", "mcSmall"), ("zGt1", "rsi14"), ("confTrend", "mcSmall", "rsi14")]
    out += [variant(*best, "BBmom", *more) for more in tier2]
    out += [variant(*second, "BBmom", *more, label="+".join(("H5", "BBwidth", "BBmom", *more))) for more in (("confTrend",), ("mcSmall",), ("confTrend", "mcSmall", "rsi14"))]
    not_bad, not_bad4 = f"regime <> '{BAD}'", f"regime NOT IN {BAD4!r}"
    out += [variant("WF", label="WF+skipBadReg", also=not_bad), variant("WF", label="WF+onlyBestReg", also=f"regime = '{BEST}'"), variant(*best, label="WF+BB%B+skipBadReg", also=not_bad)]
    # This filter keeps a spread equal to the median, mcBig of tier 2 doesn't.
    top5 = [((*best, "BBmom"), "", "true"), ((*best, "BBmom", "vol"), "", "true"), ((*best, "BBmom"), "+mcBig", "(w <= 10 OR mc_std >= wf_mc)"), ((*best, "BBmom", "confTrend"), "", "true"), ((*second, "BBmom"), "", "true")]
    return out + [Strategy(f"{(v := variant(*b, also=f'{also} AND {not_bad4}')).name.removesuffix(' noTP')}{more} noTP+4regFilter", v.signal, v.gate, v.mode) for b, more, also in top5]


def champion_pairs() -> list[tuple[Strategy, Strategy]]:
    """The five best variants, each before and after the filter by four regimes."""
    after = [s for s in batch_run() if s.name.endswith("+4regFilter")]
    return [(Strategy(s.name.removesuffix("+4regFilter"), s.signal, s.gate.removesuffix(f" AND regime NOT IN {BAD4!r}"), s.mode), s) for s in after]


def signals(f: DataFrame, strategies: list[Strategy], kept: tuple[str, ...] = ("ticker", "w", "pos", "pred_ts", "entry_close", "entry_open", "g_tp", "g_sl", "horizon")) -> DataFrame:
    """One row per strategy and window with a signal other than 0; narrow."""
    # Each distinct signal becomes one column, so that expressions stay small however many variants use it.
    column = {s: f"__sig{k}" for k, s in enumerate(dict.fromkeys(s.signal for s in strategies))}
    f = f.withColumns({name: F.expr(signal) for signal, name in column.items()})
    rows = []
    for s in strategies:
        sig = column[s.signal]
        gated = s.gate.replace("sig ", f"{sig} ")
        value = F.expr(f"CASE WHEN {gated} THEN {sig} ELSE 0 END")
        rows.append(F.struct(F.lit(s.name).alias("strategy"), value.cast("int").alias("sig"), F.lit(s.mode).alias("mode")))
    return f.select(*kept, F.explode(F.filter(F.array(*rows), lambda x: x["sig"] != 0)).alias("s")).select(*kept, "s.*")


def batch_signals(f: DataFrame, strategies: list[Strategy]) -> DataFrame:
    """:func:`signals` over :func:`batch_features`; those of mode "weighted" have the confidence-weighted levels."""
    s = signals(f, strategies, ("ticker", "w", "pos", "pred_ts", "entry_close", "entry_open", "g_tp", "g_sl", "g_tp_w", "g_sl_w", "horizon"))
    weighted = F.col("mode") == "weighted"
    return s.withColumns({level: F.when(weighted, F.col(f"{level}_w")).otherwise(F.col(level)) for level in ("g_tp", "g_sl")}).drop("g_tp_w", "g_sl_w")


def apply_filters(sig: Column, *flags: Column) -> Column:
    """The signal where all flags hold, else 0."""
    ok = F.lit(True)
    for flag in flags:
        ok &= flag
    return F.when(true(ok), sig).otherwise(F.lit(0))


def regimes(f: DataFrame) -> DataFrame:
    """Label of each window's regime: volatility, place in the band, width moving."""
    w = by_window()
    vol = F.when(F.col("bb_width") >= F.col("wf_width"), "high_vol").otherwise("low_vol")
    place = F.when(F.col("bb_pct") < 0.3, "oversold").when(F.col("bb_pct") > 0.7, "overbought").otherwise("middle")
    moving = F.when(F.coalesce(F.col("bb_width") > F.lag("bb_width").over(w), F.lit(True)), "expanding").otherwise("contracting")
    return f.withColumn("regime", F.concat_ws("_", vol, place, moving))
