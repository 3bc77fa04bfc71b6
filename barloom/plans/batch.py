"""The batch run of all strategies, with gates written out in SQL by hand (survey T1-T4, T13, T14)."""

from __future__ import annotations

from barloom.config import SHORT
from barloom.operators import reports, signals, simulate
from barloom.plans.base import BY_BAR_SQL, bars, r
from barloom.plans.registry import query
from barloom.plans.trading import FEATURE_SQL, LK, METRICS_SQL, PER_BAR_SQL, PL, S, TRADES_SQL, _bounds_sql, feats

_V = "PARTITION BY ticker ORDER BY w"


def _confident(level: str) -> str:
    """Mean return of the samples above a confidence, else of all."""
    return f"coalesce(list_avg(list_transform(list_filter(range(1, {S + 1}), lambda i: cps[i] > {level}::DOUBLE), lambda i: rets[i])), list_avg(rets))"


def _ratio(k: str) -> str:
    return f"CASE WHEN g_tp - entry_close > {k}::DOUBLE * (entry_close - g_sl) THEN 1 WHEN entry_close - g_sl > {k}::DOUBLE * (g_tp - entry_close) THEN -1 ELSE 0 END"


def _beyond(value: str, bounds: str) -> str:
    return f"CASE WHEN {value} > {bounds}_hi THEN 1 WHEN {value} < {bounds}_lo THEN -1 ELSE 0 END"


def _weighted_level(q: str) -> str:
    """Value at a share of the weights, between the middles of the sorted values' weights."""
    return f"""SELECT e.ticker, e.w, CASE WHEN lo IS NULL THEN b.v WHEN hi IS NULL THEN a.v ELSE a.v + (b.v - a.v) * ({q} - a.mid) / (b.mid - a.mid) END AS level
               FROM (SELECT ticker, w, max(k) FILTER (mid <= {q}) AS lo, min(k) FILTER (mid > {q}) AS hi FROM wm GROUP BY 1, 2) e
               LEFT JOIN wm a ON a.ticker = e.ticker AND a.w = e.w AND a.k = e.lo LEFT JOIN wm b ON b.ticker = e.ticker AND b.w = e.w AND b.k = e.hi"""


_BASES_SQL = f"""{FEATURE_SQL}, pc AS (
    SELECT ticker, bar_ix, lag(close) OVER ({BY_BAR_SQL}) AS close_before FROM bars
), wm AS (
    SELECT ticker, w, v, row_number() OVER o AS k, sum(wt) OVER (o ROWS UNBOUNDED PRECEDING) - wt / 2 AS mid
    FROM (SELECT ticker, w, last[i] AS v, weights[i] AS wt FROM feats, unnest(range(1, {S + 1})) u(i)) WINDOW o AS (PARTITION BY ticker, w ORDER BY v, wt)
), up AS ({_weighted_level("0.8")}), dw AS ({_weighted_level("0.2")}),
g0 AS (
    SELECT f.*, close_before, up.level AS g_tp_w, dw.level AS g_sl_w, {_confident("0.6")} AS d6_ret, {_confident("0.8")} AS d8_ret, {_confident("1.0")} AS d10_ret,
           {", ".join(f"count(*) FILTER (conf >= {t}::DOUBLE) OVER (PARTITION BY f.ticker) AS sure_{n}" for t, n in (("0.2", 20), ("0.3", 30), ("0.4", 40), ("0.45", 45), ("0.5", 50), ("0.55", 55), ("0.6", 60)))}
    FROM feats f JOIN pc ON pc.ticker = f.ticker AND pc.bar_ix = f.bar_ix JOIN up ON up.ticker = f.ticker AND up.w = f.w JOIN dw ON dw.ticker = f.ticker AND dw.w = f.w
), g1 AS (
    SELECT *, {_bounds_sql("d6_ret", "d6")}, {_bounds_sql("d8_ret", "d8")}, {_bounds_sql("d10_ret", "d10")} FROM g0
), g2 AS (
    SELECT *, {_beyond("pred_ret", "wf")} AS wf, {_beyond("w_ret", "wq")} AS h2, {_beyond("best_ret", "bq")} AS h4, {_beyond("drop_ret", "dq")} AS h5, {_beyond("d6_ret", "d6")} AS h5_6, {_beyond("d8_ret", "d8")} AS h5_8,
           {_beyond("d10_ret", "d10")} AS h5_10, {_ratio("1.0")} AS v1, {_ratio("1.5")} AS v15, {_ratio("2.0")} AS v2, {_ratio("3.0")} AS v3, {_ratio("5.0")} AS v5,
           CASE WHEN bb_width >= wf_width THEN 'high' ELSE 'low' END AS vol_now, CASE WHEN bb_pct < 0.3::DOUBLE THEN 'low' WHEN bb_pct > 0.7::DOUBLE THEN 'high' WHEN bb_pct < 0.7::DOUBLE THEN 'mid' ELSE 'edge' END AS place_now
    FROM g1
), g3 AS (
    SELECT *, lag(vol_now) OVER v AS vol_was, lag(place_now) OVER v AS place_was, lag(bb_mom) OVER v AS wider_was, CASE WHEN wf = 1 THEN g_sl ELSE g_tp END AS x_sl, CASE WHEN wf = 1 THEN g_tp ELSE g_sl END AS x_tp,
           n_bars - {LK + PL} - w AS most
    FROM g2 WINDOW v AS ({_V})
), g4 AS (
    SELECT *, coalesce(nullif(list_position(list_transform(horizon, lambda b: CASE WHEN wf = 1 THEN b.low <= x_sl ELSE b.high >= x_sl END), true), 0), 99) AS k_sl,
           coalesce(nullif(list_position(list_transform(horizon[2:], lambda b: CASE WHEN wf = 1 THEN b.high >= x_tp ELSE b.low <= x_tp END), true), 0) + 1, 99) AS k_tp
    FROM g3
), g5 AS (
    SELECT *, wf <> 0 AND CASE WHEN least(k_sl, k_tp) <= least({PL}, most) THEN wf * (CASE WHEN k_sl <= k_tp THEN x_sl ELSE x_tp END - entry_open) > 0 WHEN most >= {PL} THEN wf * (horizon[{PL}].close - entry_open) > 0 ELSE false END AS won
    FROM g4
), g6 AS (
    SELECT *, wf = 0 OR sum(won::INT) OVER b / greatest(sum((wf <> 0)::INT) OVER b, 1) >= 0.5 AS roll_ok,
           -- The first window has none before it: a wide band, the middle, expanding.
           coalesce(vol_was, 'high') = 'high' AND coalesce(place_was, 'mid') = 'low' AND coalesce(wider_was, true) AS was_bad,
           coalesce(vol_was, 'high') = 'high' AND coalesce(place_was, 'mid') = 'mid' AND NOT coalesce(wider_was, true) AS was_best,
           (coalesce(vol_was, 'high') = 'high' AND coalesce(place_was, 'mid') = 'high' AND NOT coalesce(wider_was, true)) OR (coalesce(vol_was, 'high') = 'high' AND coalesce(place_was, 'mid') = 'low')
               OR (coalesce(vol_was, 'high') = 'low' AND coalesce(place_was, 'mid') = 'low' AND coalesce(wider_was, true)) AS was_bad4
    FROM g5 WINDOW b AS ({_V} ROWS BETWEEN 50 PRECEDING AND CURRENT ROW)
)"""

# Gates by the words of the labels; {s} is the signal they let pass.
_GATES = {
    "BBwidth": "bb_width >= wf_width",
    "BB%B": "({s} = 1 AND bb_pct <= 0.3::DOUBLE OR {s} = -1 AND bb_pct >= 0.7::DOUBLE)",
    "BBtouch": "({s} = 1 AND touch_lower OR {s} = -1 AND touch_upper)",
    "LRr2": "lr_r2 >= wf_r2",
    "LR%B": "({s} = 1 AND lr_pct <= 0.3::DOUBLE OR {s} = -1 AND lr_pct >= 0.7::DOUBLE)",
    "LRr2%B": "lr_r2 >= wf_r2 AND ({s} = 1 AND lr_pct <= 0.3::DOUBLE OR {s} = -1 AND lr_pct >= 0.7::DOUBLE)",
    "ATR": "atr_sma >= wf_atr",
    "vol": "volume >= wf_vol",
    "BBmom": "bb_mom",
    "confTrend": "conf_up",
    "mcSmall": "(w <= 10 OR mc_std < wf_mc)",
    "mcBig": "(w <= 10 OR mc_std > wf_mc)",
    "rsi14": "NOT ({s} = 1 AND rsi14 > 70 OR {s} = -1 AND rsi14 < 30)",
    "zGt1": "abs(pred_z) > 1",
    "rollWR": "roll_ok",
    "rsiExtreme": "({s} = 1 AND rsi14 < 30 OR {s} = -1 AND rsi14 > 70)",
}
_BASES = {"WF": ("wf", "true"), "H1≥5": ("wf", "agree >= 5"), "H5<0.4": ("h5", "true"), "H5": ("h5", "true"), "V>3.0": ("v3", "true")}


def _named(label: str, extra: str = "true", shown: str | None = None) -> tuple[str, str, str, str]:
    """Label, signal, gate and level mode of a label that spells them out."""
    mode = "no_tp" if label.endswith(" noTP") else "no_sl" if label.endswith(" noSL") else "default"
    base, *words = label.removesuffix(" noTP").removesuffix(" noSL").split("+")
    signal, gate = _BASES[base]
    return shown or label, signal, " AND ".join((gate, extra, *(_GATES[w].format(s=signal) for w in words))), mode


_EVERY_BASE = ("WF", "H1≥5", "H5<0.4", "V>3.0")
_STRATEGIES = [
    ("wf (FIX)", "wf", "true", "default"),
    *((f"wf+conf≥{t}", "wf", f"conf >= {t}::DOUBLE AND sure_{n} >= 30", "default") for t, n in (("0.20", 20), ("0.30", 30), ("0.40", 40), ("0.45", 45), ("0.50", 50), ("0.55", 55), ("0.60", 60))),
    ("H1: MC agree≥3", "wf", "agree >= 3", "default"),
    ("H1: MC agree≥5", "wf", "agree >= 5", "default"),
    ("H2: weighted by conf", "h2", "true", "weighted"),
    *((f"V: TP/SL ratio>{k}", s, "true", "default") for k, s in (("1.0", "v1"), ("1.5", "v15"), ("2.0", "v2"), ("3.0", "v3"), ("5.0", "v5"))),
    ("V+WF: ratio>3.0", "v3", "CASE WHEN v3 = 1 THEN entry_close > close_before ELSE NOT entry_close > close_before END", "default"),
    ("H4: best MC", "h4", "true", "default"),
    *((f"H5: drop MC<{t} conf", s, "true", "default") for t, s in (("0.4", "h5"), ("0.6", "h5_6"), ("0.8", "h5_8"), ("1.0", "h5_10"))),
    ("H1×V: agree≥5 + ratio>3.0", "wf", "agree >= 5 AND v3 = wf", "default"),
    *(_named(f"{b}+{g}") for b in _EVERY_BASE for g in ("BBwidth", "BB%B", "BBtouch")),
    *(_named(f"{b}+BBwidth noSL") for b in _EVERY_BASE),
    _named("V>3.0 noSL"),
    *(_named(f"{b} noTP") for b in _EVERY_BASE),
    *(_named(f"{b}+BBwidth noTP") for b in _EVERY_BASE),
    *(_named(f"{b}+BB%B noTP") for b in ("WF", "V>3.0")),
    *(_named(f"{b}+{g} noTP") for b in _EVERY_BASE for g in ("LRr2", "LR%B", "LRr2%B", "ATR", "vol", "BBmom")),
    *(_named(f"WF+BB%B+{g} noTP") for g in ("ATR", "vol", "BBmom", "ATR+vol", "BBmom+vol")),
    *(_named(f"H5<0.4+BBwidth+{g} noTP") for g in ("ATR", "vol", "BBmom", "ATR+vol", "BBmom+vol")),
    _named("H5<0.4+BBmom+vol noTP"),
    _named("WF+BBmom+vol noTP"),
    *(_named(f"WF+BB%B+BBmom+{g} noTP") for g in ("confTrend", "mcSmall", "mcBig", "rsi14", "zGt1", "rollWR", "rsiExtreme", "confTrend+mcSmall", "zGt1+rsi14", "confTrend+mcSmall+rsi14")),
    *(_named(f"H5+BBwidth+BBmom+{g} noTP") for g in ("confTrend", "mcSmall", "confTrend+mcSmall+rsi14")),
    _named("WF noTP", "NOT was_bad", "WF+skipBadReg noTP"),
    _named("WF noTP", "was_best", "WF+onlyBestReg noTP"),
    _named("WF+BB%B noTP", "NOT was_bad", "WF+BB%B+skipBadReg noTP"),
    *(_named(f"{b} noTP", "NOT was_bad4", f"{b} noTP+4regFilter") for b in ("WF+BB%B+BBmom", "WF+BB%B+BBmom+vol", "WF+BB%B+BBmom+confTrend", "H5<0.4+BBwidth+BBmom")),
    # Here a spread equal to the median passes.
    _named("WF+BB%B+BBmom noTP", "NOT was_bad4 AND (w <= 10 OR mc_std >= wf_mc)", "WF+BB%B+BBmom+mcBig noTP+4regFilter"),
]
_ROWS = ", ".join(f"{{'strategy': '{n}', 'sig': CASE WHEN coalesce({gate}, false) THEN {s} ELSE 0 END, 'mode': '{mode}'}}" for n, s, gate, mode in _STRATEGIES)
_SIGNALS_SQL = f"""{_BASES_SQL}, g7 AS (SELECT *, unnest([{_ROWS}]) AS sg FROM g6), sigs AS (
    SELECT * REPLACE (CASE WHEN sg.mode = 'weighted' THEN g_tp_w ELSE g_tp END AS g_tp, CASE WHEN sg.mode = 'weighted' THEN g_sl_w ELSE g_sl END AS g_sl), sg.strategy AS strategy, sg.sig AS sig, sg.mode AS mode
    FROM g7 WHERE sg.sig <> 0
)"""


@query("t13_batch_signals", f"WITH {_SIGNALS_SQL} SELECT strategy, ticker, w, sig::INT AS sig, round(g_tp, 5) AS g_tp, round(g_sl, 5) AS g_sl FROM sigs")
def t13_signals(spark, sf):
    """Every signal of the batch run, with the levels it trades by."""
    f = signals.batch_features(feats(spark, sf), SHORT)
    return signals.batch_signals(f, signals.batch_run()).select("strategy", "ticker", "w", "sig", r("g_tp", 5), r("g_sl", 5))


@query("t04_t13_t14_batch_run", f"WITH {_SIGNALS_SQL}, {TRADES_SQL}, {PER_BAR_SQL}, {METRICS_SQL} SELECT strategy, ticker, n_trades, round(win_rate, 6) AS win_rate, round(total_return, 6) AS total_return, round(total_pnl, 6) AS total_pnl, round(max_dd, 6) + 0.0 AS max_dd, round(mean_ret * {52 * 252}, 4) AS avg_return, round(sharpe, 3) AS sharpe FROM mt")
def t04(spark, sf):
    """Every variant of the batch run with its regime variants in one pass; all rows."""
    strategies = signals.batch_run()
    trades = simulate.simulate(signals.batch_signals(signals.batch_features(feats(spark, sf), SHORT), strategies))
    return reports.trade_metrics(trades, bars(spark, sf)).select("strategy", "ticker", "n_trades", r("win_rate"), r("total_return"), r("total_pnl"), r("max_dd"), r("avg_return", 4), r("sharpe", 3))


_TOP = ("WF+BB%B+BBmom", "WF+BB%B+BBmom+vol", "WF+BB%B+BBmom+confTrend", "H5<0.4+BBwidth+BBmom")
_WIDE_MC = "(w <= 10 OR mc_std >= wf_mc)"
_PAIRS = [
    *(p for b in _TOP for p in (_named(f"{b} noTP"), _named(f"{b} noTP", "NOT was_bad4", f"{b} noTP+4regFilter"))),
    _named("WF+BB%B+BBmom noTP", _WIDE_MC, "WF+BB%B+BBmom+mcBig noTP"),
    _named("WF+BB%B+BBmom noTP", f"NOT was_bad4 AND {_WIDE_MC}", "WF+BB%B+BBmom+mcBig noTP+4regFilter"),
]
_CHAMPION_SQL = _SIGNALS_SQL.replace(_ROWS, ", ".join(f"{{'strategy': '{n}', 'sig': CASE WHEN coalesce({gate}, false) THEN {s} ELSE 0 END, 'mode': '{mode}'}}" for n, s, gate, mode in _PAIRS))


@query(
    "t15_before_and_after",
    f"""WITH {_CHAMPION_SQL}, {TRADES_SQL}, {PER_BAR_SQL}, q AS (SELECT *, year(ts)::VARCHAR || '-Q' || quarter(ts)::VARCHAR AS quarter FROM per_bar WHERE ret <> 0),
        ql AS (SELECT strategy, coalesce(quarter, 'overall') AS quarter, count(*) AS n, avg(ret) AS ar, coalesce(sum(ret) FILTER (ret > 0), 0) / greatest(abs(coalesce(sum(ret) FILTER (ret < 0), 0)), 1e-12) AS pf, avg((ret > 0)::INT) AS wr
               FROM q GROUP BY ROLLUP (strategy, quarter) HAVING strategy IS NOT NULL), t AS (SELECT * FROM ql WHERE n >= CASE WHEN quarter = 'overall' THEN 6 ELSE 5 END)
        SELECT a.strategy, a.quarter, round(a.ar, 6) + 0.0 AS aver_ret_before, round(coalesce(b.ar, 0), 6) + 0.0 AS aver_ret_after, round(coalesce(b.ar, 0) - a.ar, 6) + 0.0 AS aver_ret_delta, round(a.pf, 3) AS profit_factor_before, round(coalesce(b.pf, 0), 3) AS profit_factor_after,
               round(coalesce(b.pf, 0) - a.pf, 3) + 0.0 AS profit_factor_delta, round(a.wr, 6) AS win_rate_before, round(coalesce(b.wr, 0), 6) AS win_rate_after, round(coalesce(b.wr, 0) - a.wr, 6) + 0.0 AS win_rate_delta
        FROM t a LEFT JOIN t b ON b.strategy = a.strategy || '+4regFilter' AND b.quarter = a.quarter WHERE a.strategy NOT LIKE '%4regFilter'""",
)
def t15_before_and_after(spark, sf):
    """The champion's breakdown: average return, profit factor and win rate of the five best by quarter, before and after the filter by regimes."""
    pairs = signals.champion_pairs()
    strategies = [s for p in pairs for s in p]
    trades = simulate.simulate(signals.batch_signals(signals.batch_features(feats(spark, sf), SHORT), strategies))
    pb = simulate.per_bar(trades, bars(spark, sf), [s.name for s in strategies])
    found = reports.before_and_after(pb, [(a.name, b.name) for a, b in pairs])
    return found.select("strategy", "quarter", *[r(c, 3 if c.startswith("profit") else 6) for c in found.columns if c not in ("strategy", "quarter")])
