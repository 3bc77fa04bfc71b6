"""Queries over forecast windows, sample paths, signals, trades and their metrics (survey §2.4, 2.5, 2.7-2.9)."""

from __future__ import annotations


from pyspark.sql import DataFrame, functions as F

from barloom.config import SHORT
from barloom.functions import metrics as m, normal
from barloom.operators import atoms, forecast, reports, signals, simulate, windows
from barloom.plans.base import BARS_SQL, BY_BAR_SQL, bars, r
from barloom.plans.registry import query

LK, PL, S = SHORT.lookback, SHORT.pred_len, SHORT.samples


def _path_sql(s: int) -> str:
    back = PL * (s + 1)
    lag = lambda k: f"lag(close, {k}) OVER w" if k else "close"
    return "[" + ", ".join(f"close * {lag(back - h)} / {lag(back)}" for h in range(1, PL + 1)) + "]"


_N = LK - 1
WIN_SQL = f"""{BARS_SQL}, bb0 AS (
    SELECT *, avg(close) OVER r20 AS bb_mid, coalesce(stddev_samp(close) OVER r20, 0.0) AS bb_std, CASE WHEN count(*) OVER r20 > 1 THEN regr_slope(close, bar_ix) OVER r20 ELSE 0.0 END AS slope,
           regr_sxx(close, bar_ix) OVER r20 AS sxx, regr_syy(close, bar_ix) OVER r20 AS syy, avg(bar_ix) OVER r20 AS mx, close - lag(close) OVER w AS d,
           CASE WHEN lag(close) OVER w IS NULL THEN 0.0 ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr
    FROM bars WINDOW w AS ({BY_BAR_SQL}), r20 AS ({BY_BAR_SQL} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
), bb1 AS (
    SELECT *, (bb_mid + 2 * bb_std - (bb_mid - 2 * bb_std)) / greatest(bb_mid, 1e-10) AS bb_width, (close - (bb_mid - 2 * bb_std)) / greatest(bb_mid + 2 * bb_std - (bb_mid - 2 * bb_std), 1e-10) AS bb_pct,
           close <= bb_mid - 2 * bb_std + 0.5 * bb_std AS touch_lower, close >= bb_mid + 2 * bb_std - 0.5 * bb_std AS touch_upper, greatest(syy - slope * slope * sxx, 0.0) AS ssr,
           avg(tr) OVER r14 AS atr_sma, avg(greatest(d, 0.0)) OVER r14 AS g14, avg(greatest(-d, 0.0)) OVER r14 AS l14 FROM bb0 WINDOW r14 AS ({BY_BAR_SQL} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)
), win AS (
    SELECT *, bar_ix AS pos, bar_ix - {_N} AS w, close AS entry_close, lead(open) OVER w AS entry_open, lead(ts) OVER w AS pred_ts, (lead(close, {PL}) OVER w - close) / greatest(close, 1e-8) AS actual_ret,
           count(*) OVER (PARTITION BY ticker) AS n_bars, list({{'open': open, 'high': high, 'low': low, 'close': close}}) OVER ({BY_BAR_SQL} ROWS BETWEEN 1 FOLLOWING AND {PL} FOLLOWING) AS horizon,
           [{", ".join(_path_sql(s) for s in range(S))}] AS paths, 1 - ssr / greatest(syy, 1e-10) AS lr_r2, bb_mid + slope * (bar_ix - mx) AS lr_mid, sqrt(ssr / 18) AS lr_std,
           CASE WHEN bar_ix < 14 THEN 50.0 WHEN l14 = 0 THEN 100.0 ELSE 100 - 100 / (1 + g14 / l14) END AS rsi14
    FROM bb1 WINDOW w AS ({BY_BAR_SQL})
), wins AS (
    SELECT *, (close - (lr_mid - 2 * lr_std)) / greatest(4 * lr_std, 1e-10) AS lr_pct, strftime(pred_ts, '%Y-%m') AS month, year(pred_ts)::VARCHAR || '-Q' || quarter(pred_ts)::VARCHAR AS quarter
    FROM win WHERE w >= 0 AND pos <= n_bars - {PL} - 1
)"""

_LONGEST = 6 * S + PL - 1
BELIEF_SQL = f"""rc AS (SELECT ticker, bar_ix, coalesce(close / greatest(lag(close) OVER w, 1e-10) - 1, 0.0) AS ret FROM bars WINDOW w AS ({BY_BAR_SQL})),
rk AS (SELECT *, greatest(-5, least(5, floor(ret / 0.02::DOUBLE)))::INT AS code, greatest(-20, least(20, floor(ret / 0.005::DOUBLE)))::INT AS fine FROM rc),
rl AS (SELECT ticker, bar_ix, list(code) OVER q AS codes, list(fine) OVER q AS fines FROM rk WINDOW q AS ({BY_BAR_SQL} ROWS BETWEEN {_LONGEST - 1} PRECEDING AND CURRENT ROW)),
rx AS (SELECT *, unnest(range({S * PL})) AS k FROM rl WHERE len(codes) = {_LONGEST}),
rz AS (SELECT ticker, bar_ix, (k // {PL})::INT AS s, (k % {PL})::INT AS h, codes[len(codes) - (6 * (k // {PL} + 1) + k % {PL}) + 1:] AS c, fines[len(codes) - (6 * (k // {PL} + 1) + k % {PL}) + 1:] AS f FROM rx),
rp AS (SELECT *, list_transform(list_distinct(c), lambda x: len(list_filter(c, lambda y: y = x)) / len(c)) AS p, list_transform(list_distinct(f), lambda x: len(list_filter(f, lambda y: y = x)) / len(f)) AS q FROM rz),
beliefs AS (
    SELECT ticker, bar_ix, s, h, list_max(p) AS confidence, -list_sum(list_transform(p, lambda x: x * log2(x))) AS entropy_s1, list_sum(list_reverse_sort(p)[1:3]) AS top3_mass,
           -list_sum(list_transform(q, lambda x: x * log2(x))) / (-list_sum(list_transform(p, lambda x: x * log2(x))) + 1e-10) AS entropy_ratio FROM rp
), confs AS (SELECT ticker, bar_ix, avg(c) AS conf, list(c ORDER BY s) AS cps FROM (SELECT ticker, bar_ix, s, avg(confidence) AS c FROM beliefs GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


def _bounds_sql(column: str, name: str) -> str:
    q = lambda p, frame: f"quantile_cont({column}, {p}) OVER (PARTITION BY ticker ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND {frame})"
    side = lambda p, first: f"CASE WHEN w <= 10 THEN {first} WHEN w < 100 THEN {q(p, 'CURRENT ROW')} ELSE {q(p, '1 PRECEDING')} END"
    return f"{side(0.9, 0.001)} AS {name}_hi, {side(0.1, -0.001)} AS {name}_lo"


def _median_sql(column: str, name: str) -> str:
    return f"CASE WHEN w <= 10 THEN 0.001 ELSE quantile_cont({column}, 0.5) OVER (PARTITION BY ticker ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS {name}"


FEATURE_SQL = f"""{WIN_SQL}, {BELIEF_SQL}, f0 AS (
    SELECT wins.*, conf, cps, list_transform(paths, lambda p: p[{PL}]) AS last FROM wins JOIN confs USING (ticker, bar_ix)
), f1 AS (
    SELECT *, list_transform(last, lambda x: (x - entry_close) / greatest(entry_close, 1e-8)) AS rets, (list_sum(last) / len(last) - entry_close) / greatest(entry_close, 1e-8) AS pred_ret,
           list_aggregate(last, 'quantile_cont', 0.8) AS g_tp, list_aggregate(last, 'quantile_cont', 0.2) AS g_sl, list_aggregate(last, 'stddev_pop') AS mc_std,
           abs(list_sum(list_transform(last, lambda x: sign(x - entry_close)))) AS agree, list_transform(cps, lambda x: x / (list_sum(cps) + 1e-8)) AS weights, coalesce(conf > lag(conf) OVER v, true) AS conf_up
    FROM f0 WINDOW v AS (PARTITION BY ticker ORDER BY w)
), f2 AS (
    SELECT *, list_sum(list_transform(range(1, {S + 1}), lambda i: rets[i] * weights[i])) AS w_ret, rets[list_position(cps, list_max(cps))] AS best_ret,
           coalesce(list_avg(list_transform(list_filter(range(1, {S + 1}), lambda i: cps[i] > 0.4::DOUBLE), lambda i: rets[i])), list_avg(rets)) AS drop_ret,
           coalesce(bb_width > lag(bb_width) OVER v AND lag(bb_width) OVER v > lag(bb_width, 2) OVER v, false) AS bb_mom,
           CASE WHEN w > 20 THEN (pred_ret - avg(pred_ret) OVER past) / greatest(stddev_pop(pred_ret) OVER past, 1e-10) ELSE 0.5 END AS pred_z
    FROM f1 WINDOW v AS (PARTITION BY ticker ORDER BY w), past AS (PARTITION BY ticker ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f3 AS (
    SELECT *, {_median_sql("bb_width", "wf_width")}, {_median_sql("lr_r2", "wf_r2")}, {_median_sql("atr_sma", "wf_atr")}, {_median_sql("volume", "wf_vol")}, {_median_sql("mc_std", "wf_mc")} FROM f2
), feats AS (
    SELECT *, CASE WHEN w > 10 THEN mc_std > wf_mc ELSE true END AS mc_big, CASE WHEN w > 10 THEN mc_std < wf_mc ELSE true END AS mc_small,
           {_bounds_sql("pred_ret", "wf")}, {_bounds_sql("w_ret", "wq")}, {_bounds_sql("best_ret", "bq")}, {_bounds_sql("drop_ret", "dq")} FROM f3
)"""


def _duck(expression: str) -> str:
    import re

    return re.sub(r"(\d+\.\d+)D\b", r"\1::DOUBLE", re.sub(r"(?<![\w.])(\d+\.\d+)(?![\dD])", r"\1::DOUBLE", expression))


def signals_sql(strategies: list[signals.Strategy]) -> str:
    rows = []
    for s in strategies:
        gated = s.gate.replace("sig ", f"{s.signal} ")
        rows.append(f"{{'strategy': '{s.name}', 'sig': CASE WHEN {_duck(gated)} THEN {_duck(s.signal)} ELSE 0 END, 'mode': '{s.mode}'}}")
    return f"sg0 AS (SELECT *, unnest([{', '.join(rows)}]) AS sg FROM feats), sigs AS (SELECT *, sg.strategy AS strategy, sg.sig AS sig, sg.mode AS mode FROM sg0 WHERE sg.sig <> 0)"


TRADES_SQL = f"""tr0 AS (
    SELECT *, CASE WHEN mode <> 'no_tp' THEN CASE WHEN sig = 1 THEN CASE WHEN g_tp > entry_close THEN g_tp END ELSE CASE WHEN g_sl < entry_close THEN g_sl END END END AS tp,
           CASE WHEN mode <> 'no_sl' THEN CASE WHEN sig = 1 THEN CASE WHEN g_sl < entry_close THEN g_sl END ELSE CASE WHEN g_tp > entry_close THEN g_tp END END END AS sl FROM sigs WHERE entry_open > 0
), tr1 AS (
    SELECT *, coalesce(nullif(list_position(list_transform(horizon, lambda b: coalesce(CASE WHEN sig = 1 THEN b.low <= sl ELSE b.high >= sl END, false)), true), 0), {PL + 1}) AS a_sl,
           coalesce(nullif(list_position(list_transform(horizon, lambda b: coalesce(CASE WHEN sig = 1 THEN b.high >= tp ELSE b.low <= tp END, false)), true), 0), {PL + 1}) AS a_tp FROM tr0
), tr2 AS (
    SELECT *, CASE WHEN a_sl <= {PL} AND a_sl <= a_tp THEN 'sl' WHEN a_tp < a_sl THEN 'tp' ELSE 'close' END AS reason FROM tr1
), trades AS (
    SELECT *, CASE reason WHEN 'sl' THEN sl WHEN 'tp' THEN tp ELSE horizon[{PL}].close END AS exit_price, CASE reason WHEN 'sl' THEN a_sl WHEN 'tp' THEN a_tp ELSE {PL} END::INT AS holding,
           sig * (CASE reason WHEN 'sl' THEN sl WHEN 'tp' THEN tp ELSE horizon[{PL}].close END - entry_open) / entry_open AS ret FROM tr2
)"""

PER_BAR_SQL = """pb0 AS (SELECT strategy, ticker, pos + unnest(range(1, holding + 1)) AS bar_ix, ret / holding AS part FROM trades WHERE ret <> 0),
pb1 AS (SELECT strategy, ticker, bar_ix, sum(part) / count(*) AS ret FROM pb0 GROUP BY 1, 2, 3),
per_bar AS (
    SELECT sp.strategy, b.ticker, b.bar_ix, b.ts, coalesce(p.ret, 0.0) AS ret FROM (SELECT DISTINCT strategy, ticker FROM trades) sp JOIN bars b ON b.ticker = sp.ticker
    LEFT JOIN pb1 p ON p.strategy = sp.strategy AND p.ticker = b.ticker AND p.bar_ix = b.bar_ix
), eq0 AS (SELECT *, product(1 + ret) OVER (PARTITION BY strategy, ticker ORDER BY bar_ix) AS equity FROM per_bar),
eq AS (SELECT *, max(equity) OVER (PARTITION BY strategy, ticker ORDER BY bar_ix) AS peak FROM eq0)"""

_P = f"sqrt({52 * 252})"
METRICS_SQL = f"""mt0 AS (
    SELECT strategy, ticker, CASE WHEN count(*) < 2 THEN 0.0 ELSE {_P} * avg(ret) / (stddev_pop(ret) + 1e-8) END AS sharpe, sqrt(avg(least(ret, 0.0) * least(ret, 0.0))) AS down, avg(ret) AS mean_ret, count(*) AS n_all,
           count(*) FILTER (ret <> 0) AS n_trades, coalesce(sum(ret) FILTER (ret > 0), 0.0) / (abs(coalesce(sum(ret) FILTER (ret < 0), 0.0)) + 1e-8) AS profit_factor,
           coalesce(avg((ret > 0)::INT) FILTER (ret <> 0), 0.0) AS win_rate, min((equity - peak) / peak) AS max_dd, coalesce(avg(ret) FILTER (ret <> 0), 0.0) AS mu, stddev_pop(ret) FILTER (ret <> 0) AS sd,
           arg_max(equity, bar_ix) / arg_min(equity, bar_ix) - 1 AS total_return, sum(ret) AS total_pnl, avg(ret * ret * ret) FILTER (ret <> 0) AS m3, avg(ret * ret) FILTER (ret <> 0) AS m2, avg(ret * ret * ret * ret) FILTER (ret <> 0) AS m4 FROM eq GROUP BY 1, 2
), mt1 AS (
    SELECT *, (m3 - 3 * mu * m2 + 2 * mu ** 3) / sd ** 3 AS sk, (m4 - 4 * mu * m3 + 6 * mu ** 2 * m2 - 3 * mu ** 4) / sd ** 4 - 3 AS ku, mu / greatest(sd, 1e-12) AS sr FROM mt0
), mt2 AS (SELECT *, (1 + 0.5 * sr ** 2 - sk * sr + ku * sr ** 2 / 4) / greatest(n_trades - 1, 1) AS va FROM mt1),
mt AS (SELECT *, sr / (sqrt(greatest(va, 0.0)) + 1e-8) AS z FROM mt2)"""


def feats(spark, sf) -> DataFrame:
    return signals.features(bars(spark, sf), SHORT)


def run(spark, sf, strategies: list[signals.Strategy]) -> DataFrame:
    return simulate.simulate(signals.signals(feats(spark, sf), strategies))


def per_bar(spark, sf, strategies: list[signals.Strategy]) -> DataFrame:
    return simulate.per_bar(run(spark, sf, strategies), bars(spark, sf), [s.name for s in strategies])


_T14 = [signals.Strategy("WF", signals.WF), signals.Strategy("WF+pct_noTP", signals.WF, signals.PCT, "no_tp"), signals.Strategy("WF+pct+bbmom_noTP", signals.WF, f"{signals.PCT} AND bb_mom", "no_tp")]
_CHAIN = f"{FEATURE_SQL}, {signals_sql(_T14)}, {TRADES_SQL}, {PER_BAR_SQL}"


@query("w01_w03_sliding_windows", f"WITH {WIN_SQL} SELECT ticker, w, pos, pred_ts::VARCHAR AS pred_ts, month, quarter, entry_close, entry_open, round(actual_ret, 6) AS actual_ret FROM wins")
def w01(spark, sf):
    return windows.sliding_windows(bars(spark, sf), SHORT).select("ticker", "w", "pos", F.col("pred_ts").cast("string").alias("pred_ts"), "month", "quarter", "entry_close", "entry_open", r("actual_ret"))


@query(
    "w02_stepped_windows",
    f"""WITH {BARS_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY ticker) AS n_bars FROM bars)
        SELECT ticker, bar_ix AS first_ix, ts::VARCHAR AS pred_ts, strftime(ts, '%Y-%m') AS month FROM n
        WHERE n_bars - {LK + PL} > 0 AND bar_ix >= {LK} AND (bar_ix - {LK}) % {PL} = 0 AND bar_ix - {LK} <= n_bars - {LK + PL} AND ts BETWEEN '2024-01-01' AND '2024-01-25'""",
)
def w02(spark, sf):
    return windows.stepped_windows(bars(spark, sf), LK, PL, PL, "2024-01-01", "2024-01-25").withColumn("pred_ts", F.col("pred_ts").cast("string"))


@query("s17_samples", f"WITH {WIN_SQL} SELECT ticker, w, (s - 1)::INT AS s, (h - 1)::INT AS h, round(paths[s][h], 6) AS close FROM wins, unnest(range(1, {S + 1})) a(s), unnest(range(1, {PL + 1})) b(h)")
def s17(spark, sf):
    """Sample paths in long form."""
    b = forecast.get_forecaster("analog").transform(bars(spark, sf), SHORT)
    long = windows.sliding_windows(b, SHORT).select("ticker", "w", F.posexplode("paths").alias("s", "path")).select("ticker", "w", "s", F.posexplode("path").alias("h", "close"))
    return long.select("ticker", "w", "s", "h", r("close"))


@query(
    "w04_w05_w06_levels_and_bounds",
    f"""WITH {FEATURE_SQL} SELECT ticker, w, round(pred_ret, 6) AS pred_ret, round(g_tp, 5) AS g_tp, round(g_sl, 5) AS g_sl, round(conf, 6) AS conf, round(wf_hi, 6) AS wf_hi, round(wf_lo, 6) AS wf_lo FROM feats""",
)
def w04(spark, sf):
    return feats(spark, sf).select("ticker", "w", r("pred_ret"), r("g_tp", 5), r("g_sl", 5), r("conf"), r("wf_hi"), r("wf_lo"))


@query(
    "w25_w26_w27_w30_gates",
    f"""WITH {FEATURE_SQL} SELECT ticker, w, conf_up, mc_big, mc_small, round(pred_z, 5) AS pred_z, volume >= wf_vol AS volume_ok, bb_width >= wf_width AS width_ok, bb_mom FROM feats""",
)
def w25(spark, sf):
    f = feats(spark, sf)
    return f.select("ticker", "w", "conf_up", "mc_big", "mc_small", r("pred_z", 5), (F.col("volume") >= F.col("wf_vol")).alias("volume_ok"), (F.col("bb_width") >= F.col("wf_width")).alias("width_ok"), "bb_mom")


@query(
    "k09_beliefs",
    f"WITH {BARS_SQL}, {BELIEF_SQL} SELECT ticker, bar_ix, s, h, round(confidence, 6) AS confidence, round(entropy_s1, 6) AS entropy_s1, round(top3_mass, 6) AS top3_mass, round(CASE WHEN entropy_s1 > 1e-6 THEN entropy_ratio END, 5) AS entropy_ratio FROM beliefs",
)
def k09(spark, sf):
    b = forecast.beliefs(bars(spark, sf), SHORT)
    return b.select("ticker", "bar_ix", "s", "h", r("confidence"), r("entropy_s1"), r("top3_mass"), F.when(F.col("entropy_s1") > 1e-6, r("entropy_ratio", 5)).alias("entropy_ratio"))


def _consensus_sql(values: str = "v") -> str:
    return f"len(list_filter({values}, lambda x: x > entry_close)) / len({values}) AS up, len(list_filter({values}, lambda x: x < entry_close)) / len({values}) AS down"


@query(
    "m01_m02_m03_steps",
    f"""WITH {WIN_SQL}, st AS (SELECT *, h, list_transform(paths, lambda p: p[h]) AS v FROM wins, unnest(range(1, {PL + 1})) b(h)), q AS (
        SELECT *, {_consensus_sql()}, list_aggregate(v, 'quantile_cont', 0.8) AS hi, list_aggregate(v, 'quantile_cont', 0.2) AS lo FROM st)
        SELECT ticker, w, (h - 1)::INT AS h, round(up, 6) AS up, round(down, 6) AS down, CASE WHEN up >= 0.8 THEN 1 WHEN down >= 0.8 THEN -1 ELSE 0 END::INT AS dir, round(greatest(up, down), 6) AS strength,
               round(CASE WHEN hi > entry_close THEN hi END, 5) AS tp_long, round(CASE WHEN lo < entry_close THEN lo END, 5) AS sl_long FROM q""",
)
def m01(spark, sf):
    b = windows.sliding_windows(forecast.get_forecaster("analog").transform(bars(spark, sf), SHORT), SHORT)
    both = F.arrays_zip(atoms.consensus(F.col("paths"), F.col("entry_close")).alias("c"), atoms.boundaries(F.col("paths"), F.col("entry_close")).alias("b"))
    e = b.select("ticker", "w", F.posexplode(both).alias("h", "x"))
    return e.select("ticker", "w", "h", r(F.col("x.c.up")).alias("up"), r(F.col("x.c.down")).alias("down"), F.col("x.c.dir").alias("dir"), r(F.col("x.c.strength")).alias("strength"), r(F.col("x.b.tp_long"), 5).alias("tp_long"), r(F.col("x.b.sl_long"), 5).alias("sl_long"))


@query(
    "m04_m05_m06_m07_m09_m10_path_shape",
    f"""WITH {FEATURE_SQL}, sp AS (SELECT *, list_transform(range(1, {PL + 1}), lambda h: list_transform(paths, lambda p: (p[h] - entry_close) / entry_close)) AS by_step FROM feats),
        lin AS (SELECT ticker, w, avg(1 - greatest(syy - sxy * sxy / sxx, 0.0) / greatest(syy, 1e-10)) AS linearity FROM (
            SELECT ticker, w, s, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM (SELECT ticker, w, s, paths[s][h] AS y, h AS x FROM feats, unnest(range(1, {S + 1})) a(s), unnest(range(1, {PL + 1})) b(h)) GROUP BY 1, 2, 3) GROUP BY 1, 2)
        SELECT ticker, w, round(list_avg(list_transform(by_step, lambda v: list_aggregate(v, 'stddev_pop'))), 6) AS mean_std, round(abs(list_avg(list_transform(last, lambda x: sign(x - entry_close)))), 6) AS strength,
               round(list_avg(by_step[{PL}]), 6) AS mean_ret, CASE WHEN mc_std > 1e-6 THEN round(linearity, 5) END AS linearity, round(coalesce(list_avg(list_filter(by_step[{PL}], lambda x: x > 0)), 0.0), 6) AS up_ret,
               round(coalesce(-list_avg(list_filter(by_step[{PL}], lambda x: x < 0)), 0.0), 6) + 0.0 AS down_ret, CASE WHEN list_avg(by_step[{PL}]) > 0 THEN 1 ELSE -1 END::INT AS dir,
               CASE WHEN mc_std > 1e-6 THEN round(list_avg(list_transform(by_step, lambda v: list_avg(v) / (list_aggregate(v, 'stddev_pop') + 1e-10))), 4) END AS expectancy, agree::INT AS agree FROM sp JOIN lin USING (ticker, w)""",
)
def m04(spark, sf):
    f = feats(spark, sf)
    spread = lambda c: F.when(F.col("mc_std") > 1e-6, c)
    p, c = F.col("paths"), F.col("entry_close")
    f = f.withColumn("d", atoms.dispersion(p, c)).withColumn("t", atoms.trend_strength(p, c)).withColumn("a", atoms.asymmetry(p, c))
    return f.select(
        "ticker", "w", r(F.col("d.mean_std")).alias("mean_std"), r(F.col("t.strength")).alias("strength"), r(F.col("a.mean_ret")).alias("mean_ret"), spread(r(atoms.linearity(p), 5)).alias("linearity"),
        r(F.col("a.up")).alias("up_ret"), r(F.col("a.down")).alias("down_ret"), F.col("a.dir").alias("dir"), spread(r(atoms.expectancy(p, c), 4)).alias("expectancy"), F.col("agree").cast("int").alias("agree"),
    )


@query(
    "m08_belief_weight",
    f"""WITH {BARS_SQL}, {BELIEF_SQL}, a AS (
        SELECT ticker, bar_ix, avg(confidence) FILTER (h = 0 AND s < 3) AS ci, avg(entropy_s1) FILTER (h < 2) AS ei, avg(entropy_s1) FILTER (h = {PL - 1}) AS et, avg(top3_mass) FILTER (h = {PL - 1}) AS tt, abs(avg(entropy_ratio) - 1) AS rd
        FROM beliefs GROUP BY 1, 2)
        SELECT ticker, bar_ix, round(greatest(0.0, least(2.0, ci * (1 - greatest(0.0, least(1.0, et / 10)) * 0.3) * greatest(0.5, least(1.5, tt / 0.5)) * 2)), 6) AS belief_score,
               (et - ei > greatest(ei * 1.5, 1.5)) OR (rd > 0.5 AND et - ei > 1) AS early_exit FROM a""",
)
def m08(spark, sf):
    return atoms.belief_weight(forecast.beliefs(bars(spark, sf), SHORT), ["ticker", "bar_ix"]).select("ticker", "bar_ix", r("belief_score"), "early_exit")


@query(
    "m11_m12_m13_m14_m15_weighted",
    f"""WITH {FEATURE_SQL}, pr AS (SELECT ticker, w, rets[i] AS v, weights[i] AS wt FROM feats, unnest(range(1, {S + 1})) a(i)),
        pt AS (SELECT ticker, w, v, sum(wt) OVER (PARTITION BY ticker, w ORDER BY v, wt ROWS UNBOUNDED PRECEDING) - wt / 2 AS at_w, row_number() OVER (PARTITION BY ticker, w ORDER BY v, wt) AS k FROM pr),
        ed AS (SELECT ticker, w, max(k) FILTER (at_w <= 0.8) AS lo, min(k) FILTER (at_w > 0.8) AS hi FROM pt GROUP BY 1, 2),
        wq AS (SELECT e.ticker, e.w, CASE WHEN lo IS NULL THEN b.v WHEN hi IS NULL THEN a.v ELSE a.v + (b.v - a.v) * (0.8 - a.at_w) / (b.at_w - a.at_w) END AS q80
               FROM ed e LEFT JOIN pt a ON a.ticker = e.ticker AND a.w = e.w AND a.k = e.lo LEFT JOIN pt b ON b.ticker = e.ticker AND b.w = e.w AND b.k = e.hi)
        SELECT ticker, w, round(w_ret, 6) AS w_ret, round(q80, 6) AS w_q80, round(best_ret, 6) AS best_ret, round(drop_ret, 6) AS drop_ret, g_tp > entry_close AS can_long, g_sl < entry_close AS can_short FROM feats JOIN wq USING (ticker, w)""",
)
def m11(spark, sf):
    f = feats(spark, sf).withColumn("w_q80", atoms.weighted_quantile(F.col("rets"), F.col("weights"), 0.8))
    return f.select("ticker", "w", r("w_ret"), r("w_q80"), r("best_ret"), r("drop_ret"), (F.col("g_tp") > F.col("entry_close")).alias("can_long"), (F.col("g_sl") < F.col("entry_close")).alias("can_short"))


@query("f08_f09_f10_filters", f"WITH {FEATURE_SQL}, {signals_sql([signals.Strategy('pct', signals.WF, signals.PCT), signals.Strategy('width', signals.WF, signals.WIDTH), signals.Strategy('touch', signals.WF, signals.TOUCH)])} SELECT strategy, ticker, w, sig::INT AS sig FROM sigs")
def f08(spark, sf):
    chosen = [signals.Strategy("pct", signals.WF, signals.PCT), signals.Strategy("width", signals.WF, signals.WIDTH), signals.Strategy("touch", signals.WF, signals.TOUCH)]
    return signals.signals(feats(spark, sf), chosen).select("strategy", "ticker", "w", "sig")


@query(
    "f07_filter_chain",
    f"""WITH {FEATURE_SQL}, {signals_sql([signals.Strategy('WF', signals.WF)])} SELECT ticker, w, CASE WHEN {_duck(signals.PCT)} AND bb_width >= wf_width AND conf_up AND volume >= wf_vol AND mc_big THEN sig ELSE 0 END::INT AS sig FROM sigs""",
)
def f07(spark, sf):
    f = feats(spark, sf).withColumn("sig", F.expr(signals.WF)).filter("sig <> 0")
    kept = signals.apply_filters(F.col("sig"), F.expr(signals.PCT), F.expr(signals.WIDTH), F.col("conf_up"), F.expr(signals.VOLUME), F.col("mc_big"))
    return f.select("ticker", "w", kept.cast("int").alias("sig"))


@query("x01_x02_trades", f"WITH {FEATURE_SQL}, {signals_sql(_T14)}, {TRADES_SQL} SELECT strategy, ticker, w, sig::INT AS sig, round(tp, 5) AS tp, round(sl, 5) AS sl, reason, round(exit_price, 5) AS exit_price, round(ret, 6) AS ret, holding FROM trades")
def x01(spark, sf):
    return run(spark, sf, _T14).select("strategy", "ticker", "w", "sig", r("tp", 5), r("sl", 5), "reason", r("exit_price", 5), r("ret"), "holding")


@query("x03_j11_per_bar", f"WITH {_CHAIN} SELECT strategy, ticker, bar_ix, round(ret, 6) AS ret, round(equity, 6) AS equity FROM eq")
def x03(spark, sf):
    pb = per_bar(spark, sf, _T14)
    return simulate.with_equity(pb).select("strategy", "ticker", "bar_ix", r("ret"), r("equity"))


_METRIC_COLUMNS = ("sharpe", "sortino", "avg_return", "trade_pct", "n_trades", "profit_factor", "win_rate", "max_dd", "calmar", "psr", "total_return", "total_pnl")
def _metrics_select(known) -> str:
    """The metrics, rounded; ``known`` wraps those that few trades leave dividing by next to nothing."""
    return f"""SELECT strategy, ticker, round(sharpe, 4) AS sharpe, {known(f"round(CASE WHEN down < 1e-8 THEN 0.0 ELSE {_P} * mean_ret / down END, 4)")} AS sortino, round(mean_ret * {52 * 252}, 4) AS avg_return, round(n_trades / n_all, 6) AS trade_pct,
    n_trades, {known("round(profit_factor, 4)")} AS profit_factor, round(win_rate, 6) AS win_rate, round(max_dd, 6) + 0.0 AS max_dd, {known(f"round(mu * {52 * 252} / (abs(max_dd) + 1e-8), 2)")} AS calmar,
    {known(f"round(CASE WHEN n_trades < 2 THEN 0.0 ELSE {normal.cdf_sql('z')} END, 5)")} AS psr, round(total_return, 6) + 0.0 AS total_return, round(total_pnl, 6) + 0.0 AS total_pnl FROM mt"""


# Ratios of few trades are unknown; the flagship gives all of its own.
_METRICS_SELECT, _ALL_METRICS_SELECT = _metrics_select(lambda c: f"CASE WHEN n_trades > 20 THEN {c} END"), _metrics_select(lambda c: c)


def _rounded_metrics(df: DataFrame, least: int = 21) -> DataFrame:
    """Metrics rounded; ratios of fewer than ``least`` trades are unknown."""
    digits = {"sharpe": 4, "sortino": 4, "avg_return": 4, "profit_factor": 4, "calmar": 2, "psr": 5}
    known = lambda c: F.when(F.col("n_trades") >= least, r(c, digits.get(c, 6))).alias(c) if c in ("sortino", "profit_factor", "calmar", "psr") else r(c, digits.get(c, 6))
    return df.select("strategy", "ticker", *[c if c == "n_trades" else known(c) for c in _METRIC_COLUMNS])


@query("x3_backtest_wf", f"WITH {FEATURE_SQL}, {signals_sql(_T14[:1])}, {TRADES_SQL}, {PER_BAR_SQL}, {METRICS_SQL} {_ALL_METRICS_SELECT}")
def x3(spark, sf):
    """The flagship: walk-forward baseline from ticks to metrics, per ticker; every metric, however few the trades."""
    return _rounded_metrics(reports.trade_metrics(run(spark, sf, _T14[:1]), bars(spark, sf)), least=0)


@query("a01_a17_strategy_metrics", f"WITH {_CHAIN}, {METRICS_SQL} {_METRICS_SELECT}")
def a01(spark, sf):
    return _rounded_metrics(reports.trade_metrics(run(spark, sf, _T14), bars(spark, sf)))


@query("t13_all_strategies", f"WITH {FEATURE_SQL}, {signals_sql(signals.catalogue())}, {TRADES_SQL}, {PER_BAR_SQL}, {METRICS_SQL} {_METRICS_SELECT}")
def t13(spark, sf):
    """The variants of the catalogue in one pass."""
    return _rounded_metrics(reports.trade_metrics(run(spark, sf, signals.catalogue()), bars(spark, sf)))


_WR_SQL = f"""{FEATURE_SQL}, {signals_sql([signals.Strategy("WF", signals.WF)])}, wr0 AS (
    SELECT f.*, coalesce(s.sig, 0) AS sig FROM feats f LEFT JOIN sigs s USING (ticker, w)
), wr1 AS (
    SELECT *, CASE WHEN sig = 1 THEN g_sl ELSE g_tp END AS sl, CASE WHEN sig = 1 THEN g_tp ELSE g_sl END AS tp, n_bars - {LK + PL} - w AS most FROM wr0
), wr2 AS (
    SELECT *, coalesce(nullif(list_position(list_transform(horizon, lambda b: CASE WHEN sig = 1 THEN b.low <= sl ELSE b.high >= sl END), true), 0), 99) AS a_sl,
           coalesce(nullif(list_position(list_transform(horizon[2:], lambda b: CASE WHEN sig = 1 THEN b.high >= tp ELSE b.low <= tp END), true), 0) + 1, 99) AS a_tp FROM wr1
), wr3 AS (
    SELECT *, sig <> 0 AND CASE WHEN least(a_sl, a_tp) <= least({PL}, most) THEN sig * (CASE WHEN a_sl <= a_tp THEN sl ELSE tp END - entry_open) > 0 WHEN most >= {PL} THEN sig * (horizon[{PL}].close - entry_open) > 0 ELSE false END AS won FROM wr2
), wr4 AS (
    SELECT *, sum(won::INT) OVER q AS wins_in, sum((sig <> 0)::INT) OVER q AS trades_in FROM wr3 WINDOW q AS (PARTITION BY ticker ORDER BY w ROWS BETWEEN 50 PRECEDING AND CURRENT ROW)
)"""


@query("w28_rolling_win_rate", f"WITH {_WR_SQL} SELECT ticker, w, sig::INT AS sig, won, sig = 0 OR wins_in / greatest(trades_in, 1) >= 0.5 AS win_rate_ok FROM wr4")
def w28(spark, sf):
    f = feats(spark, sf).withColumn("sig", F.expr(signals.WF))
    f = simulate.signals_won(f, SHORT)
    return simulate.rolling_win_rate(f).select("ticker", "w", F.col("sig").cast("int").alias("sig"), "won", "win_rate_ok")


@query(
    "a06_a11_forecast_metrics",
    f"""WITH {FEATURE_SQL}, rk1 AS (SELECT *, rank() OVER (PARTITION BY ticker ORDER BY actual_ret) + (count(*) OVER (PARTITION BY ticker, actual_ret) - 1) / 2 AS ra, rank() OVER (PARTITION BY ticker ORDER BY pred_ret) + (count(*) OVER (PARTITION BY ticker, pred_ret) - 1) / 2 AS rp FROM feats)
        SELECT ticker, round(coalesce(avg((sign(actual_ret) = sign(pred_ret))::INT) FILTER (sign(pred_ret) <> 0), 0.0), 6) AS direction_accuracy,
               round({_P} * avg(sign(pred_ret) * actual_ret) / (stddev_pop(sign(pred_ret) * actual_ret) + 1e-8), 4) AS direction_sharpe, round(corr(actual_ret, pred_ret), 6) AS return_correlation, round(corr(ra, rp), 6) AS ic_rank,
               round(avg(pred_ret - actual_ret), 6) AS bias, round(avg(abs(pred_ret - actual_ret)), 6) AS mae, round(avg(mc_std / greatest(entry_close, 1e-8)), 6) AS prediction_volatility FROM rk1 GROUP BY 1""",
)
def a06(spark, sf):
    f = feats(spark, sf).withColumn("ra", m.mean_rank(F.col("actual_ret"), ["ticker"])).withColumn("rp", m.mean_rank(F.col("pred_ret"), ["ticker"]))
    a, p = F.col("actual_ret"), F.col("pred_ret")
    return f.groupBy("ticker").agg(
        r(m.direction_accuracy(a, p)).alias("direction_accuracy"), r(m.sharpe(F.signum(p) * a), 4).alias("direction_sharpe"), r(m.correlation(a, p)).alias("return_correlation"),
        r(m.correlation(F.col("ra"), F.col("rp"))).alias("ic_rank"), r(m.bias(a, p)).alias("bias"), r(m.mae(a, p)).alias("mae"), r(F.avg(F.col("mc_std") / F.greatest(F.col("entry_close"), F.lit(1e-8)))).alias("prediction_volatility"),
    )


