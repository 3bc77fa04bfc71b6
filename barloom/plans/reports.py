"""Queries over breakdowns, comparisons, regimes and per-window strategies (survey §2.3, 2.4, 2.8, 2.9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.config import SHORT
from barloom.functions import metrics as m, normal
from barloom.operators import asof, atoms, evaluation, forecast, patterns, portfolio, quantiles, reports, rolling, signals, simulate, windows
from barloom.plans.base import BARS_SQL, BY_BAR_SQL, bars, r
from barloom.plans.indicators import ADR_SQL
from barloom.plans.patterns import ob_sql
from barloom.plans.registry import query
from barloom.plans.trading import BELIEF_SQL, FEATURE_SQL, METRICS_SQL, PER_BAR_SQL, PL, S, TRADES_SQL, WIN_SQL, feats, run, signals_sql
from barloom.operators.signals import Strategy

CHOSEN = [Strategy("WF", signals.WF), Strategy("V>2", signals.reward_ratio(2.0)), Strategy("WF_noSL", signals.WF, "true", "no_sl")]
TRADE_CHAIN = f"{FEATURE_SQL}, {signals_sql(CHOSEN)}, {TRADES_SQL}"
BAR_CHAIN = f"{TRADE_CHAIN}, {PER_BAR_SQL}"


def trades(spark, sf) -> DataFrame:
    return run(spark, sf, CHOSEN)


def per_bar(spark, sf) -> DataFrame:
    return simulate.per_bar(trades(spark, sf), bars(spark, sf), [s.name for s in CHOSEN])


@query(
    "a24_a25_x08_trade_report",
    f"""WITH {TRADE_CHAIN}, t AS (SELECT *, product(1 + ret) OVER k AS equity FROM trades WINDOW k AS (PARTITION BY strategy, ticker, quarter ORDER BY w)),
        u AS (SELECT *, max(equity) OVER (PARTITION BY strategy, ticker, quarter ORDER BY w) AS peak FROM t)
        SELECT strategy, ticker, quarter, count(*) AS n, count(*) FILTER (reason = 'tp') AS tp_hits, count(*) FILTER (reason = 'sl') AS sl_hits, count(*) FILTER (reason = 'close') AS closes, count(*) FILTER (ret > 0) AS wins,
               count(*) FILTER (ret <= 0) AS losses, round(avg((ret > 0)::INT), 6) AS win_rate, round(sum(ret) * 100, 4) AS total_return_pct, round(avg(ret) * 100, 5) AS avg_return_pct, round(coalesce(stddev_samp(ret), 0) * 100, 5) AS std_return_pct,
               round(coalesce(avg(ret) FILTER (ret > 0), 0) * 100, 5) AS avg_win_pct, round(coalesce(avg(ret) FILTER (ret <= 0), 0) * 100, 5) + 0.0 AS avg_loss_pct, CASE WHEN count(*) > 2 THEN round(avg(ret) / greatest(coalesce(stddev_samp(ret), 0), 1e-10) * sqrt(252), 4) END AS sharpe,
               round(min((equity - peak) / peak) * 100, 5) + 0.0 AS mdd_pct FROM u GROUP BY 1, 2, 3""",
)
def a24(spark, sf):
    t = trades(spark, sf).withColumn("quarter", windows.quarter_of(F.col("pred_ts")))
    d = {"total_return_pct": 4, "sharpe": 4, "win_rate": 6}
    out = reports.trade_report(t, "strategy", "ticker", "quarter").withColumn("sharpe", F.when(F.col("n") > 2, F.col("sharpe")))
    ints = ["n", "tp_hits", "sl_hits", "closes", "wins", "losses"]
    return out.select("strategy", "ticker", "quarter", *ints, *[r(c, d.get(c, 5)) for c in out.columns if c not in ("strategy", "ticker", "quarter", "profit_factor", *ints)])


@query(
    "a26_a27_a28_quarterly",
    f"""WITH {BAR_CHAIN}, q AS (SELECT *, year(ts)::VARCHAR || '-Q' || quarter(ts)::VARCHAR AS quarter FROM per_bar WHERE ret <> 0)
        SELECT strategy, coalesce(quarter, 'overall') AS quarter, count(*) AS n_active, round(sum(ret), 6) AS total_pnl, round(coalesce(sum(ret) FILTER (ret > 0), 0) / greatest(abs(coalesce(sum(ret) FILTER (ret < 0), 0)), 1e-12), 4) AS profit_factor,
               round(avg(ret), 6) AS aver_ret, round(avg((ret > 0)::INT), 6) AS win_rate, round(sqrt({6 * 24 * 252}) * avg(ret) / (stddev_pop(ret) + 1e-8), 3) AS sharpe
        FROM q GROUP BY ROLLUP (strategy, quarter) HAVING strategy IS NOT NULL AND count(*) >= 10""",
)
def a26(spark, sf):
    q = reports.quarterly(per_bar(spark, sf))
    return q.select("strategy", "quarter", "n_active", r("total_pnl"), r("profit_factor", 4), r("aver_ret"), r("win_rate"), r("sharpe", 3))


_QUARTERS_SQL = f"""{BAR_CHAIN}, q AS (SELECT *, year(ts)::VARCHAR || '-Q' || quarter(ts)::VARCHAR AS quarter FROM per_bar), ql AS (
    SELECT strategy, coalesce(quarter, 'overall') AS quarter, count(*) AS n_bars, count(*) FILTER (ret <> 0) AS n_active, sum(ret) AS total_pnl, avg(ret) FILTER (ret <> 0) AS aver_ret,
           coalesce(sum(ret) FILTER (ret > 0), 0) / greatest(abs(coalesce(sum(ret) FILTER (ret < 0), 0)), 1e-12) AS profit_factor, avg((ret > 0)::INT) FILTER (ret <> 0) AS win_rate,
           sqrt({6 * 24 * 252}) * avg(ret) FILTER (ret <> 0) / (stddev_pop(ret) FILTER (ret <> 0) + 1e-8) AS sharpe
    FROM q GROUP BY ROLLUP (strategy, quarter) HAVING strategy IS NOT NULL
)"""


@query("a26_quarter_tables", f"WITH {_QUARTERS_SQL} SELECT strategy, quarter, CASE WHEN n_active >= 3 THEN round(aver_ret, 6) END AS aver_ret, CASE WHEN n_active >= 10 THEN round(sharpe, 3) END AS sharpe FROM ql")
def a26_tables(spark, sf):
    q = reports.quarter_tables(per_bar(spark, sf))
    return q.select("strategy", "quarter", r("aver_ret"), r("sharpe", 3))


@query(
    "a27_quarter_rows",
    f"WITH {_QUARTERS_SQL} SELECT strategy, quarter, n_bars, n_active, round(total_pnl, 6) AS total_pnl, round(profit_factor, 4) AS profit_factor, round(aver_ret, 8) AS aver_ret, round(sharpe, 2) AS sharpe FROM ql WHERE n_active >= CASE WHEN quarter = 'overall' THEN 11 ELSE 10 END",
)
def a27_rows(spark, sf):
    """The rows of the quarterly CSV, rounded as they are written."""
    return reports.quarter_rows(per_bar(spark, sf)).select("strategy", "quarter", "n_bars", "n_active", *[r(c, d) for c, d in reports.QUARTER_DIGITS.items()])


@query(
    "a28_quarter_tuples",
    f"WITH {_QUARTERS_SQL} SELECT strategy, quarter, round(aver_ret, 6) AS aver_ret, round(profit_factor, 4) AS profit_factor, round(win_rate, 6) AS win_rate, n_active AS n FROM ql WHERE n_active >= CASE WHEN quarter = 'overall' THEN 6 ELSE 5 END",
)
def a28_tuples(spark, sf):
    return reports.quarter_tuples(per_bar(spark, sf)).select("strategy", "quarter", r("aver_ret"), r("profit_factor", 4), r("win_rate"), "n")


@query(
    "a29_best_half_year",
    f"""WITH {BAR_CHAIN}, mk AS (SELECT strategy, ticker, bar_ix, CASE WHEN year(ts) = 2024 AND quarter(ts) IN (1, 2) THEN ret ELSE 0.0 END AS ret FROM per_bar),
        e0 AS (SELECT *, product(1 + ret) OVER (PARTITION BY strategy, ticker ORDER BY bar_ix) AS equity FROM mk), e AS (SELECT *, max(equity) OVER (PARTITION BY strategy, ticker ORDER BY bar_ix) AS peak FROM e0),
        hy AS (
            SELECT strategy, ticker, count(*) FILTER (ret <> 0) AS n_active, sqrt({6 * 24 * 252}) * avg(ret) FILTER (ret <> 0) / (stddev_pop(ret) FILTER (ret <> 0) + 1e-8) AS sharpe, avg(ret) FILTER (ret <> 0) AS aver_ret,
                   coalesce(sum(ret) FILTER (ret > 0), 0) / (abs(coalesce(sum(ret) FILTER (ret < 0), 0)) + 1e-8) AS profit_factor, min((equity - peak) / peak) AS max_dd
            FROM e GROUP BY 1, 2 HAVING count(*) FILTER (ret <> 0) >= 20
        )
        SELECT row_number() OVER (ORDER BY sharpe DESC, strategy, ticker) AS place, strategy, ticker, n_active, round(sharpe, 3) AS sharpe, round(profit_factor, 3) AS profit_factor, round(aver_ret, 7) AS aver_ret, round(max_dd, 6) + 0.0 AS max_dd
        FROM hy ORDER BY sharpe DESC, strategy, ticker LIMIT 15""",
)
def a29_best(spark, sf):
    """A top-k report: the fifteen best."""
    h = reports.best_half_year(reports.half_year(per_bar(spark, sf), ("2024-Q1", "2024-Q2")), 15)
    return h.select("place", "strategy", "ticker", "n_active", r("sharpe", 3), r("profit_factor", 3), r("aver_ret", 7), r("max_dd"))


_BUNDLE_SQL = f"""{BAR_CHAIN}, {METRICS_SQL}, sg AS (SELECT strategy, ticker, count(*) FILTER (sig = 1) AS n_long, count(*) FILTER (sig = -1) AS n_short FROM sigs GROUP BY 1, 2),
    td AS (SELECT strategy, ticker, avg(holding) AS mean_holding, count(*) FILTER (sig = 1) AS longs, count(*) FILTER (sig = -1) AS shorts, avg((ret > 0)::INT) AS trade_win_rate FROM trades GROUP BY 1, 2)"""


@query(
    "a17_a18_metric_bundle",
    f"""WITH {_BUNDLE_SQL} SELECT strategy, ticker, n_long, n_short, round(total_pnl / greatest(n_long + n_short, 1), 8) AS aver_ret, longs, shorts, round(mean_holding, 6) AS mean_holding, round(trade_win_rate, 6) AS trade_win_rate, round(sharpe, 4) AS sharpe, n_trades
        FROM mt JOIN sg USING (strategy, ticker) JOIN td USING (strategy, ticker)""",
)
def a17_bundle(spark, sf):
    """Metrics of the bars with those that need the signals and the trades."""
    sigs = signals.signals(feats(spark, sf), CHOSEN)
    t = simulate.simulate(sigs)
    found = reports.metric_bundle(simulate.per_bar(t, bars(spark, sf), [s.name for s in CHOSEN]), sigs, t)
    return found.select("strategy", "ticker", "n_long", "n_short", r("aver_ret", 8), "longs", "shorts", r("mean_holding"), r("trade_win_rate"), r("sharpe", 4), "n_trades")


@query(
    "a30_hour_weekday",
    f"""WITH {BAR_CHAIN}, b AS (SELECT *, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS weekday FROM per_bar WHERE ret <> 0)
        SELECT strategy, coalesce(hour, -1) AS hour, coalesce(weekday, -1) AS weekday, count(*) AS n, round(sum(ret), 6) AS total_ret, round(avg(ret), 6) AS aver_ret FROM b GROUP BY GROUPING SETS ((strategy, hour), (strategy, weekday)) HAVING count(*) >= 5""",
)
def a30(spark, sf):
    g = reports.by_hour_and_weekday(per_bar(spark, sf))
    return g.select("strategy", F.coalesce("hour", F.lit(-1)).alias("hour"), F.coalesce("weekday", F.lit(-1)).alias("weekday"), "n", r("total_ret"), r("aver_ret"))


@query(
    "a31_weekday_quarter",
    f"""WITH {BAR_CHAIN}, b AS (SELECT *, (isodow(ts) - 1)::INT AS weekday, year(ts)::VARCHAR || '-Q' || quarter(ts)::VARCHAR AS quarter FROM per_bar WHERE ret <> 0 AND hour(ts) IN (15, 16))
        SELECT strategy, weekday, coalesce(quarter, 'all') AS quarter, count(*) AS n, round(sum(ret), 6) AS total_ret FROM b GROUP BY ROLLUP (strategy, weekday, quarter) HAVING strategy IS NOT NULL AND weekday IS NOT NULL AND count(*) >= 3""",
)
def a31(spark, sf):
    return reports.weekday_quarter(per_bar(spark, sf)).select("strategy", "weekday", "quarter", "n", r("total_ret"))


@query(
    "a29_f05_half_year",
    f"""WITH {BAR_CHAIN}, mk AS (SELECT strategy, ticker, bar_ix, CASE WHEN year(ts) = 2024 AND quarter(ts) IN (1, 2) THEN ret ELSE 0.0 END AS ret FROM per_bar),
        e0 AS (SELECT *, product(1 + ret) OVER (PARTITION BY strategy, ticker ORDER BY bar_ix) AS equity FROM mk), e AS (SELECT *, max(equity) OVER (PARTITION BY strategy, ticker ORDER BY bar_ix) AS peak FROM e0)
        SELECT strategy, ticker, count(*) FILTER (ret <> 0) AS n_active, round(sqrt({6 * 24 * 252}) * avg(ret) FILTER (ret <> 0) / (stddev_pop(ret) FILTER (ret <> 0) + 1e-8), 3) AS sharpe, round(arg_max(equity, bar_ix) / arg_min(equity, bar_ix) - 1, 6) AS total_return,
               round(avg((ret > 0)::INT) FILTER (ret <> 0), 6) AS win_rate, round(min((equity - peak) / peak), 6) + 0.0 AS max_dd FROM e GROUP BY 1, 2 HAVING count(*) FILTER (ret <> 0) >= 20""",
)
def a29(spark, sf):
    h = reports.half_year(per_bar(spark, sf), ("2024-Q1", "2024-Q2"))
    return h.select("strategy", "ticker", "n_active", r("sharpe", 3), r("total_return"), r("win_rate"), r("max_dd"))


@query(
    "a33_g04_hourly_trades",
    f"""WITH {TRADE_CHAIN}, a AS (SELECT strategy, count(*) AS every FROM trades GROUP BY 1)
        SELECT strategy, hour(pred_ts)::INT AS hour, count(*) AS n, round(avg((ret > 0)::INT), 6) AS win_rate, round(avg(ret), 6) AS avg_ret, round(avg((reason = 'tp')::INT), 6) AS tp_share, round(avg((reason = 'sl')::INT), 6) AS sl_share,
               round(avg((reason = 'close')::INT), 6) AS close_share, round(count(*) / any_value(every), 6) AS trade_pct,
               round(coalesce(sum(ret) FILTER (ret > 0), 0) / greatest(abs(coalesce(sum(ret) FILTER (ret < 0), 0)), 1e-10), 3) AS profit_factor FROM trades JOIN a USING (strategy) GROUP BY 1, 2""",
)
def a33(spark, sf):
    h = reports.hourly_trades(trades(spark, sf))
    return h.select("strategy", "hour", "n", r("win_rate"), r("avg_ret"), r("tp_share"), r("sl_share"), r("close_share"), r("trade_pct"), r("profit_factor", 3))


@query(
    "a34_hour_quarter_pivot",
    f"""WITH {TRADE_CHAIN} SELECT strategy, hour(pred_ts)::INT AS hour, CASE WHEN count(*) FILTER (quarter = '2024-Q1') > 2 THEN round(avg(ret) FILTER (quarter = '2024-Q1') / greatest(stddev_samp(ret) FILTER (quarter = '2024-Q1'), 1e-10) * sqrt(252), 3) END AS q1,
        CASE WHEN count(*) FILTER (quarter = '2024-Q2') > 2 THEN round(avg(ret) FILTER (quarter = '2024-Q2') / greatest(stddev_samp(ret) FILTER (quarter = '2024-Q2'), 1e-10) * sqrt(252), 3) END AS q2 FROM trades GROUP BY 1, 2""",
)
def a34(spark, sf):
    t = trades(spark, sf)
    n = [F.count_if(windows.quarter_of(F.col("pred_ts")) == q).alias(q) for q in ("2024-Q1", "2024-Q2")]
    busy = t.groupBy("strategy", F.hour("pred_ts").alias("hour")).agg(*n).alias("n")
    p = reports.hour_quarter_pivot(t, ["2024-Q1", "2024-Q2"]).alias("p").join(busy, ["strategy", "hour"])
    known = lambda q: F.when(F.col(f"n.{q}") > 2, r(F.col(f"p.{q}"), 3))
    return p.select("strategy", "hour", known("`2024-Q1`").alias("q1"), known("`2024-Q2`").alias("q2"))


@query(
    "a41_gates",
    f"""WITH {BAR_CHAIN}, {METRICS_SQL} SELECT strategy, ticker, sharpe >= 0.5 AS gate_sharpe, win_rate >= 0.52 AS gate_win_rate, abs(max_dd) <= 0.25 AS gate_drawdown,
        CASE WHEN n_trades > 2 THEN ({normal.cdf_sql("z")} >= 0.7)::INT::DOUBLE END AS gate_psr FROM mt""",
)
def a41(spark, sf):
    g = reports.gates(reports.strategy_metrics(per_bar(spark, sf)))
    return g.select("strategy", "ticker", "gate_sharpe", "gate_win_rate", "gate_drawdown", F.when(F.col("n_trades") > 2, F.col("gate_psr").cast("double")).alias("gate_psr"))


@query(
    "j07_compare_strategies",
    f"""WITH {BAR_CHAIN}, {METRICS_SQL}, l AS (SELECT strategy, ticker, unnest(['sharpe', 'win_rate', 'max_dd', 'total_pnl']) AS metric, unnest([sharpe, win_rate, max_dd, total_pnl]) AS value FROM mt)
        SELECT a.ticker, a.metric, round(a.value, 4) + 0.0 AS a, round(b.value, 4) + 0.0 AS b, round(b.value - a.value, 4) + 0.0 AS delta FROM l a JOIN l b USING (ticker, metric) WHERE a.strategy = 'WF' AND b.strategy = 'V>2'""",
)
def j07(spark, sf):
    mt = reports.strategy_metrics(per_bar(spark, sf))
    return reports.compare(mt, "WF", "V>2", ["sharpe", "win_rate", "max_dd", "total_pnl"]).select("ticker", "metric", r("a", 4), r("b", 4), r("delta", 4))


_TRIALS = len(signals.catalogue())
_EULER = m.EULER
_ZMAX = (1 - _EULER) * normal.quantile(1 - 1 / _TRIALS) + _EULER * normal.quantile(1 - 1 / (_TRIALS * 2.718281828459045))


@query(
    "a12_a13_a14_deflated_sharpe",
    f"""WITH {BAR_CHAIN}, {METRICS_SQL}, d AS (SELECT *, (sr * sqrt(n_trades - 1) - {_ZMAX!r}) / (sqrt(greatest(va * (n_trades - 1), 0.0)) + 1e-8) AS zd FROM mt), e AS (SELECT strategy, ticker, n_trades, round(sk, 4) AS skewness, round(ku, 4) AS kurtosis, round({normal.cdf_sql("z")}, 5) AS psr, round({normal.cdf_sql("zd")}, 5) AS dsr FROM d)
        SELECT strategy, ticker, n_trades AS n, {", ".join(f"CASE WHEN n_trades > 20 THEN {c} END AS {c}" for c in ("skewness", "kurtosis", "psr", "dsr"))} FROM e""",
)
def a12(spark, sf):
    active = F.when(F.col("ret") != 0, F.col("ret"))
    g = per_bar(spark, sf).groupBy("strategy", "ticker").agg(
        F.count(active).alias("n"), r(F.skewness(active), 4).alias("skewness"), r(F.kurtosis(active), 4).alias("kurtosis"), r(m.probabilistic_sharpe(active), 5).alias("psr"), r(m.deflated_sharpe(active, _TRIALS), 5).alias("dsr")
    )
    return g.select("strategy", "ticker", "n", *[F.when(F.col("n") > 20, F.col(c)).alias(c) for c in ("skewness", "kurtosis", "psr", "dsr")])


@query(
    "a36_a38_belief_channels",
    f"""WITH {BARS_SQL}, {BELIEF_SQL} SELECT h, round(avg(confidence), 6) AS mean_confidence, round(stddev_pop(confidence), 6) AS std_confidence, round(quantile_cont(confidence, 0.05), 6) AS p05, round(quantile_cont(confidence, 0.5), 6) AS p50,
        round(quantile_cont(confidence, 0.95), 6) AS p95, round(min(confidence), 6) AS least, round(max(confidence), 6) AS most, round(corr(confidence, entropy_s1), 5) AS corr_entropy, round(corr(confidence, top3_mass), 5) AS corr_top3 FROM beliefs GROUP BY h""",
)
def a36(spark, sf):
    b = forecast.beliefs(bars(spark, sf), SHORT)
    q = quantiles.exact_quantiles(b, "confidence", [0.05, 0.5, 0.95], ("h",))
    found = b.groupBy("h").agg(
        r(F.avg("confidence")).alias("mean_confidence"), r(F.stddev_pop("confidence")).alias("std_confidence"),
        r(F.min("confidence")).alias("least"), r(F.max("confidence")).alias("most"), r(m.pearson("confidence", "entropy_s1"), 5).alias("corr_entropy"), r(m.pearson("confidence", "top3_mass"), 5).alias("corr_top3"),
    )
    return found.join(q, "h").select("*", *[r(F.col("quantiles")[i]).alias(c) for i, c in enumerate(("p05", "p50", "p95"))]).drop("quantiles")


@query(
    "f06_a37_threshold_curves",
    f"""WITH {FEATURE_SQL}, th AS (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6]::DOUBLE[]) AS threshold), k AS (SELECT * FROM feats CROSS JOIN th WHERE conf >= threshold)
        SELECT threshold, count(*) AS n, round(avg((sign(actual_ret) = sign(pred_ret))::INT) FILTER (sign(pred_ret) <> 0), 6) AS dir_acc, round(corr(actual_ret, pred_ret), 5) AS corr, round(avg(actual_ret), 6) AS mean_ret FROM k GROUP BY 1 HAVING count(*) >= 30""",
)
def f06(spark, sf):
    """Thresholds as a small dimension: each window is repeated for those it passes."""
    levels = F.filter(F.array(*[F.lit(t) for t in (0.2, 0.3, 0.4, 0.5, 0.6)]), lambda t: t <= F.col("conf"))
    k = feats(spark, sf).withColumn("threshold", F.explode(levels))
    a, p = F.col("actual_ret"), F.col("pred_ret")
    return k.groupBy("threshold").agg(F.count("*").alias("n"), r(m.direction_accuracy(a, p)).alias("dir_acc"), r(m.pearson(a, p), 5).alias("corr"), r(F.avg(a)).alias("mean_ret")).filter("n >= 30")


@query(
    "a39_agreement_deciles",
    f"""WITH {FEATURE_SQL}, e AS (SELECT [quantile_cont(conf, 0.1), quantile_cont(conf, 0.2), quantile_cont(conf, 0.3), quantile_cont(conf, 0.4), quantile_cont(conf, 0.5), quantile_cont(conf, 0.6), quantile_cont(conf, 0.7), quantile_cont(conf, 0.8), quantile_cont(conf, 0.9)] AS edges FROM feats)
        SELECT len(list_filter(edges, lambda x: x <= conf))::INT AS decile, count(*) AS n, round(avg(agree), 5) AS mean_agree, round(avg(actual_ret), 6) AS mean_ret FROM feats CROSS JOIN e GROUP BY 1""",
)
def a39(spark, sf):
    """Buckets by percentile edges, so equal values share a bucket."""
    f = feats(spark, sf)
    b = quantiles.deciles(f, "conf")
    return b.groupBy("decile").agg(F.count("*").alias("n"), r(F.avg("agree"), 5).alias("mean_agree"), r(F.avg("actual_ret")).alias("mean_ret"))


_REGIME_SQL = f"""{FEATURE_SQL}, rg AS (
    SELECT *, concat_ws('_', CASE WHEN bb_width >= wf_width THEN 'high_vol' ELSE 'low_vol' END, CASE WHEN bb_pct < 0.3 THEN 'oversold' WHEN bb_pct > 0.7 THEN 'overbought' ELSE 'middle' END, CASE WHEN bb_mom THEN 'expanding' ELSE 'contracting' END) AS regime FROM feats
)"""


@query(
    "j06_a32_t14_t15_regimes",
    f"""WITH {_REGIME_SQL}, {signals_sql(CHOSEN)}, {TRADES_SQL}, {PER_BAR_SQL}, mp AS (
        SELECT p.*, coalesce(g.regime, 'high_vol_middle_expanding') AS regime FROM per_bar p LEFT JOIN rg g ON g.ticker = p.ticker AND g.pos = p.bar_ix - 1 WHERE ret <> 0)
        SELECT strategy, regime, count(*) AS n, round(sum(ret), 6) AS total_ret, round(avg(ret), 6) AS aver_ret, regime = 'high_vol_oversold_expanding' AS is_bad, regime = 'high_vol_middle_contracting' AS is_best,
               regime IN ('high_vol_overbought_contracting', 'high_vol_oversold_contracting', 'high_vol_oversold_expanding', 'low_vol_oversold_expanding') AS is_bad4 FROM mp GROUP BY 1, 2 HAVING count(*) >= 5""",
)
def j06(spark, sf):
    """Each bar takes the regime of the window that ended one bar before it; bars without one count as wide, middle, expanding."""
    f = feats(spark, sf)
    wide = F.when(F.col("bb_width") >= F.col("wf_width"), "high_vol").otherwise("low_vol")
    place = F.when(F.col("bb_pct") < 0.3, "oversold").when(F.col("bb_pct") > 0.7, "overbought").otherwise("middle")
    label = F.concat_ws("_", wide, place, F.when(F.col("bb_mom"), "expanding").otherwise("contracting"))
    g = f.select("ticker", (F.col("pos") + 1).alias("bar_ix"), label.alias("regime"))
    pb = simulate.per_bar(simulate.simulate(signals.signals(f, CHOSEN)), bars(spark, sf), [s.name for s in CHOSEN]).filter("ret <> 0").join(g, ["ticker", "bar_ix"], "left")
    t = pb.withColumn("regime", F.coalesce("regime", F.lit("high_vol_middle_expanding"))).groupBy("strategy", "regime").agg(F.count("*").alias("n"), r(F.sum("ret")).alias("total_ret"), r(F.avg("ret")).alias("aver_ret")).filter("n >= 5")
    bad4 = ("high_vol_overbought_contracting", "high_vol_oversold_contracting", "high_vol_oversold_expanding", "low_vol_oversold_expanding")
    return t.withColumns({"is_bad": F.col("regime") == "high_vol_oversold_expanding", "is_best": F.col("regime") == "high_vol_middle_contracting", "is_bad4": F.col("regime").isin(*bad4)})


@query(
    "x04_global_quantile_backtest",
    f"""WITH {FEATURE_SQL}, gq AS (SELECT ticker, quantile_cont(pred_ret, 0.9) AS hi, quantile_cont(pred_ret, 0.1) AS lo FROM feats GROUP BY 1),
        sg AS (SELECT ticker, pos, entry_close, CASE WHEN pred_ret > hi THEN 1 WHEN pred_ret < lo THEN -1 ELSE 0 END AS sig FROM feats JOIN gq USING (ticker)), tr AS (SELECT *, unnest(range(1, {PL + 1})) AS k FROM sg WHERE sig <> 0),
        pb AS (SELECT t.ticker, t.pos + t.k AS bar_ix, sum(sig * (b.close - entry_close) / entry_close / {PL}) - 0.0005::DOUBLE / {PL} AS ret FROM tr t JOIN bars b ON b.ticker = t.ticker AND b.bar_ix = t.pos + t.k GROUP BY 1, 2)
        SELECT ticker, bar_ix, round(ret, 7) AS ret FROM pb""",
)
def x04(spark, sf):
    """Close-to-entry returns without levels, by quantiles of the whole history (it looks ahead)."""
    f = feats(spark, sf)
    q = quantiles.exact_quantiles(f, "pred_ret", [0.9, 0.1], ("ticker",)).withColumnRenamed("quantiles", "q")
    s = f.join(q, "ticker").withColumn("sig", F.when(F.col("pred_ret") > F.col("q")[0], 1).when(F.col("pred_ret") < F.col("q")[1], -1).otherwise(0)).filter("sig <> 0")
    e = s.select("ticker", "pos", "sig", "entry_close", F.posexplode("horizon").alias("k", "b"))
    part = F.try_divide(F.col("sig") * (F.col("b.close") - F.col("entry_close")), F.col("entry_close")) / PL
    return e.groupBy("ticker", (F.col("pos") + 1 + F.col("k")).alias("bar_ix")).agg(r(F.sum(part) - 0.0005 / PL, 7).alias("ret"))


@query(
    "x09_cross_section",
    f"""WITH {BARS_SQL}, x AS (SELECT ticker, ts, ln(close / lag(close) OVER w) AS ret FROM bars WINDOW w AS ({BY_BAR_SQL})), y AS (SELECT * FROM x WHERE ret IS NOT NULL),
        z AS (SELECT *, (ret - avg(ret) OVER t) / greatest(stddev_pop(ret) OVER t, 1e-10) AS z, row_number() OVER (PARTITION BY ts ORDER BY ret DESC, ticker) AS best, row_number() OVER (PARTITION BY ts ORDER BY ret, ticker DESC) AS worst FROM y WINDOW t AS (PARTITION BY ts))
        SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(z, 5) AS z, round(CASE WHEN best <= 3 THEN 1.0 / 3 WHEN worst <= 2 THEN -0.5 ELSE 0.0 END, 6) AS weight FROM z""",
)
def x09(spark, sf):
    """Extension: long the three best, short the two worst tickers of each bar."""
    from pyspark.sql import Window as W

    b = bars(spark, sf).withColumn("ret", F.ln(F.col("close") / F.lag("close").over(W.partitionBy("ticker").orderBy("bar_ix")))).filter("ret is not null")
    p = simulate.portfolio_ranks(b)
    return p.select("ticker", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), r("z", 5), r("weight"))


_RULES = portfolio.Rules()
_POSITIONS_SQL = f"""{WIN_SQL}, sc AS (SELECT ticker, ts, ln(list_avg(list_transform(paths, lambda p: p[{PL}])) / close) AS score FROM win WHERE bar_ix >= {PL * S}),
rk AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, ticker) AS best, row_number() OVER (PARTITION BY ts ORDER BY score, ticker DESC) AS worst FROM sc),
wt AS (SELECT ticker, ts, CASE WHEN best <= 3 THEN 1.0::DOUBLE / 3 WHEN worst <= 2 THEN -0.5::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM rk),
sb AS (SELECT b.ticker, b.session_date, b.bar_ix, b.ts, hour(b.ts) * 60 + minute(b.ts) AS m, open, close, coalesce(weight, 0.0::DOUBLE) AS signal, row_number() OVER s AS k, lead(b.ts) OVER s IS NULL AS is_last
       FROM bars b LEFT JOIN wt ON wt.ticker = b.ticker AND wt.ts = b.ts WINDOW s AS (PARTITION BY b.ticker, b.session_date ORDER BY b.bar_ix)),
walk AS (
    SELECT ticker, session_date, k, bar_ix, ts, close, signal, 0.0::DOUBLE AS weight, NULL::DOUBLE AS entry, 0 AS held, 0.0::DOUBLE AS was, 0.0::DOUBLE AS pnl, 0.0::DOUBLE AS turnover, 0 AS was_held, NULL::VARCHAR AS reason FROM sb WHERE k = 1
    UNION ALL
    (WITH e AS (
        SELECT b.*, w.weight <> 0 AS is_on, w.weight <> 0 OR (w.signal <> 0 AND b.m BETWEEN 600 AND 1090) AS holds, CASE WHEN w.weight <> 0 THEN w.weight ELSE w.signal END AS wt, CASE WHEN w.weight <> 0 THEN w.entry ELSE b.open END AS en,
               CASE WHEN w.weight <> 0 THEN w.close ELSE b.open END AS base, w.held AS h0 FROM walk w JOIN sb b ON b.ticker = w.ticker AND b.session_date = w.session_date AND b.k = w.k + 1
    ), g AS (SELECT *, sign(wt) * (close - en) / en AS gain FROM e),
    x AS (SELECT *, CASE WHEN holds THEN CASE WHEN gain <= -0.015::DOUBLE THEN 'stop' WHEN gain >= 0.025::DOUBLE THEN 'target' WHEN h0 + 1 >= 6 THEN 'horizon' WHEN m >= 1115 OR is_last THEN 'session' END END AS reason FROM g)
    SELECT ticker, session_date, k, bar_ix, ts, close, signal, CASE WHEN holds AND reason IS NULL THEN wt ELSE 0.0 END, CASE WHEN holds THEN en END, CASE WHEN holds AND reason IS NULL THEN h0 + 1 ELSE 0 END, CASE WHEN holds THEN wt ELSE 0.0 END,
           CASE WHEN holds THEN wt * (close - base) / base - CASE WHEN reason IS NOT NULL THEN abs(wt) * 0.0005::DOUBLE ELSE 0.0 END ELSE 0.0 END,
           CASE WHEN holds THEN abs(wt) * (CASE WHEN is_on THEN 0 ELSE 1 END + CASE WHEN reason IS NOT NULL THEN 1 ELSE 0 END) ELSE 0.0 END, CASE WHEN holds THEN h0 + 1 ELSE 0 END, reason FROM x)
), held AS (SELECT ticker, session_date, bar_ix, ts, was AS weight, pnl, turnover, was_held AS held, reason FROM walk WHERE was <> 0)"""


def _held(spark, sf):
    b = bars(spark, sf)
    paths = forecast.get_forecaster("analog").transform(b, SHORT).filter(F.col("bar_ix") >= PL * S)
    scores = paths.select("ticker", "ts", F.ln(forecast.mean(forecast.last_step(F.col("paths"))) / F.col("close")).alias("score"))
    return portfolio.positions(b, portfolio.target_weights(scores, _RULES), _RULES)


@query(
    "x09_positions",
    f"WITH RECURSIVE {_POSITIONS_SQL} SELECT ticker, bar_ix, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(weight, 6) AS weight, round(pnl, 8) + 0.0 AS pnl, round(turnover, 6) AS turnover, held, reason FROM held",
)
def x09_positions(spark, sf):
    """Positions of the portfolio: entered a bar after their signal, left at a stop, a target, the horizon or the session's end."""
    return _held(spark, sf).select("ticker", "bar_ix", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), r("weight"), r("pnl", 8), r("turnover"), "held", "reason")


@query(
    "x09_equity_curve",
    f"""WITH RECURSIVE {_POSITIONS_SQL}, a AS (SELECT ts, count(*) AS n_positions, sum(abs(weight)) AS exposure, sum(turnover) AS turnover, sum(pnl) AS pnl FROM held GROUP BY 1),
        e AS (SELECT *, product(1 + pnl) OVER (ORDER BY ts) AS equity FROM a), p AS (SELECT *, greatest(1.0, max(equity) OVER (ORDER BY ts)) AS peak FROM e)
        SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, n_positions, round(exposure, 6) AS exposure, round(turnover, 6) AS turnover, round(pnl, 8) + 0.0 AS pnl, round(equity, 7) AS equity, round(equity / peak - 1, 7) + 0.0 AS drawdown FROM p""",
)
def x09_equity(spark, sf):
    e = portfolio.equity_curve(_held(spark, sf))
    return e.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "n_positions", r("exposure"), r("turnover"), r("pnl", 8), r("equity", 7), r("drawdown", 7))


# Per-window strategies: consensus at the first step, features at the last bar before the forecast, levels from step to step.

_PW_SQL = f"""{WIN_SQL}, bol AS (
    SELECT ticker, bar_ix, avg(close) OVER r20 AS sma, stddev_samp(close) OVER r20 AS sd, count(*) OVER r20 AS n FROM bars WINDOW r20 AS ({BY_BAR_SQL} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
), obc AS (
    SELECT *, CASE WHEN close < open THEN 'bullish' WHEN close > open THEN 'bearish' END AS side, (lead(high) OVER w - lead(low) OVER w) / greatest(close, 1e-10) AS reach FROM bars WINDOW w AS ({BY_BAR_SQL})
), obl AS (
    SELECT ticker, bar_ix, last_value(CASE WHEN bar_ix >= 1 AND reach >= 0.005::DOUBLE THEN side END IGNORE NULLS) OVER f AS ob5, last_value(CASE WHEN bar_ix >= 1 AND reach >= 0.002::DOUBLE THEN side END IGNORE NULLS) OVER f AS ob2
    FROM obc WINDOW f AS ({BY_BAR_SQL} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)
), vw AS (
    SELECT ticker, bar_ix, sum((high + low + close) / 3.0 * volume) OVER s / greatest(sum(volume) OVER s, 1e-10) AS vwap FROM bars WINDOW s AS (PARTITION BY ticker, session_id ORDER BY bar_ix)
), pw0 AS (
    SELECT w.*, sma, sma + 2 * sd AS upper, sma - 2 * sd AS lower, 4 * sd / sma AS width, ob5, ob2, vwap, list_transform(w.paths, lambda p: p[1]) AS v1
    FROM wins w JOIN bol USING (ticker, bar_ix) JOIN obl USING (ticker, bar_ix) JOIN vw USING (ticker, bar_ix)
), pw AS (
    SELECT *, CASE WHEN len(list_filter(v1, lambda x: x > entry_close)) / len(v1) >= 0.8 THEN 1 WHEN len(list_filter(v1, lambda x: x < entry_close)) / len(v1) >= 0.8 THEN -1 ELSE 0 END AS dir FROM pw0
)"""

# Name, condition over the features (with ``dir``), first steps without exits.
PER_WINDOW = (
    ("vanilla", "true", 1),
    ("s01_bb", "(entry_open >= upper AND dir = -1) OR (entry_open <= lower AND dir = 1)", 0),
    ("s02_bb_mr", "width <> 0 AND ((entry_open <= lower + 0.5D * (upper - lower) AND dir = 1) OR (entry_open >= upper - 0.5D * (upper - lower) AND dir = -1))", 0),
    ("s05_bb_breakout", "width >= 0.005D AND ((entry_open <= lower + 0.5D * (upper - lower) AND dir = 1) OR (entry_open >= upper - 0.5D * (upper - lower) AND dir = -1))", 0),
    ("s20_ob", "(ob5 = 'bullish' AND dir = 1) OR (ob5 = 'bearish' AND dir = -1)", 0),
    ("s34_vwap_ob", "(ob2 = 'bullish' AND dir = 1 AND close < vwap) OR (ob2 = 'bearish' AND dir = -1 AND close > vwap)", 0),
)
MORE_PER_WINDOW = (
    ("s28_vol_ob", "(vob = 'bullish' AND dir = 1) OR (vob = 'bearish' AND dir = -1)", 0),
    ("s38_lowvol_ob", "low_range AND ((ob2 = 'bullish' AND dir = 1) OR (ob2 = 'bearish' AND dir = -1))", 0),
)


def window_features(spark, sf) -> DataFrame:
    """Windows with consensus, and the features of the last bar before each, found as of its time."""
    b = bars(spark, sf)
    marked = rolling.vwap(rolling.bollinger(b))
    marked = patterns.order_block(patterns.order_block(marked, move=0.005, name="o5"), move=0.002, name="o2")
    marked = rolling.adr(patterns.volume_order_block(marked))
    marked = marked.select(
        "ticker", "ts", "close", "vwap", "upper", "lower", "low_range", ((F.col("upper") - F.col("lower")) / F.col("sma")).alias("width"),
        F.col("o5.signal").alias("ob5"), F.col("o2.signal").alias("ob2"), F.col("vob.signal").alias("vob"),
    )
    f = forecast.get_forecaster("analog").transform(b, SHORT)
    w = windows.sliding_windows(f, SHORT).select("ticker", "w", "pos", "pred_ts", "entry_close", "entry_open", "horizon", "paths")
    w = w.withColumn("dir", atoms.consensus(F.col("paths"), F.col("entry_close"))[0]["dir"])
    return asof.asof_join(w, marked, "ticker", "pred_ts", "ts", ["close", "vwap", "upper", "lower", "width", "low_range", "ob5", "ob2", "vob"], bucket="month")


def per_window_trades(f: DataFrame, chosen: tuple, tp_q: float = 0.9, sl_q: float = 0.1) -> DataFrame:
    bounds = atoms.boundaries(F.col("paths"), F.col("entry_close"), tp_q, sl_q)
    rows = F.array(*[F.struct(F.lit(n).alias("strategy"), F.expr(f"coalesce(dir <> 0 AND ({c}), false)").alias("on"), F.lit(k).alias("skip")) for n, c, k in chosen])
    e = f.withColumn("bounds", bounds).withColumn("s", F.explode(F.filter(rows, lambda x: x["on"])))
    traded = [simulate.stepwise_trade(F.col("dir"), F.col("entry_open"), F.col("horizon"), F.col("bounds"), skip_first=k) for k in (0, 1)]
    e = e.withColumn("x", F.when(F.col("s.skip") == 1, traded[1]).otherwise(traded[0]))
    return e.select("ticker", "w", "pred_ts", F.col("s.strategy").alias("strategy"), F.col("dir").alias("direction"), "entry_open", F.col("x.price").alias("exit_price"), F.col("x.step").alias("exit_step"), F.col("x.reason").alias("reason"), F.col("x.ret").alias("ret"))


def _pw_rows_sql() -> str:
    from barloom.plans.trading import _duck

    return ", ".join(f"{{'strategy': '{n}', 'is_on': coalesce(dir <> 0 AND ({_duck(c)}), false), 'skip': {k}}}" for n, c, k in PER_WINDOW)


@query(
    "j01_x05_x07_t05_t11_window_strategies",
    f"""WITH {_PW_SQL}, ex AS (SELECT *, unnest([{_pw_rows_sql()}]) AS s FROM pw),
        st AS (SELECT ticker, w, dir, s.strategy AS strategy, s.skip AS skip, entry_open, entry_close, i, horizon[i].high AS hi, horizon[i].low AS lo, horizon[i].close AS cl, list_aggregate(list_transform(paths, lambda p: p[i]), 'quantile_cont', 0.9) AS q9,
                 list_aggregate(list_transform(paths, lambda p: p[i]), 'quantile_cont', 0.1) AS q1 FROM ex, unnest(range(1, {PL + 1})) u(i) WHERE s.is_on),
        lv AS (SELECT *, CASE WHEN q9 > entry_close THEN q9 END AS above, CASE WHEN q1 < entry_close THEN q1 END AS below FROM st),
        rs AS (SELECT *, CASE WHEN i <= skip THEN NULL WHEN dir = 1 AND lo <= below THEN 'sl' WHEN dir = 1 AND hi >= above THEN 'tp' WHEN dir = -1 AND hi >= above THEN 'sl' WHEN dir = -1 AND lo <= below THEN 'tp' WHEN i = {PL} THEN 'close' END AS reason FROM lv),
        ft AS (SELECT * FROM rs WHERE reason IS NOT NULL OR i = {PL} QUALIFY row_number() OVER (PARTITION BY strategy, ticker, w ORDER BY i) = 1),
        px AS (SELECT *, CASE WHEN reason = 'sl' THEN CASE WHEN dir = 1 THEN below ELSE above END WHEN reason = 'tp' THEN CASE WHEN dir = 1 THEN above ELSE below END ELSE cl END AS price FROM ft)
        SELECT strategy, ticker, w, dir::INT AS direction, coalesce(reason, 'close') AS reason, (i - 1)::INT AS exit_step, round(price, 5) AS exit_price, round(dir * (price - entry_open) / entry_open, 6) AS ret FROM px""",
)
def t05(spark, sf):
    t = per_window_trades(window_features(spark, sf), PER_WINDOW)
    return t.select("strategy", "ticker", "w", "direction", "reason", "exit_step", r("exit_price", 5), r("ret"))


def _window_trades_sql(chosen: tuple) -> str:
    """Trades ``px`` of per-window strategies on ``pz``, the windows with their features."""
    from barloom.plans.trading import _duck

    rows = ", ".join(f"{{'strategy': '{n}', 'is_on': coalesce(dir <> 0 AND ({_duck(c)}), false), 'skip': {k}}}" for n, c, k in chosen)
    return f"""ex AS (SELECT *, unnest([{rows}]) AS s FROM pz),
        st AS (SELECT ticker, w, pred_ts, dir, s.strategy AS strategy, s.skip AS skip, entry_open, entry_close, i, horizon[i].high AS hi, horizon[i].low AS lo, horizon[i].close AS cl,
                 list_aggregate(list_transform(paths, lambda p: p[i]), 'quantile_cont', 0.9) AS q9, list_aggregate(list_transform(paths, lambda p: p[i]), 'quantile_cont', 0.1) AS q1 FROM ex, unnest(range(1, {PL + 1})) u(i) WHERE s.is_on),
        lv AS (SELECT *, CASE WHEN q9 > entry_close THEN q9 END AS above, CASE WHEN q1 < entry_close THEN q1 END AS below FROM st),
        ra AS (SELECT *, CASE WHEN i <= skip THEN NULL WHEN dir = 1 AND lo <= below THEN 'sl' WHEN dir = 1 AND hi >= above THEN 'tp' WHEN dir = -1 AND hi >= above THEN 'sl' WHEN dir = -1 AND lo <= below THEN 'tp' WHEN i = {PL} THEN 'close' END AS reason FROM lv),
        ft AS (SELECT * FROM ra WHERE reason IS NOT NULL OR i = {PL} QUALIFY row_number() OVER (PARTITION BY strategy, ticker, w ORDER BY i) = 1),
        px AS (SELECT *, dir * (CASE WHEN reason = 'sl' THEN CASE WHEN dir = 1 THEN below ELSE above END WHEN reason = 'tp' THEN CASE WHEN dir = 1 THEN above ELSE below END ELSE cl END - entry_open) / entry_open AS ret FROM ft)"""


_PZ_SQL = f"""{_PW_SQL}, {ob_sql(0.002).removeprefix(BARS_SQL + ", ")}, {ADR_SQL.removeprefix(BARS_SQL + ", ")}, pz AS (
    SELECT pw.*, CASE WHEN obs.ob IS NULL OR (obs.mv > 0 AND obs.ob.volume < obs.mv * 1.5::DOUBLE) THEN 'none' ELSE obs.ob.signal END AS vob, coalesce(adr.pct < 0.3, false) AS low_range
    FROM pw JOIN obs ON obs.ticker = pw.ticker AND obs.bar_ix = pw.bar_ix JOIN adr ON adr.ticker = pw.ticker AND adr.bar_ix = pw.bar_ix
)"""
_REPORT_COLUMNS = {"win_rate": 6, "total_return_pct": 4, "avg_return_pct": 5, "std_return_pct": 5, "avg_win_pct": 5, "avg_loss_pct": 5, "mdd_pct": 5, "sharpe": 3}


def _report_sql(keys: str, source: str = "px") -> str:
    return f"""e1 AS (SELECT *, product(1 + ret) OVER k AS equity FROM {source} WINDOW k AS (PARTITION BY {keys} ORDER BY w, ticker)), e2 AS (SELECT *, max(equity) OVER (PARTITION BY {keys} ORDER BY w, ticker) AS peak FROM e1),
        rp AS (SELECT {keys}, count(*) AS n, count(*) FILTER (reason = 'tp') AS tp_hits, count(*) FILTER (reason = 'sl') AS sl_hits, count(*) FILTER (reason = 'close') AS closes, count(*) FILTER (ret > 0) AS wins, count(*) FILTER (ret <= 0) AS losses,
            round(avg((ret > 0)::INT), 6) AS win_rate, round(sum(ret) * 100, 4) AS total_return_pct, round(avg(ret) * 100, 5) AS avg_return_pct, round(coalesce(stddev_samp(ret), 0) * 100, 5) AS std_return_pct,
            round(coalesce(avg(ret) FILTER (ret > 0), 0) * 100, 5) AS avg_win_pct, round(coalesce(avg(ret) FILTER (ret <= 0), 0) * 100, 5) + 0.0 AS avg_loss_pct, round(min((equity - peak) / peak) * 100, 5) + 0.0 AS mdd_pct,
            CASE WHEN count(*) > 1 THEN round(avg(ret) / greatest(coalesce(stddev_samp(ret), 0), 1e-10) * sqrt(252), 3) END AS sharpe FROM e2 GROUP BY {keys})"""


def _report(t: DataFrame, *keys: str) -> DataFrame:
    """A trade report, rounded; of a single trade the Sharpe ratio is null."""
    found = reports.trade_report(t.withColumn("order", F.struct("w", "ticker")), *keys, order="order").withColumn("sharpe", F.when(F.col("n") > 1, F.col("sharpe")))
    return found.select(*keys, "n", "tp_hits", "sl_hits", "closes", "wins", "losses", *[r(c, d) for c, d in _REPORT_COLUMNS.items()])


@query("t10_t12_t16_window_report", f"WITH {_PZ_SQL}, {_window_trades_sql(PER_WINDOW + MORE_PER_WINDOW)}, {_report_sql('strategy')} SELECT * FROM rp")
def t10(spark, sf):
    """All eight per-window strategies, reported together."""
    return _report(per_window_trades(window_features(spark, sf), PER_WINDOW + MORE_PER_WINDOW), "strategy")


# Label, strategy and consensus threshold of the nine configurations, and the first day of the test part.
CONFIGURATIONS = (
    ("Vanilla ct=0.8", "vanilla", 0.8),
    ("Vanilla ct=1.0", "vanilla", 1.0),
    ("S1 BB+Cons ct=0.8", "s01_bb", 0.8),
    ("S2 BB MR   ct=1.0", "s02_bb_mr", 1.0),
    ("S5 BB Narr ct=0.8", "s05_bb_breakout", 0.8),
    ("S20 OB     ct=1.0", "s20_ob", 1.0),
    ("S28 VolOB  ct=1.0", "s28_vol_ob", 1.0),
    ("S34 VWAP+OB ct=1.0", "s34_vwap_ob", 1.0),
    ("S38 LoVolOB ct=1.0", "s38_lowvol_ob", 1.0),
)
TEST_FROM = "2024-01-22"


_OWN = {n: (test, skip) for n, test, skip in PER_WINDOW + MORE_PER_WINDOW}
_CONFIGURED = tuple((label, f"ct = {ct}D AND ({_OWN[n][0]})", _OWN[n][1]) for label, n, ct in CONFIGURATIONS)
_COUNTS = ("n", "tp_hits", "sl_hits", "closes", "wins", "losses")


@query(
    "t16_train_test_table",
    f"""WITH {_PZ_SQL.replace(", pz AS (", ", pz0 AS (")}, pz AS (
            SELECT * EXCLUDE (dir), CASE WHEN len(list_filter(v1, lambda x: x > entry_close)) / len(v1) >= ct THEN 1 WHEN len(list_filter(v1, lambda x: x < entry_close)) / len(v1) >= ct THEN -1 ELSE 0 END AS dir FROM pz0, unnest([0.8::DOUBLE, 1.0::DOUBLE]) u(ct)
        ), {_window_trades_sql(_CONFIGURED)}, ps AS (SELECT *, CASE WHEN pred_ts < TIMESTAMP '{TEST_FROM}' THEN 'train' ELSE 'test' END AS split FROM px), {_report_sql("strategy, split", "ps")},
        every AS (SELECT unnest([{", ".join(f"'{label}'" for label, _, _ in CONFIGURATIONS)}]) AS strategy), sides AS (SELECT unnest(['train', 'test']) AS split)
        SELECT strategy, split, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in _COUNTS)}, {", ".join(f"coalesce({c}, 0.0)::DOUBLE AS {c}" for c in _REPORT_COLUMNS)} FROM every CROSS JOIN sides LEFT JOIN rp USING (strategy, split)""",
)
def t16(spark, sf):
    """The nine configurations before and from the first test day, all in one pass; those without trades have zeros."""
    verdict = lambda t: F.struct(F.lit(t).alias("ct"), atoms.consensus(F.col("paths"), F.col("entry_close"), t)[0]["dir"].alias("dir"))
    f = window_features(spark, sf).drop("dir").withColumn("c", F.explode(F.array(*[verdict(t) for t in sorted({c[2] for c in CONFIGURATIONS})]))).select("*", "c.*").drop("c")
    t = per_window_trades(f, _CONFIGURED)
    found = _report(t.withColumn("split", F.when(F.col("pred_ts") < F.lit(TEST_FROM).cast("timestamp_ntz"), "train").otherwise("test")), "strategy", "split")
    every = spark.createDataFrame([(label, split) for label, _, _ in CONFIGURATIONS for split in ("train", "test")], "strategy string, split string")
    return every.join(found, ["strategy", "split"], "left").fillna(0)


@query(
    "x05_flip_and_belief_exits",
    f"""WITH {_PW_SQL}, {BELIEF_SQL}, en AS (SELECT ticker, bar_ix, h, avg(entropy_s1) AS e FROM beliefs GROUP BY 1, 2, 3),
        st AS (SELECT pw.ticker, w, dir, entry_open, entry_close, i, horizon[i].high AS hi, horizon[i].low AS lo, horizon[i].close AS cl, en.e, e0.e AS e_first,
                 list_aggregate(list_transform(paths, lambda p: p[i]), 'quantile_cont', 0.9) AS q9, list_aggregate(list_transform(paths, lambda p: p[i]), 'quantile_cont', 0.1) AS q1,
                 len(list_filter(paths, lambda p: p[i] > entry_open)) / len(paths) AS up, len(list_filter(paths, lambda p: p[i] < entry_open)) / len(paths) AS dn
               FROM pw JOIN en e0 ON e0.ticker = pw.ticker AND e0.bar_ix = pw.pos AND e0.h = 0, unnest(range(1, {PL + 1})) u(i), en WHERE dir <> 0 AND en.ticker = pw.ticker AND en.bar_ix = pw.pos AND en.h = i - 1),
        lv AS (SELECT *, CASE WHEN q9 > entry_close THEN q9 END AS above, CASE WHEN q1 < entry_close THEN q1 END AS below, CASE WHEN up >= 0.6::DOUBLE THEN 1 WHEN dn >= 0.6::DOUBLE THEN -1 ELSE 0 END AS side FROM st),
        ra AS (SELECT *, CASE WHEN dir = 1 AND lo <= below THEN 'sl' WHEN dir = 1 AND hi >= above THEN 'tp' WHEN dir = -1 AND hi >= above THEN 'sl' WHEN dir = -1 AND lo <= below THEN 'tp' WHEN side <> 0 AND side <> dir THEN 'flip'
                 WHEN i >= 3 AND e > greatest(e_first * 1.5, 2.0) THEN 'belief_exit' WHEN i = {PL} THEN 'close' END AS reason FROM lv),
        ft AS (SELECT * FROM ra WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker, w ORDER BY i) = 1)
        SELECT ticker, w, dir::INT AS dir, reason, (i - 1)::INT AS step, round(dir * (CASE WHEN reason = 'sl' THEN CASE WHEN dir = 1 THEN below ELSE above END WHEN reason = 'tp' THEN CASE WHEN dir = 1 THEN above ELSE below END ELSE cl END - entry_open) / entry_open, 6) + 0.0 AS ret FROM ft""",
)
def x05(spark, sf):
    """Vanilla trades that also leave when the consensus flips or the beliefs lose shape."""
    f = window_features(spark, sf).filter("dir <> 0")
    per = forecast.beliefs(bars(spark, sf), SHORT).groupBy("ticker", F.col("bar_ix").alias("pos"), "h").agg(F.avg("entropy_s1").alias("e"))
    ent = per.groupBy("ticker", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "e"))), lambda x: x["e"]).alias("entropy"))
    f = f.join(ent, ["ticker", "pos"])
    flips = F.transform(atoms.consensus(F.col("paths"), F.col("entry_open"), 0.6), lambda c: c["dir"])
    x = simulate.stepwise_trade(F.col("dir"), F.col("entry_open"), F.col("horizon"), atoms.boundaries(F.col("paths"), F.col("entry_close"), 0.9, 0.1), flips, F.col("entropy"))
    return f.withColumn("x", x).select("ticker", "w", "dir", F.col("x.reason").alias("reason"), F.col("x.step").cast("int").alias("step"), r(F.col("x.ret")).alias("ret"))


# Per-window evaluation, written out: ``ev`` has a row for each window.
EVALUATION_SQL = f"""{WIN_SQL}, st AS (
    SELECT ticker, w, month, h, entry_close AS ec, horizon[h].close AS actual, horizon[h].high AS hi, horizon[h].low AS lo, list_transform(paths, lambda p: p[h]) AS v
    FROM wins, unnest(range(1, {PL + 1})) u(h)
), s1 AS (
    SELECT *, (actual - ec) / ec AS ar, (list_sum(v) / {S} - ec) / ec AS pr, len(list_filter(v, lambda x: x > ec)) / {S} AS up, len(list_filter(v, lambda x: x < ec)) / {S} AS dn,
           list_aggregate(v, 'stddev_pop') / ec AS sp, list_aggregate(v, 'quantile_cont', 0.8) AS q80, list_aggregate(v, 'quantile_cont', 0.2) AS q20
    FROM st
), s2 AS (
    SELECT *, sign(pr) * ar AS pnl, up >= 0.8 OR dn >= 0.8 AS agreed, CASE WHEN up >= 0.8 THEN 1 ELSE -1 END AS side,
           coalesce(CASE WHEN pr > 0 THEN q20 < ec AND lo <= q20 WHEN pr < 0 THEN q80 > ec AND hi >= q80 END, false) AS stopped,
           coalesce(CASE WHEN pr > 0 THEN q80 > ec AND hi >= q80 WHEN pr < 0 THEN q20 < ec AND lo <= q20 END, false) AS reached,
           rank() OVER (PARTITION BY ticker, w ORDER BY ar) + (count(*) OVER (PARTITION BY ticker, w, ar) - 1) / 2 AS ra,
           rank() OVER (PARTITION BY ticker, w ORDER BY pr) + (count(*) OVER (PARTITION BY ticker, w, pr) - 1) / 2 AS rp
    FROM s1
), s3 AS (
    SELECT *, reached AND NOT stopped AS taken, product(1 + pnl) OVER (PARTITION BY ticker, w ORDER BY h) AS equity FROM s2
), s4 AS (
    SELECT *, max(equity) OVER (PARTITION BY ticker, w ORDER BY h) AS peak FROM s3
), ev AS (
    SELECT ticker, w, month, coalesce(avg((sign(ar) = sign(pr))::INT) FILTER (pr <> 0), 0.0) AS direction_accuracy, avg((pr = 0)::INT) AS flat_rate, avg(agreed::INT) AS consensus_rate,
           avg(greatest(up, dn)) AS consensus_strength, coalesce(avg((sign(ar) = side)::INT) FILTER (agreed), 0.0) AS consensus_dir_acc, avg(pnl) / (stddev_pop(pnl) + 1e-8) * sqrt(104) AS direction_sharpe,
           CASE WHEN stddev_pop(ar) > 0 AND stddev_pop(pr) > 0 THEN corr(ar, pr) END AS return_correlation, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rp) > 0 THEN corr(ra, rp) END AS ic_rank,
           avg(pr - ar) AS bias, avg(abs(pr - ar)) AS mae, avg(sp) AS prediction_volatility, count(*)::DOUBLE AS unfiltered_trades,
           count(*) FILTER (taken) / greatest(count(*) FILTER (taken OR stopped), 1) * coalesce(avg(ar) FILTER (ar > 0), 0)
               - count(*) FILTER (stopped) / greatest(count(*) FILTER (taken OR stopped), 1) * coalesce(avg(-ar) FILTER (ar < 0), 0) AS unfiltered_expectancy,
           (count(*) FILTER (agreed))::DOUBLE AS consensus_trades,
           count(*) FILTER (taken AND agreed) / greatest(count(*) FILTER ((taken OR stopped) AND agreed), 1) * coalesce(avg(ar) FILTER (ar > 0 AND agreed), 0)
               - count(*) FILTER (stopped AND agreed) / greatest(count(*) FILTER ((taken OR stopped) AND agreed), 1) * coalesce(avg(-ar) FILTER (ar < 0 AND agreed), 0) AS expectancy,
           coalesce(avg(side * ar) FILTER (agreed) / (stddev_pop(side * ar) FILTER (agreed) + 1e-8) * sqrt(104), 0.0) AS consensus_sharpe, min((equity - peak) / peak) AS max_drawdown_simple
    FROM s4 GROUP BY 1, 2, 3
)"""
_EVALUATED = (
    "direction_accuracy", "flat_rate", "consensus_rate", "consensus_strength", "consensus_dir_acc", "direction_sharpe", "return_correlation", "ic_rank", "bias", "mae", "prediction_volatility",
    "unfiltered_trades", "unfiltered_expectancy", "consensus_trades", "expectancy", "consensus_sharpe", "max_drawdown_simple",
)
_WIDE = {"direction_sharpe": 3, "consensus_sharpe": 2}
_MEANS_SQL = ", ".join(f"round(avg({c}), {_WIDE.get(c, 6)}) + 0.0 AS {c}" for c in _EVALUATED)


def evaluated(spark, sf) -> DataFrame:
    return evaluation.evaluate_windows(windows.sliding_windows(forecast.get_forecaster("analog").transform(bars(spark, sf), SHORT), SHORT))


@query("a21_a22_a42_window_evaluation", f"WITH {EVALUATION_SQL} SELECT ticker, month, count(*) AS n_windows, {_MEANS_SQL} FROM ev GROUP BY 1, 2")
def a21(spark, sf):
    """Per-window evaluation, then its monthly means."""
    return evaluation.monthly_means(evaluated(spark, sf)).select("ticker", "month", "n_windows", *[r(c, _WIDE.get(c, 6)) for c in _EVALUATED])


@query(
    "a21_windows",
    f"WITH {EVALUATION_SQL} SELECT ticker, w, month, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in _EVALUATED if c not in ('direction_sharpe', 'consensus_sharpe'))} FROM ev",
)
def a21_windows(spark, sf):
    """Every window's metrics; ratios to deviations near zero are in the monthly means only."""
    return evaluated(spark, sf).select("ticker", "w", "month", *[r(c, 4) for c in _EVALUATED if c not in _WIDE])


@query(
    "g05_walk_forward",
    f"""WITH {EVALUATION_SQL}, mm AS (SELECT ticker, month, count(*) AS n_windows, avg(consensus_dir_acc) AS a, avg(expectancy) AS e FROM ev GROUP BY 1, 2),
        bm AS (SELECT * FROM mm QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY round(a, 9) DESC, round(e, 9) DESC, month) = 1)
        SELECT ticker, month AS best_month, n_windows, round(a, 6) AS consensus_dir_acc, round(e, 6) + 0.0 AS expectancy, round((SELECT avg(a) FROM mm m WHERE m.ticker = bm.ticker), 6) AS mean_dir_acc FROM bm""",
)
def g05(spark, sf):
    """The driver as one call: windows, months, samples, evaluation, each ticker's best month and its mean over months."""
    found = evaluation.walk_forward(bars(spark, sf), SHORT)
    return found.select("ticker", "best_month", "n_windows", r("consensus_dir_acc"), r("expectancy"), r("mean_dir_acc"))


@query(
    "x06_a23_trade_summary",
    f"""WITH {_PW_SQL}, st AS (SELECT ticker, w, dir, entry_open, entry_close, i, horizon[i].high AS hi, horizon[i].low AS lo, horizon[i].close AS cl, list_aggregate(list_transform(paths, lambda p: p[i]), 'quantile_cont', 0.8) AS q8, list_aggregate(list_transform(paths, lambda p: p[i]), 'quantile_cont', 0.2) AS q2
                 FROM pw, unnest(range(1, {PL + 1})) u(i) WHERE dir <> 0),
        lv AS (SELECT *, CASE WHEN q8 > entry_close THEN q8 END AS above, CASE WHEN q2 < entry_close THEN q2 END AS below FROM st),
        rs AS (SELECT *, CASE WHEN dir = 1 AND lo <= below THEN 'sl' WHEN dir = 1 AND hi >= above THEN 'tp' WHEN dir = -1 AND hi >= above THEN 'sl' WHEN dir = -1 AND lo <= below THEN 'tp' WHEN i = {PL} THEN 'close' END AS reason FROM lv),
        ft AS (SELECT * FROM rs WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker, w ORDER BY i) = 1),
        px AS (SELECT *, dir * (CASE WHEN reason = 'sl' THEN CASE WHEN dir = 1 THEN below ELSE above END WHEN reason = 'tp' THEN CASE WHEN dir = 1 THEN above ELSE below END ELSE cl END - entry_open) / entry_open AS ret FROM ft)
        SELECT (SELECT count(*) FROM pw) AS total_windows, count(*) AS entered, count(*) FILTER (reason = 'tp') AS tp_hits, count(*) FILTER (reason = 'sl') AS sl_hits, count(*) FILTER (reason = 'close') AS closes, count(*) FILTER (ret > 0) AS wins, round(sum(ret) * 100, 4) AS total_return_pct FROM px""",
)
def x06(spark, sf):
    f = window_features(spark, sf)
    x = simulate.stepwise_trade(F.col("dir"), F.col("entry_open"), F.col("horizon"), atoms.boundaries(F.col("paths"), F.col("entry_close")))
    t = f.withColumn("x", F.when(F.col("dir") != 0, x))
    count = lambda reason: F.count_if(F.col("x.reason") == reason)
    return t.agg(
        F.count("*").alias("total_windows"), F.count("x").alias("entered"), count("tp").alias("tp_hits"), count("sl").alias("sl_hits"), count("close").alias("closes"),
        F.count_if(F.col("x.ret") > 0).alias("wins"), r(F.sum("x.ret") * 100, 4).alias("total_return_pct"),
    )


