"""Queries that write files in the shared folder and read them back (survey §2.1, 2.12)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.config import SHORT
from barloom.operators import evaluation, forecast, loader, reports, signals, simulate, windows
from barloom.plans.base import BARS_SQL, RAW_SQL, bars, r
from barloom.plans.registry import query, table
from barloom.plans.reports import _QUARTERS_SQL, EVALUATION_SQL, evaluated, per_bar
from barloom.plans.trading import BELIEF_SQL, FEATURE_SQL, PL, S, TRADES_SQL, WIN_SQL, feats, signals_sql
from barloom.sources import bars as source
from barloom.sources import connectors, matrix, results
from barloom.sources.shared import shared_dir


def fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/barloom/{name}-{uuid.uuid4().hex}"


@query(
    "s18_sample_files",
    f"""WITH {WIN_SQL} SELECT ticker, w, (s - 1)::INT AS s, (h - 1)::INT AS h, round(paths[s][h]::FLOAT::DOUBLE, 3) AS path_close, round(horizon[h].close::FLOAT::DOUBLE, 3) AS actual_close
        FROM wins, unnest(range(1, {S + 1})) a(s), unnest(range(1, {PL + 1})) b(h)""",
)
def s18_files(spark, sf):
    """Samples and actual bars through files of 32-bit blobs."""
    w = windows.sliding_windows(forecast.get_forecaster("analog").transform(bars(spark, sf), SHORT), SHORT)
    w = w.withColumn("actual", F.transform("horizon", lambda b: F.array(b["open"], b["high"], b["low"], b["close"])))
    path = fresh(spark, "samples")
    results.save_samples(w, path)
    back = results.load_samples(spark, path, SHORT.pred_len)
    e = back.select("ticker", F.col("window_id").alias("w"), "actual", F.posexplode("paths").alias("s", "path")).select("ticker", "w", "s", "actual", F.posexplode("path").alias("h", "c"))
    return e.select("ticker", "w", "s", "h", r(F.col("c"), 3).alias("path_close"), r(F.get(F.get("actual", F.col("h")), F.lit(3)), 3).alias("actual_close"))


@query("s19_belief_files", f"WITH {BARS_SQL}, {BELIEF_SQL} SELECT ticker, bar_ix, s, h, round(confidence::FLOAT::DOUBLE, 5) AS confidence, round(entropy_s1::FLOAT::DOUBLE, 4) AS entropy_s1, round(top3_mass::FLOAT::DOUBLE, 5) AS top3_mass FROM beliefs")
def s19_files(spark, sf):
    path = fresh(spark, "beliefs")
    results.save_beliefs(forecast.beliefs(bars(spark, sf), SHORT), path, lookback=SHORT.lookback)
    return results.load_beliefs(spark, path).select("ticker", "bar_ix", "s", "h", r("confidence", 5), r("entropy_s1", 4), r("top3_mass", 5))


@query(
    "s20_metric_files",
    f"""WITH {EVALUATION_SQL}, mm AS (SELECT ticker, month, count(*) AS n_windows, avg(direction_accuracy) AS a, avg(mae) AS e FROM ev GROUP BY 1, 2)
        SELECT ticker, month, n_windows, round(a, 6) AS direction_accuracy, round(e, 6) AS mae, (SELECT count(*) FROM mm) AS months, (SELECT round(avg(e), 6) FROM mm) AS mean_mae FROM mm""",
)
def s20_files(spark, sf):
    """Monthly metrics in Parquet and their summary in JSON."""
    path = fresh(spark, "metrics")
    results.save_monthly_metrics(evaluation.monthly_means(evaluated(spark, sf)), f"{path}/monthly")
    monthly = spark.read.parquet(f"{path}/monthly")
    results.save_summary(monthly.agg(F.count("*").alias("months"), F.avg("mae").alias("mean_mae")), f"{path}/summary")
    summary = spark.read.schema("months bigint, mean_mae double").json(f"{path}/summary")
    return monthly.select("ticker", "month", "n_windows", r("direction_accuracy"), r("mae")).join(F.broadcast(summary.select("months", r("mean_mae"))))


@query(
    "s21_quarter_csv",
    f"WITH {_QUARTERS_SQL} SELECT strategy, quarter, n_bars::INT AS n_bars, n_active::INT AS n_active, round(total_pnl, 6) AS total_pnl, round(profit_factor, 4) AS profit_factor, round(aver_ret, 8) AS aver_ret, round(sharpe, 2) AS sharpe FROM ql WHERE n_active >= CASE WHEN quarter = 'overall' THEN 11 ELSE 10 END",
)
def s21_files(spark, sf):
    path = fresh(spark, "quarters")
    results.save_csv(reports.quarter_rows(per_bar(spark, sf)).select("strategy", "quarter", "n_bars", "n_active", *reports.QUARTER_DIGITS), path, reports.QUARTER_DIGITS)
    back = results.load_csv(spark, path)
    return back.select("strategy", "quarter", F.col("n_bars").cast("int").alias("n_bars"), F.col("n_active").cast("int").alias("n_active"), *[r(F.col(c).cast("double"), d).alias(c) for c, d in reports.QUARTER_DIGITS.items()])


@query(
    "s27_array_files",
    f"""WITH {BARS_SQL} SELECT ticker, bar_ix::BIGINT AS ix, close, volume, false AS is_missing FROM bars UNION ALL SELECT 'absent', -1, 0.0, 0.0, true""",
)
def s27_files(spark, sf):
    """An array file for each ticker, all files of the folder read back, and the wanted tickers that have none."""
    path = fresh(spark, "arrays")
    results.save_arrays(bars(spark, sf), path, "bar_ix", ["close", "volume"]).count()
    back = results.load_arrays(spark, path, ["close", "volume"])
    wanted = bars(spark, sf).select("ticker").distinct().unionByName(spark.createDataFrame([("absent",)], "ticker string"))
    gone = results.without_arrays(wanted, back).select("ticker", F.lit(-1).cast("bigint").alias("ix"), F.lit(0.0).alias("close"), F.lit(0.0).alias("volume"), F.lit(True).alias("is_missing"))
    return back.withColumn("is_missing", F.lit(False)).unionByName(gone)


@query(
    "s06_interval_fallback",
    f"""WITH {RAW_SQL}, coarse AS (SELECT event_type AS ticker, b AS ts, arg_min(100 + value, t) AS open, max(100 + value) AS high, min(100 + value) AS low, arg_max(100 + value, t) AS close, count(*)::DOUBLE AS volume
            FROM (SELECT event_type, value, ts AS t, time_bucket(INTERVAL 4 hour, ts) AS b FROM events WHERE event_type IN ('click', 'view')) GROUP BY event_type, b),
        again AS (SELECT ticker, b AS ts, arg_min(close, ts) AS open, max(close) AS high, min(close) AS low, arg_max(close, ts) AS close, sum(volume) AS volume
            FROM (SELECT *, time_bucket(INTERVAL 4 hour, ts) AS b FROM raw WHERE ticker NOT IN ('click', 'view')) GROUP BY ticker, b)
        SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, open, high, low, close, volume FROM (SELECT * FROM coarse UNION ALL SELECT * FROM again)""",
)
def s06_fallback(spark, sf):
    """Tickers that the coarse feed has come from it, the others are resampled from the fine one."""
    ticks = source.event_ticks(table(spark, sf, "events"))
    coarse = source.ticks_to_bars(ticks.filter(F.col("ticker").isin("click", "view")), 240)
    both = connectors.first_per_key(coarse, source.resample(source.ticks_to_bars(ticks, 60), 240))
    return both.select("ticker", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "open", "high", "low", "close", "volume")


@query("w32_close_momentum", f"WITH {BARS_SQL} SELECT ticker, bar_ix, coalesce(close > lag(close) OVER (PARTITION BY ticker ORDER BY bar_ix), false) AS close_rising FROM bars")
def w32(spark, sf):
    from barloom.operators.rolling import close_rising

    return close_rising(bars(spark, sf)).select("ticker", "bar_ix", "close_rising")


_TICKERS = ["click", "error", "purchase", "signup", "view"]
# The ranges are parts of the feed's weeks.
_SPLITS = {"train": ("2024-01-01", "2024-01-15"), "val": ("2024-01-15", "2024-01-22"), "test": ("2024-01-22", "2025-01-01")}
_SPLIT_SQL = "CASE " + " ".join(f"WHEN ts >= '{a}' AND ts < '{b}' THEN '{n}'" for n, (a, b) in _SPLITS.items()) + " END"


@query(
    "s24_stacked_matrix",
    f"""WITH {BARS_SQL}, x AS (SELECT *, {_SPLIT_SQL} AS split FROM bars), c AS (SELECT split, ts FROM x GROUP BY 1, 2 HAVING count(DISTINCT ticker) = 5)
        SELECT x.split, x.ticker, strftime(x.ts, '%Y-%m-%d %H:%M:%S') AS ts, {", ".join(f"round(x.{f}::FLOAT::DOUBLE, 3) AS {f}" for f in matrix.FIELDS)} FROM x JOIN c ON c.split = x.split AND c.ts = x.ts WHERE x.ts < '2024-01-29'""",
)
def s24_matrix(spark, sf):
    """Session bars at common times as a dense matrix of 32-bit floats in blocks of 16 times, read back by range."""
    path = fresh(spark, "matrix")
    matrix.save_matrix(bars(spark, sf), path, _TICKERS, _SPLITS, block=16)
    rows = matrix.matrix_to_long(spark, matrix.load_matrix(spark, path, end="2024-01-29"), path)
    return rows.select("split", "ticker", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), *[r(f, 3) for f in matrix.FIELDS])


@query(
    "s30_wide_file",
    f"""WITH {RAW_SQL}, l AS (SELECT ticker, ts, unnest(['open', 'high', 'low', 'close', 'volume']) AS field, unnest([open, high, low, close, volume]) AS value FROM raw)
        SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, ticker || '_' || field AS name, round(value::FLOAT::DOUBLE, 3) AS value FROM l""",
)
def s30_wide(spark, sf):
    """Bars as a wide file of 32-bit columns, read back and unpivoted."""
    path = fresh(spark, "wide")
    matrix.save_wide(source.ticks_to_bars(source.event_ticks(table(spark, sf, "events")), 60), path, _TICKERS)
    wide = spark.read.parquet(path)
    columns = [c for c in wide.columns if c != "timestamp"]
    long = wide.select("timestamp", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("value")) for c in columns])).alias("x")).filter("x.value is not null")
    return long.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("ts"), "x.name", r(F.col("x.value").cast("double"), 3).alias("value"))


_LOADED = [signals.Strategy("WF", signals.WF), signals.Strategy("WF+pct", signals.WF, signals.PCT, "no_tp"), signals.Strategy("V>2", signals.reward_ratio(2.0), "bb_mom")]


@query(
    "g06_loaded_strategies",
    f"WITH {FEATURE_SQL}, {signals_sql(_LOADED)}, {TRADES_SQL} SELECT strategy, ticker, w, sig::INT AS sig, reason, round(ret, 6) + 0.0 AS ret FROM trades",
)
def g06_loaded(spark, sf):
    """Trades of strategies that were saved in a registry, loaded from it by name and checked against the features."""
    path = fresh(spark, "strategies")
    connectors.save_registry(loader.registry_rows(spark, _LOADED), path)
    f = feats(spark, sf)
    found = loader.load_from(spark, path, f, ["WF", "V>2", "WF+pct"])
    return simulate.simulate(signals.signals(f, found)).select("strategy", "ticker", "w", "sig", "reason", r("ret"))
