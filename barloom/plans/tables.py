"""Queries over sources, filters, joins, the registry, sweeps and streams (survey §2.1-2.3, 2.12-2.17)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from barloom.config import SHORT
from barloom.functions import metrics as m
from barloom.operators import asof, forecast, reports, signals, simulate, sweep
from barloom.plans.base import BARS_SQL, BY_BAR_SQL, RAW_SQL, bars, r
from barloom.plans.registry import query, table
from barloom.plans.trading import FEATURE_SQL, LK, METRICS_SQL, PER_BAR_SQL, PL, S, TRADES_SQL, WIN_SQL, feats, per_bar, signals_sql
from barloom.sources import bars as source
from barloom.sources import connectors
from barloom.sources.shared import shared_dir
from barloom.streaming import candles

TICKERS = ["click", "error", "purchase", "signup", "view"]


def feed(spark, sf, minutes: int = 60) -> DataFrame:
    """Bars of the whole day, before the session filter."""
    return source.ticks_to_bars(source.event_ticks(table(spark, sf, "events")), minutes)


def text(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


@query("s02_tick_bars", f"WITH {RAW_SQL} SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, open, high, low, close, volume, round(amount, 4) AS amount FROM raw")
def s02(spark, sf):
    return feed(spark, sf).select("ticker", text("ts"), "open", "high", "low", "close", "volume", r("amount", 4))


@query("s05_j09_metadata_join", "SELECT s_suppkey, s_name, n_name AS n_name_md, n_regionkey AS n_regionkey_md FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def s05(spark, sf):
    md = table(spark, sf, "nation").withColumnsRenamed({"n_name": "n_name_md", "n_regionkey": "n_regionkey_md"})
    s = table(spark, sf, "supplier")
    return s.join(md, s.s_nationkey == md.n_nationkey, "left").select("s_suppkey", "s_name", "n_name_md", "n_regionkey_md")


@query(
    "a20_resample",
    f"""WITH {RAW_SQL} SELECT ticker, strftime(b, '%Y-%m-%d %H:%M:%S') AS ts, arg_min(close, ts) AS open, max(close) AS high, min(close) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, round(sum(amount), 4) AS amount
        FROM (SELECT *, time_bucket(INTERVAL 4 hour, ts) AS b FROM raw) GROUP BY ticker, b""",
)
def s06(spark, sf):
    """Hourly bars to bars of four hours; all prices from closes."""
    return source.resample(feed(spark, sf), 240).select("ticker", text("ts"), "open", "high", "low", "close", "volume", r("amount", 4))


@query(
    "s08_month_chunks",
    """WITH e AS (SELECT event_type AS ticker, min(ts)::DATE AS a, max(ts)::DATE AS b FROM events GROUP BY 1), m AS (SELECT ticker, a, b, unnest(generate_series(date_trunc('month', a), b, INTERVAL 1 month))::DATE AS m FROM e),
       c AS (SELECT ticker, greatest(a, m) AS begin, least(b, last_day(m)) AS finish FROM m)
       SELECT ticker, begin::VARCHAR AS begin, finish::VARCHAR AS finish, (len(list_filter(generate_series(begin, finish, INTERVAL 1 day), lambda d: isodow(d) < 6)) * 52)::INT AS bars FROM c""",
)
def s08(spark, sf):
    """The chunks of each ticker's whole range, with the bars that their weekdays should have."""
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("ticker")).agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    c = e.select("ticker", F.explode(source.month_chunks(F.col("a"), F.col("b"))).alias("c")).select("ticker", "c.*")
    return c.select("ticker", F.col("begin").cast("string").alias("begin"), F.col("finish").cast("string").alias("finish"), source.expected_bars(F.col("begin"), F.col("finish")).alias("bars"))


@query(
    "s09_pending_chunks",
    """WITH w AS (SELECT DISTINCT event_type AS ticker, ts::DATE AS day FROM events), l AS (SELECT DISTINCT ticker, day FROM w WHERE ticker IN ('click', 'view')) SELECT ticker, day::VARCHAR AS day FROM w ANTI JOIN l USING (ticker, day)""",
)
def s09(spark, sf):
    wanted = table(spark, sf, "events").select(F.col("event_type").alias("ticker"), F.to_date("ts").alias("day")).distinct()
    landed = wanted.filter(F.col("ticker").isin("click", "view"))
    return connectors.pending(wanted, landed, ["ticker", "day"]).select("ticker", F.col("day").cast("string").alias("day"))


@query(
    "s10_amount",
    f"WITH {RAW_SQL} SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(close * volume * CASE ticker WHEN 'click' THEN 10 WHEN 'view' THEN 100 ELSE 1 END, 4) AS amount FROM raw",
)
def s10(spark, sf):
    lots = spark.createDataFrame([("click", 10), ("view", 100)], "ticker string, lot int")
    return source.with_amount(feed(spark, sf), lots).select("ticker", text("ts"), r("amount", 4))


@query(
    "s11_s25_manifest",
    f"WITH {RAW_SQL} SELECT ticker, count(*) AS n_rows, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM raw GROUP BY 1",
)
def s11(spark, sf):
    return source.manifest(feed(spark, sf)).select("ticker", "n_rows", text("first_ts"), text("last_ts"))


@query(
    "s15_s16_s24_s30_j04_wide_and_long",
    f"""WITH {RAW_SQL}, f AS (SELECT * FROM raw WHERE hour(ts) * 60 + minute(ts) BETWEEN 600 AND 1120), c AS (SELECT ts FROM f GROUP BY ts HAVING count(DISTINCT ticker) = 5)
        SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, open, high, low, close, volume FROM f SEMI JOIN c USING (ts)""",
)
def s16(spark, sf):
    """Session bars at common times, pivoted wide and unpivoted again."""
    f = feed(spark, sf).filter(source.in_main_session(F.col("ts")))
    wide = source.long_to_wide(source.common_times(f), TICKERS)
    return source.wide_to_long(wide, TICKERS).select("ticker", text("ts"), "open", "high", "low", "close", "volume")


@query("s18_blob_codec", f"WITH {WIN_SQL} SELECT ticker, bar_ix, {4 * PL * S}::INT AS n_bytes, true AS same FROM win WHERE bar_ix >= {LK}")
def s18(spark, sf):
    """Paths to 32-bit blobs and back."""
    b = forecast.get_forecaster("analog").transform(bars(spark, sf), SHORT).filter(F.col("bar_ix") >= 48)
    coded = b.select("ticker", "bar_ix", "paths", connectors.encode_blob(F.col("paths")).alias("blob"))
    back = coded.withColumn("decoded", connectors.decode_blob(F.col("blob"), SHORT.pred_len))
    worst = F.array_max(F.flatten(F.zip_with("paths", "decoded", lambda p, d: F.zip_with(p, d, lambda x, y: F.abs(x - y) / x))))
    return back.select("ticker", "bar_ix", F.length("blob").alias("n_bytes"), (worst < 1e-6).alias("same"))


@query("s11_bars_and_manifest_files", f"WITH {RAW_SQL} SELECT ticker, count(*) AS n_rows, count(*) AS read_back FROM raw GROUP BY 1")
def s20(spark, sf):
    """Bars and manifest through files in the checkpoint folder (a temporary one on a single machine)."""
    path = f"{shared_dir(spark)}/barloom-bars-{connectors.cache_key(sf)}"
    connectors.save_bars(feed(spark, sf), path)
    return connectors.load_manifest(spark, path).join(connectors.load_bars(spark, path).groupBy("ticker").agg(F.count("*").alias("read_back")), "ticker").select("ticker", "n_rows", "read_back")


@query("s14_s28_cache", f"WITH {RAW_SQL} SELECT ticker, count(*) AS n FROM raw GROUP BY 1")
def s14(spark, sf):
    key = connectors.cache_key("bars", sf, 60, connectors.input_version(spark, f"{sf}/events.parquet"))
    return connectors.cached(spark, f"{shared_dir(spark)}/barloom-cache", key, lambda: feed(spark, sf)).groupBy("ticker").agg(F.count("*").alias("n"))


@query(
    "s26_local_times",
    "SELECT event_id, strftime((ts::TIMESTAMP AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Moscow', '%Y-%m-%d %H:%M:%S') AS ts FROM events",
)
def s26(spark, sf):
    return connectors.normalise_times(table(spark, sf, "events").withColumnRenamed("ts", "begin")).select("event_id", text("ts"))


@query("f01_session_filter", f"WITH {RAW_SQL} SELECT ticker, count(*) AS n, count(*) FILTER (hour(ts) * 60 + minute(ts) BETWEEN 600 AND 1120) AS n_session FROM raw GROUP BY 1")
def f01(spark, sf):
    inside = source.in_main_session(F.col("ts"))
    return feed(spark, sf).groupBy("ticker").agg(F.count("*").alias("n"), F.count_if(inside).alias("n_session"))


@query(
    "f02_day_markers",
    f"""WITH {RAW_SQL} SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, hour(ts) * 60 + minute(ts) BETWEEN 600 AND 1120 AS is_main_session, coalesce(ts::DATE <> lag(ts::DATE) OVER (PARTITION BY ticker ORDER BY ts), true) AS is_day_start FROM raw""",
)
def f02(spark, sf):
    """Markers on the full feed, before any filter."""
    return source.numbered(feed(spark, sf)).select("ticker", text("ts"), source.in_main_session(F.col("ts")).alias("is_main_session"), "is_day_start")


@query(
    "f03_f04_splits",
    f"""WITH {BARS_SQL} SELECT ticker, CASE WHEN ts >= '2024-01-01' AND ts < '2024-01-15' THEN 'train' WHEN ts >= '2024-01-15' AND ts < '2024-01-22' THEN 'val' WHEN ts >= '2024-01-22' AND ts < '2025-01-01' THEN 'test' END AS split, count(*) AS n
        FROM bars WHERE strftime(ts, '%Y') = '2024' GROUP BY 1, 2""",
)
def f03(spark, sf):
    """Half-open splits from a small dimension."""
    splits = spark.createDataFrame([("train", "2024-01-01", "2024-01-15"), ("val", "2024-01-15", "2024-01-22"), ("test", "2024-01-22", "2025-01-01")], "split string, a string, b string")
    b = bars(spark, sf).filter(F.date_format("ts", "yyyy") == "2024")
    inside = (F.col("ts") >= F.col("a").cast("timestamp_ntz")) & (F.col("ts") < F.col("b").cast("timestamp_ntz"))
    return b.join(F.broadcast(splits), inside, "left").groupBy("ticker", "split").agg(F.count("*").alias("n"))


@query(
    "f13_f14_quality_report",
    f"""WITH {RAW_SQL}, l AS (SELECT *, date_diff('second', lag(ts) OVER w, ts) / 60.0 AS gap, ts::DATE = lag(ts::DATE) OVER w AS same_day FROM raw WINDOW w AS (PARTITION BY ticker ORDER BY ts))
        SELECT ticker, count(*) FILTER (close IS NULL) AS n_missing, count(*) < 500 AS too_few, count(*) FILTER (gap <= 0) AS n_unordered, count(*) FILTER (same_day AND gap > 60) AS n_gaps,
               count(*) FILTER (NOT (hour(ts) * 60 + minute(ts) BETWEEN 600 AND 1120)) AS n_off_session, count(*) FILTER (volume <= 0) AS n_no_volume FROM l GROUP BY 1""",
)
def f13(spark, sf):
    return source.quality_report(feed(spark, sf))


# The registry holds what strategies earned on the feed: one entry per strategy and ticker.
_LISTED = [signals.Strategy("WF", signals.WF), signals.Strategy("WF+pct", signals.WF, signals.PCT), signals.Strategy("V>2", signals.reward_ratio(2.0))]
_REGISTRY_SQL = f"""{FEATURE_SQL}, {signals_sql(_LISTED)}, {TRADES_SQL}, {PER_BAR_SQL}, {METRICS_SQL}, registry AS (
    SELECT strategy || '-' || ticker AS name, md5(strategy || '-' || ticker)[1:8] AS id, ticker AS asset, CASE WHEN sharpe >= 0.5 THEN 'verified' ELSE 'pending' END AS status, sharpe, max_dd, win_rate, n_trades FROM mt
)"""


def registry(spark, sf) -> DataFrame:
    """The metrics of some strategies, written as a registry and read back."""
    found = reports.strategy_metrics(per_bar(spark, sf, _LISTED))
    name = F.concat_ws("-", "strategy", "ticker")
    entries = F.create_map(*[x for c in ("sharpe", "max_dd", "win_rate", "n_trades") for x in (F.lit(c), F.col(c).cast("double"))])
    none = F.lit(None).cast("string")
    rows = found.select(
        F.substring(F.md5(name.cast("binary")), 1, 8).alias("id"), name.alias("name"), F.col("ticker").alias("asset"), F.create_map(F.lit("strategy"), F.col("strategy")).alias("params"), none.alias("data_source"), none.alias("code_path"),
        F.when(F.col("sharpe") >= 0.5, "verified").otherwise("pending").alias("status"), entries.alias("metrics"),
    )
    path = f"{shared_dir(spark)}/barloom/registry-{uuid.uuid4().hex}"
    connectors.save_registry(rows, path)
    return connectors.load_registry(spark, path)


def _metric(name: str):
    return F.try_element_at("metrics", F.lit(name))


@query("s23_registry_file", f"WITH {_REGISTRY_SQL} SELECT id, name, asset, status, round(sharpe, 4) AS sharpe, round(max_dd, 6) + 0.0 AS max_dd, n_trades::INT AS n_trades FROM registry")
def s23(spark, sf):
    return registry(spark, sf).select("id", "name", "asset", "status", r(_metric("sharpe"), 4).alias("sharpe"), r(_metric("max_dd")).alias("max_dd"), _metric("n_trades").cast("int").alias("n_trades"))


@query("f11_list_strategies", f"WITH {_REGISTRY_SQL} SELECT name, round(sharpe, 4) AS sharpe FROM registry WHERE sharpe >= -5 AND abs(max_dd) <= 0.5 AND win_rate >= 0.3 AND asset = 'click'")
def f11(spark, sf):
    return connectors.list_strategies(registry(spark, sf), "click", -5, 0.5, 0.3).select("name", r(F.coalesce(_metric("sharpe"), F.lit(0.0)), 4).alias("sharpe"))


@query("f12_lookup", f"WITH {_REGISTRY_SQL} SELECT id, name FROM registry WHERE name IN ('WF-click', 'WF+pct-view') OR id IN (md5('V>2-click')[1:8])")
def f12(spark, sf):
    """By name, by another name, and by an identifier."""
    from hashlib import md5

    known = registry(spark, sf)
    found = [connectors.lookup_strategy(known, key).select("id", "name") for key in ("WF-click", "WF+pct-view", md5(b"V>2-click").hexdigest()[:8])]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("a40_registry_stats", f"WITH {_REGISTRY_SQL} SELECT status, count(*) AS n, round(min(sharpe), 4) AS least, round(max(sharpe), 4) AS most, round(avg(sharpe), 4) AS mean FROM registry GROUP BY 1")
def a40(spark, sf):
    return connectors.registry_stats(registry(spark, sf)).select("status", "n", r("least", 4), r("most", 4), r("mean", 4))


@query(
    "s22_j08_registry_upsert",
    f"""WITH {_REGISTRY_SQL}, n AS (SELECT strategy || '-' || ticker AS name, CASE WHEN ticker = 'error' THEN NULL ELSE round(total_pnl, 6) END AS total_return FROM mt WHERE strategy = 'WF' UNION ALL SELECT 'new-' || ticker, round(total_pnl, 6) FROM mt WHERE strategy = 'V>2')
        SELECT coalesce(o.name, n.name) AS name, o.asset, CASE WHEN n.name IS NULL THEN round(o.sharpe, 4) END AS sharpe, n.total_return FROM registry o FULL JOIN n ON n.name = o.name""",
)
def s22(spark, sf):
    """A metrics file of a run, with blanks and bad numbers, merged into the registry: metrics are replaced, the rest stays."""
    found = reports.strategy_metrics(per_bar(spark, sf, _LISTED)).filter("strategy in ('WF', 'V>2')")
    total = F.format_string("%.6f", "total_pnl")
    name = F.concat(F.when(F.col("strategy") == "WF", " WF-").otherwise("new-"), "ticker")
    rows = found.select(name.alias("strategy"), F.when((F.col("strategy") == "WF") & (F.col("ticker") == "error"), "n/a").otherwise(total).alias("total_return"), F.lit("").alias("sharpe"))
    path = f"{shared_dir(spark)}/barloom/metrics-{uuid.uuid4().hex}"
    rows.write.option("header", True).csv(path)
    merged = connectors.upsert(registry(spark, sf), connectors.registry_from_csv(spark, path))
    return merged.select("name", "asset", r(_metric("sharpe"), 4).alias("sharpe"), r(_metric("total_return")).alias("total_return"))


@query(
    "j02_asof_slices",
    f"""WITH {BARS_SQL}, s AS (SELECT ticker, ts, list(close) OVER q AS cs FROM bars WINDOW q AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
        p AS (SELECT event_type AS ticker, ts AS pred_ts, event_id FROM events)
        SELECT event_id, coalesce(len(cs), -1)::INT AS n, round(list_avg(cs), 6) AS mean_close FROM p ASOF LEFT JOIN s ON s.ticker = p.ticker AND s.ts < p.pred_ts""",
)
def j02(spark, sf):
    """The last ten bars strictly before each event."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("ticker"), F.col("ts").alias("pred_ts"), "event_id")
    s = asof.asof_windows(e, bars(spark, sf).select("ticker", "ts", "close"), "ticker", "pred_ts", 10, ["close"], bucket="week")
    return s.select("event_id", F.when(F.col("slice").isNotNull(), F.size("slice")).otherwise(F.lit(-1)).alias("n"), r(F.aggregate("slice", F.lit(0.0), lambda a, x: a + x["close"]) / F.size("slice")).alias("mean_close"))


@query(
    "j03_nearest",
    f"""WITH {BARS_SQL}, o AS (SELECT DISTINCT event_type AS ticker, date_trunc('minute', ts) AS t FROM events), p AS (SELECT o.*, b.ts AS pt, b.close AS pc FROM o ASOF LEFT JOIN bars b ON b.ticker = o.ticker AND b.ts <= o.t),
        n AS (SELECT p.*, b.ts AS nt, b.close AS nc FROM p ASOF LEFT JOIN bars b ON b.ticker = p.ticker AND b.ts >= p.t)
        SELECT ticker, strftime(t, '%Y-%m-%d %H:%M:%S') AS t, CASE WHEN pt IS NOT NULL AND t - pt <= INTERVAL 1 hour AND (nt IS NULL OR t - pt <= nt - t) THEN pc WHEN nt IS NOT NULL AND nt - t <= INTERVAL 1 hour THEN nc END AS close FROM n""",
)
def j03(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("ticker"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("t")).distinct()
    return asof.nearest_join(e, bars(spark, sf).select("ticker", "ts", "close"), "ticker", "t", "ts", ["close"], bucket="week").select("ticker", text("t"), "close")


@query(
    "j05_two_timeframes",
    f"""WITH {RAW_SQL}, q AS (SELECT ticker, ts, close FROM (SELECT event_type AS ticker, b AS ts, arg_max(100 + value, t) AS close FROM (SELECT event_type, value, ts AS t, time_bucket(INTERVAL 15 minute, ts) AS b FROM events) GROUP BY event_type, b)),
        j AS (SELECT raw.ticker, raw.close AS a, q.close AS b FROM raw JOIN q ON q.ticker = raw.ticker AND q.ts = raw.ts WHERE minute(q.ts) = 0)
        SELECT ticker, count(*) AS n, round(avg(a - b), 6) AS mean_diff, round(stddev_pop(a - b), 6) AS std_diff, round(corr(a, b), 5) AS corr FROM j GROUP BY 1""",
)
def j05(spark, sf):
    quarter = feed(spark, sf, 15).filter(F.minute("ts") == 0).select("ticker", "ts", F.col("close").alias("b"))
    j = feed(spark, sf).select("ticker", "ts", F.col("close").alias("a")).join(quarter, ["ticker", "ts"])
    d = F.col("a") - F.col("b")
    return j.groupBy("ticker").agg(F.count("*").alias("n"), r(F.avg(d)).alias("mean_diff"), r(F.stddev_pop(d)).alias("std_diff"), r(m.pearson("a", "b"), 5).alias("corr"))


@query(
    "j12_g01_sweep",
    f"""WITH {FEATURE_SQL}, {signals_sql([signals.Strategy(f"V>{k:g}", signals.reward_ratio(k)) for k in (1.0, 1.5, 2.0, 3.0)] + [signals.Strategy("WF", signals.WF)])}, {TRADES_SQL},
        m AS (SELECT split_part(strategy, '>', 1) AS family, strategy, count(*) AS n, avg(ret) / greatest(stddev_samp(ret), 1e-10) AS score FROM trades GROUP BY 1, 2)
        SELECT family, strategy, n, round(score, 5) AS score FROM m QUALIFY row_number() OVER (PARTITION BY family ORDER BY score DESC, n DESC) = 1""",
)
def j12(spark, sf):
    """A grid of reward ratios beside the baseline: one pass, best per family."""
    ks = [row.k for row in sweep.grid(spark, k=[1.0, 1.5, 2.0, 3.0]).orderBy("k").collect()]
    chosen = [signals.Strategy(f"V>{k:g}", signals.reward_ratio(k)) for k in ks] + [signals.Strategy("WF", signals.WF)]
    t = simulate.simulate(signals.signals(feats(spark, sf), chosen))
    m = t.groupBy(F.substring_index("strategy", ">", 1).alias("family"), "strategy").agg(F.count("*").alias("n"), (F.avg("ret") / F.greatest(F.stddev_samp("ret"), F.lit(1e-10))).alias("score"))
    return sweep.best_per(m, ["family"], F.col("score").desc(), F.col("n").desc()).select("family", "strategy", "n", r("score", 5))


@query(
    "g02_calibrate",
    f"""WITH {FEATURE_SQL}, s AS (SELECT agree::INT AS agree, (sign(actual_ret) = sign(pred_ret))::INT::DOUBLE AS hit, sign(pred_ret) * actual_ret AS gain FROM feats), m AS (SELECT agree, avg(hit) AS hit, avg(gain) AS gain, count(*) AS n FROM s GROUP BY 1)
        SELECT agree, round(hit, 6) AS hit, round(gain, 6) AS gain, n, row_number() OVER (ORDER BY hit DESC, gain DESC, agree) = 1 AS is_best FROM m""",
)
def g02(spark, sf):
    f = feats(spark, sf)
    s = f.select(F.col("agree").cast("int").alias("agree"), (F.signum("actual_ret") == F.signum("pred_ret")).cast("double").alias("hit"), (F.signum("pred_ret") * F.col("actual_ret")).alias("gain"))
    return sweep.calibrate(s, ["agree"], ["hit", "gain"]).select("agree", r("hit"), r("gain"), "n", "is_best")


@query("g03_seeded_choice", f"WITH {WIN_SQL} SELECT ticker, w FROM wins ORDER BY md5(ticker || ':' || w || ':42'), ticker, w LIMIT 20")
def g03(spark, sf):
    """A sampling operator: 20 windows."""
    return sweep.sample_windows(feats(spark, sf).select("ticker", "w"), 20, 42)


@query(
    "a43_codebook",
    "WITH c AS (SELECT event_type AS stream, (user_id % 16)::INT AS code, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY stream) AS p FROM c) SELECT stream, count(*) AS used, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY 1",
)
def a43(spark, sf):
    """Usage and entropy of codes (here user numbers modulo 16)."""
    from pyspark.sql import Window as W

    c = table(spark, sf, "events").groupBy(F.col("event_type").alias("stream"), (F.col("user_id") % 16).alias("code")).agg(F.count("*").alias("n"))
    p = c.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("stream")))
    return p.groupBy("stream").agg(F.count("*").alias("used"), r(-F.sum(F.col("p") * F.ln("p"))).alias("entropy"))


@query(
    "k07_nucleus",
    "WITH c AS (SELECT event_type AS stream, (user_id % 16)::INT AS code, count(*) AS n FROM events GROUP BY 1, 2), p AS (SELECT stream, code, n / sum(n) OVER (PARTITION BY stream) AS prob FROM c), b AS (SELECT *, coalesce(sum(prob) OVER (PARTITION BY stream ORDER BY prob DESC, code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM p) SELECT stream, code, round(prob / sum(prob) OVER (PARTITION BY stream), 6) AS prob FROM b WHERE bef <= 0.5",
)
def k07(spark, sf):
    from pyspark.sql import Window as W

    c = table(spark, sf, "events").groupBy(F.col("event_type").alias("stream"), (F.col("user_id") % 16).cast("int").alias("code")).agg(F.count("*").alias("n"))
    p = c.select("stream", "code", (F.col("n") / F.sum("n").over(W.partitionBy("stream"))).alias("prob"))
    return forecast.nucleus(p, ["stream"], 0.5).select("stream", "code", r("prob"))


@query(
    "k11_batch_model",
    f"""WITH {BARS_SQL}, c AS (SELECT ticker, bar_ix, close, (close - lag(close, {LK - 1}) OVER w) / {LK - 1} AS step FROM bars WINDOW w AS ({BY_BAR_SQL})) SELECT ticker, bar_ix, round(close + step * {PL}, 6) AS last FROM c WHERE step IS NOT NULL""",
)
def k08(spark, sf):
    """A stand-in model behind the batch interface: last close plus the context's mean step."""

    def load():
        import numpy as np

        def model(context):
            step = (context[:, -1] - context[:, 0]) / (context.shape[1] - 1)
            ahead = np.arange(1, SHORT.pred_len + 1)
            return np.stack([context[:, -1:] + step[:, None] * ahead * (s + 1) / SHORT.samples for s in range(SHORT.samples)], axis=1)

        return model

    b = bars(spark, sf).select("ticker", "bar_ix", "close")
    found = forecast.BatchForecaster(load).transform(b, SHORT)
    return found.select("ticker", "bar_ix", r(F.col("paths")[SHORT.samples - 1][SHORT.pred_len - 1]).alias("last"))


@query(
    "v01_streaming_candles",
    f"""WITH {RAW_SQL} SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, open, high, low, close, volume, round(amount, 4) AS amount FROM raw
        WHERE ts + INTERVAL 1 hour <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 hour""",
)
def v01(spark, sf):
    """Extension: the event feed as a stream, in append mode into files; bars that the watermark hasn't passed aren't final."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    path = f"{shared_dir(spark)}/barloom/candles-{uuid.uuid4().hex}"
    found = candles.streaming_bars(source.event_ticks(stream), 60)
    q = found.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start(f"{path}/bars")
    q.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/bars").select("ticker", text("ts"), "open", "high", "low", "close", "volume", r("amount", 4))


