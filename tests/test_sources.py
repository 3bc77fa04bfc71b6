"""Files, pages, registry and streams."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from barloom.operators import sweep
from barloom.sources import candle_source, connectors
from barloom.sources import bars as source


def page(columns, rows):
    return json.dumps({"columns": columns, "rows": rows}).encode()


def test_pages_become_rows(spark, tmp_path):
    (tmp_path / "A-2024-01-15.json").write_bytes(page(["begin", "open", "close", "value"], [["2024-01-15 10:10:00", "2", "x", 5], ["2024-01-15 10:00:00", 1, 1.5, None], [None, 1, 1, 1]]))
    (tmp_path / "A-2024-02-01.json").write_bytes(page(["begin", "open"], [["2024-02-01 10:00:00", 3]]))
    candle_source.register(spark)
    df = spark.read.format("candle_pages").options(tickers="A,B", start="2024-01-15", end="2024-02-10", url=f"file://{tmp_path}/{{ticker}}-{{start}}.json").load()
    got = [(r.ticker, str(r.ts), r.open, r.close, r.amount) for r in df.orderBy("ts").collect()]
    assert got == [("A", "2024-01-15 10:00:00", 1.0, 1.5, None), ("A", "2024-01-15 10:10:00", 2.0, None, 5.0), ("A", "2024-02-01 10:00:00", 3.0, None, None)]


def test_index_pages_go_on_until_empty(spark, tmp_path):
    for offset, rows in ((0, [["2024-01-01", 1], ["2024-01-02", 2]]), (2, [["2024-01-02", 2], ["2024-01-03", 3]])):
        (tmp_path / f"{offset}.json").write_bytes(page(["TRADEDATE", "CLOSE"], rows))
    candle_source.register(spark)
    df = spark.read.format("candle_pages").options(tickers="I", start="2024-01-01", end="2024-01-31", mode="index", page_size="2", url=f"file://{tmp_path}/{{offset}}.json").load()
    assert sorted(r.close for r in df.collect()) == [1.0, 2.0, 3.0]


def test_retry_doubles_its_pauses():
    tries, pauses = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return b"x"

    assert candle_source.with_retry(call, 5, 0.5, pauses.append) == b"x" and pauses == [0.5, 1.0]
    with pytest.raises(ZeroDivisionError):
        candle_source.with_retry(lambda: 1 / 0, 2, 0.0, pauses.append)


def test_months():
    assert list(candle_source.months(date(2023, 12, 30), date(2024, 2, 1))) == [(date(2023, 12, 30), date(2023, 12, 31)), (date(2024, 1, 1), date(2024, 1, 31)), (date(2024, 2, 1), date(2024, 2, 1))]


def test_wide_needs_its_columns(spark):
    with pytest.raises(ValueError, match="A_low"):
        source.wide_to_long(spark.createDataFrame([(1,)], "timestamp int"), ["A"])


def test_cache_makes_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert connectors.cached(spark, str(tmp_path), connectors.cache_key("a/b", 1), make).count() == 3
    assert made == [1]


def test_csv_to_registry(spark, tmp_path):
    (tmp_path / "m.csv").write_text("strategy,sharpe,win_rate\n WF ,1.5,\nX,bad,0.5\n")
    got = {r.name: r.metrics for r in connectors.registry_from_csv(spark, str(tmp_path / "m.csv")).collect()}
    assert got == {"WF": {"sharpe": 1.5}, "X": {"win_rate": 0.5}}


def test_registry_round_trip(spark, tmp_path):
    rows = [("1", "a", "S", {"k": "v"}, None, None, "ok", {"sharpe": 1.0})]
    connectors.save_registry(spark.createDataFrame(rows, connectors.REGISTRY), str(tmp_path / "r"))
    assert connectors.load_registry(spark, str(tmp_path / "r")).first().metrics == {"sharpe": 1.0}


def test_bars_through_files(spark, make_bars, tmp_path):
    connectors.save_bars(make_bars([(1, 1, 1, 1)] * 5), str(tmp_path))
    assert connectors.load_bars(spark, str(tmp_path)).count() == 5 and connectors.load_manifest(spark, str(tmp_path)).first().n_rows == 5


def test_params_merge_last_wins(spark):
    maps = [F.create_map(*map(F.lit, kv)) for kv in (("a", "1", "b", "1"), ("b", "2", "c", "2"), ("c", "3"))]
    assert spark.range(1).select(sweep.merged_params(*maps)).first()[0] == {"a": "1", "b": "2", "c": "3"}


def test_stream_equals_batch(spark):
    from barloom.plans import queries
    from barloom.sources.bars import event_ticks, ticks_to_bars

    from .conftest import SMALL

    live = queries()["v01_streaming_candles"](spark, SMALL)
    batch = ticks_to_bars(event_ticks(spark.read.parquet(f"{SMALL}/events.parquet")), 60)
    key = lambda df: {(r.ticker, str(r.ts)): (r.open, r.high, r.low, r.close, r.volume) for r in df.collect()}
    a, b = key(live), key(batch)
    assert a and all(b[k] == v for k, v in a.items()) and len(b) - len(a) < 20


def test_daily_pages_follow_their_cursor(spark, tmp_path):
    for at, rows in ((0, [["2024-01-01", 1], ["2024-01-02", None]]), (2, [["2024-01-03", 3]])):
        body = json.dumps({"columns": ["TRADEDATE", "CLOSE"], "rows": rows, "cursor": [at, 3, 2]})
        (tmp_path / f"{at}.json").write_text(body)
    candle_source.register(spark)
    df = spark.read.format("candle_pages").options(tickers="I", start="2024-01-01", end="2024-01-31", mode="daily", url=f"file://{tmp_path}/{{offset}}.json").load()
    assert sorted(r.close for r in df.collect()) == [1.0, 3.0]


def test_ingest_job(spark, tmp_path):
    from barloom.sources import ingest

    def put(ticker, start, day, close):
        (tmp_path / f"{ticker}-{start}.json").write_bytes(page(["begin", "open", "high", "low", "close", "volume"], [[f"{day} 10:00:00", 1, 2, 1, close, 10]]))

    put("A", "2024-01-01", "2024-01-03", 2)
    put("B", "2024-01-01", "2024-01-04", 3)
    lots, out = spark.createDataFrame([("A", 10)], "ticker string, lot int"), f"file://{tmp_path}/out"
    job = lambda today="2024-02-01", **more: ingest.ingest(spark, f"file://{tmp_path}/{{ticker}}-{{start}}.json", ["A", "B"], "2024-01-01", "2024-02-10", out, lots, today=today, **more)
    assert ingest.status(spark, out).count() == 0
    assert [(c.ticker, str(c.begin), c.expected) for c in job(dry_run=True).orderBy("ticker", "begin").collect()] == [("A", "2024-01-01", 23 * 52), ("A", "2024-02-01", 7 * 52), ("B", "2024-01-01", 23 * 52), ("B", "2024-02-01", 7 * 52)]
    assert {r.ticker: r.n_rows for r in job().collect()} == {"A": 1, "B": 1}
    put("A", "2024-02-01", "2024-02-05", 4)
    put("B", "2024-01-01", "2024-01-04", 99)  # has landed, so it isn't asked for again
    assert sorted((c.ticker, str(c.begin)) for c in job(resume=True, dry_run=True).collect()) == [("A", "2024-02-01"), ("B", "2024-02-01")]
    assert {r.ticker: r.n_rows for r in job(resume=True).collect()} == {"A": 2, "B": 1}
    assert sorted((r.ticker, r.close, r.amount) for r in connectors.load_bars(spark, out).collect()) == [("A", 2.0, 200.0), ("A", 4.0, 400.0), ("B", 3.0, 30.0)]
    assert {r.ticker: r.n_rows for r in ingest.status(spark, out).collect()} == {"A": 2, "B": 1}


def test_cache_makes_again_what_is_cut_off(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(1000)

    assert connectors.cached(spark, str(tmp_path), "k", make).count() == 1000
    for part in (tmp_path / "k").glob("*.parquet"):
        part.write_bytes(part.read_bytes()[:60])
    for crc in (tmp_path / "k").glob(".*.crc"):
        crc.unlink()
    assert connectors.cached(spark, str(tmp_path), "k", make).count() == 1000 and len(made) == 2


def test_registry_goes_back_to_its_own_place(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = [("1", "a", "S", {"k": "v"}, None, None, "ok", {"sharpe": 1.0})]
    connectors.save_registry(spark.createDataFrame(rows, connectors.REGISTRY), path)
    new = spark.createDataFrame([("a", {"sharpe": 2.0}), ("b", {"sharpe": 3.0})], "name string, metrics map<string,double>")
    connectors.save_registry(connectors.upsert(connectors.load_registry(spark, path), new), path)
    assert {r.name: (r.asset, r.metrics["sharpe"]) for r in connectors.load_registry(spark, path).collect()} == {"a": ("S", 2.0), "b": (None, 3.0)}


def test_streaming_ema_carries_on(spark, tmp_path):
    """Two batches of files give what one pass over all closes gives."""
    from datetime import datetime, timedelta

    from barloom.streaming.candles import streaming_ema

    closes = [10.0, 11.0, 9.0, 12.0, 13.0, 8.0]
    for k in range(2):
        rows = [("T", datetime(2024, 1, 1) + timedelta(hours=i), closes[i]) for i in range(3 * k, 3 * k + 3)]
        spark.createDataFrame(rows, "ticker string, ts timestamp, close double").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("ticker string, ts timestamp, close double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = streaming_ema(stream, 3).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination()
    want = [closes[0]]
    for c in closes[1:]:
        want.append(want[-1] + 0.5 * (c - want[-1]))
    assert [r.ema for r in spark.read.parquet(f"{tmp_path}/out").orderBy("ts").collect()] == pytest.approx(want)


def test_ledger(spark, tmp_path):
    """A month without bars is done; one that had begun is fetched on; repeated bars and crashes add nothing."""
    from barloom.sources import ingest

    lots, out = spark.createDataFrame([], "ticker string, lot int"), f"file://{tmp_path}/out"

    def put(start, *bars):
        (tmp_path / f"A-{start}.json").write_bytes(page(["begin", "close", "volume"], [[f"{day} {at}:00", close, 1] for day, at, close in bars]))

    def job(end, today, **more):
        return ingest.ingest(spark, f"file://{tmp_path}/{{ticker}}-{{start}}.json", ["A", "B"], "2024-01-10", end, out, lots, today=today, **more)

    def left(end, today):
        return sorted((c.ticker, str(c.begin), str(c.finish)) for c in job(end, today, resume=True, dry_run=True).collect())

    def closes():
        return {str(r.ts)[5:16]: r.close for r in connectors.load_bars(spark, out).filter("ticker = 'A'").collect()}

    put("2024-01-10", ("2024-01-15", "10:00", 1))
    put("2024-02-01", ("2024-02-02", "10:00", 2), ("2024-02-02", "10:00", 3), ("2024-02-05", "10:00", 4))
    job("2024-02-29", "2024-02-05")
    assert closes() == {"01-15 10:00": 1.0, "02-02 10:00": 2.0, "02-05 10:00": 4.0}
    # B has no bars, and its January is done all the same; of February the days before the fifth are.
    assert left("2024-02-29", "2024-02-05") == left("2024-02-29", "2024-02-06") == [("A", "2024-02-05", "2024-02-29"), ("B", "2024-02-05", "2024-02-29")]
    put("2024-02-05", ("2024-02-05", "10:00", 99), ("2024-02-05", "11:00", 5), ("2024-02-07", "10:00", 6))
    job("2024-02-29", "2024-03-01", resume=True)
    assert closes() == {"01-15 10:00": 1.0, "02-02 10:00": 2.0, "02-05 10:00": 4.0, "02-05 11:00": 5.0, "02-07 10:00": 6.0}
    assert left("2024-02-29", "2024-03-09") == []
    # The range's end moves within a month, and over it.
    assert left("2024-03-04", "2024-03-09") == [("A", "2024-03-01", "2024-03-04"), ("B", "2024-03-01", "2024-03-04")]
    job("2024-03-04", "2024-03-09", resume=True)
    assert left("2024-03-06", "2024-03-09") == [("A", "2024-03-05", "2024-03-06"), ("B", "2024-03-05", "2024-03-06")]
    # A run that dies before its ledger is fetched again, and what it saved isn't doubled.
    put("2024-03-05", ("2024-03-05", "10:00", 7))
    job("2024-03-06", "2024-03-09", resume=True)
    n = len(closes())
    spark.createDataFrame([(t, a, b, c) for t, a, b, c in map(tuple, ingest.ledger(spark, out).filter("begin < '2024-03-05'").collect())], ingest.LEDGER).write.parquet(f"{out}/kept")
    spark.read.parquet(f"{out}/kept").write.mode("overwrite").parquet(f"{out}/ledger")
    assert left("2024-03-06", "2024-03-09") == [("A", "2024-03-05", "2024-03-06"), ("B", "2024-03-05", "2024-03-06")]
    job("2024-03-06", "2024-03-09", resume=True)
    assert len(closes()) == n == connectors.load_bars(spark, out).count() and left("2024-03-06", "2024-03-09") == []
    # Without resume all is made anew.
    job("2024-01-31", "2024-03-09")
    assert closes() == {"01-15 10:00": 1.0} and left("2024-02-02", "2024-03-09") == [("A", "2024-02-01", "2024-02-02"), ("B", "2024-02-01", "2024-02-02")]


def test_rate_of_all_tasks(spark):
    """Four lanes together keep their rate, retries included, and an answer 429 waits as long as it says."""
    import threading
    import time
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    calls, refused = [], []

    class Api(BaseHTTPRequestHandler):
        def do_GET(self):
            calls.append((time.monotonic(), self.path))
            if "C-2024-02" in self.path and len(refused) < 1:
                refused.append(time.monotonic())
                self.send_response(429)
                self.send_header("Retry-After", "2")
                self.end_headers()
                return
            body = page(["begin", "close"], [["2024-01-01 10:00:00", 1]])
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        candle_source.register(spark)
        url = f"http://127.0.0.1:{server.server_port}/{{ticker}}-{{start}}"
        options = {"tickers": "A,B,C,D,E,F", "start": "2024-01-01", "end": "2024-04-30", "url": url, "rate": "8", "lanes": "4", "delay": "0.01"}
        df = spark.read.format("candle_pages").options(**options).load()
        assert df.rdd.getNumPartitions() == 4 and df.count() == 24
    finally:
        server.shutdown()
    at = sorted(t for t, _ in calls)
    assert len(at) == 25
    for k, t in enumerate(at):  # no more than the rate in any second, but for how late a task began
        assert sum(t <= u < t + 1 for u in at[k:]) <= 8 + 4
    assert at[-1] - at[0] > 24 / 8 - 1
    again = [t for t, p in calls if "C-2024-02" in p]
    assert len(again) == 2 and again[1] - again[0] >= 2


def test_pace_never_catches_up():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = candle_source.Pace(0.5, 2.0, lambda: now[0], sleep)
    times = []
    for late in (0, 0, 5.0, 0):
        now[0] += late
        pace.wait()
        times.append(now[0])
    assert times == [0.5, 2.5, 7.5, 9.5]


def test_header_of_429():
    from email.utils import format_datetime
    from datetime import datetime, timedelta, timezone
    from urllib.error import HTTPError

    error = lambda code, value: HTTPError("u", code, "m", {"Retry-After": value} if value else {}, None)
    soon = format_datetime(datetime.now(timezone.utc) + timedelta(seconds=30), usegmt=True)
    assert [candle_source.asked_to_wait(e) for e in (error(429, "7"), error(429, None), error(500, "7"), error(429, "-1"), error(429, "x"), OSError())] == [7.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert 20 < candle_source.asked_to_wait(error(429, soon)) <= 30
    pauses = []

    def call():
        if len(pauses) < 2:
            raise error(429, "3" if pauses else None)
        return b"x"

    assert candle_source.with_retry(call, 5, 0.5, pauses.append) == b"x" and pauses == [0.5, 3.0]


def test_config_files(tmp_path):
    from barloom.config import SHORT, Horizon, configured, load_config, merged

    (tmp_path / "a.yaml").write_text("data:\n  lookback: 48\n  tickers: [A, B]\nsweep: {seed: 1}\n")
    (tmp_path / "b.json").write_text('{"data": {"lookback": 500, "start": "2023-01-01"}, "sweep": 7}')
    (tmp_path / "empty.yaml").write_text("")
    a, b = str(tmp_path / "a.yaml"), f"file://{tmp_path}/b.json"
    assert load_config(a, b) == {"data": {"lookback": 500, "tickers": ["A", "B"], "start": "2023-01-01"}, "sweep": 7}
    assert load_config(b, a)["sweep"] == {"seed": 1} and load_config(str(tmp_path / "empty.yaml")) == {}
    assert load_config(a, f"global={b}")["global"]["data"]["lookback"] == 500 and load_config(a, f"global={b}")["data"]["lookback"] == 48
    (tmp_path / "list.yaml").write_text("- 1")
    with pytest.raises(ValueError, match="holds no map"):
        load_config(str(tmp_path / "list.yaml"))
    assert merged({"x": {"y": 1}}, {"x": {"z": 2}}, {"x": {"y": None}}) == {"x": {"y": None, "z": 2}}
    assert configured(SHORT, {"pred_len": 12}) == Horizon(48, 12, 5)
    with pytest.raises(ValueError, match="unknown parameters: .*nope"):
        configured(SHORT, {"nope": 1})
