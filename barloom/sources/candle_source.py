"""A Spark data source for paged candle APIs.

``spark.read.format("candle_pages")`` with the options

    tickers    comma-separated
    start, end dates; one input partition per ticker and calendar month
    interval   minutes of a bar, sent on to the API
    url        template with {ticker} {interval} {start} {end} {offset}; http(s), or any
               path that pyarrow's file systems open
    mode       candles (default); index: pages go on by offset until one is empty;
               daily: pages go on until their cursor has reached its total, and days
               without a close are dropped
    page_size  rows of a full page (500)
    attempts, delay   tries per page, and seconds of the first pause, which doubles; an
               answer 429 waits for its Retry-After, if that is longer
    rate, lanes       calls per second of all tasks together (no bound), and the input
               partitions among which the months are then dealt (8).  A lane may call
               every lanes / rate seconds, retries included, its first call shifted by
               its number / rate; calls that are late aren't caught up on
    chunks     comma-separated ticker:first-day:last-day to read instead of all months

A page is JSON: {"columns": [...], "rows": [[...], ...], "cursor": [index, total,
size]}, the cursor in mode daily only.  Numbers that don't parse become null; rows
without a time are dropped; a month that never answers raises, so Spark repeats the
task.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from email.utils import parsedate_to_datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "ticker string, ts timestamp_ntz, open double, high double, low double, close double, volume double, amount double"
# Names that pages use for our columns.
RENAMED = {"begin": "ts", "timestamp": "ts", "tradedate": "ts", "value": "amount"}
_FIELDS = ("open", "high", "low", "close", "volume", "amount")
_CLOSE = 2 + _FIELDS.index("close")


@dataclass
class MonthOfTicker(InputPartition):
    ticker: str
    start: str
    end: str


@dataclass
class Lane(InputPartition):
    """Months that one task reads, and when it may call."""

    months: list[MonthOfTicker]
    first: float = 0.0
    every: float = 0.0


class Pace:
    """Waits so that calls are at least ``every`` seconds apart."""

    def __init__(self, first: float, every: float, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.every, self.now, self.sleep = every, now, sleep
        self.next = now() + first

    def wait(self) -> None:
        if not self.every:
            return
        if (left := self.next - self.now()) > 0:
            self.sleep(left)
        self.next = max(self.next, self.now()) + self.every


def months(start: date, end: date) -> Iterator[tuple[date, date]]:
    while start <= end:
        after = (start.replace(day=1) + timedelta(days=32)).replace(day=1)
        yield start, min(end, after - timedelta(days=1))
        start = after


def open_page(uri: str) -> bytes | None:
    """The body at a URI; None if there is no such page."""
    if uri.startswith(("http://", "https://")):
        from urllib.error import HTTPError
        from urllib.request import urlopen

        try:
            with urlopen(uri, timeout=30) as answer:
                return answer.read()
        except HTTPError as e:
            if e.code == 404:
                return None
            raise
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(path) as stream:
        return stream.read()


def asked_to_wait(error: Exception) -> float:
    """Seconds that an answer 429 asks for, in its header as a number or a date; 0 for other errors."""
    if getattr(error, "code", None) != 429:
        return 0.0
    asked = (getattr(error, "headers", None) or {}).get("Retry-After")
    try:
        return max(0.0, float(asked))
    except (TypeError, ValueError):
        pass
    try:
        return max(0.0, parsedate_to_datetime(asked).timestamp() - time.time())
    except (TypeError, ValueError):
        return 0.0


def with_retry(call: Callable[[], bytes | None], attempts: int, delay: float, sleep: Callable[[float], None] = time.sleep) -> bytes | None:
    """Try again after pauses that double, or as long as the answer asks for; the last error is raised."""
    for n in range(attempts):
        try:
            return call()
        except Exception as e:
            if n == attempts - 1:
                raise
            sleep(max(delay * 2**n, asked_to_wait(e)))
    return None


def _number(x) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def parse_page(body: bytes | None, ticker: str) -> list[tuple]:
    if not body:
        return []
    page = json.loads(body)
    names = [RENAMED.get(c.lower(), c.lower()) for c in page["columns"]]
    rows = []
    for values in page["rows"]:
        row = dict(zip(names, values, strict=False))
        if row.get("ts"):
            rows.append((ticker, datetime.fromisoformat(str(row["ts"])), *(_number(row.get(f)) for f in _FIELDS)))
    return sorted(rows, key=lambda r: r[1])


class CandlePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "candle_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options

    def partitions(self) -> list[InputPartition]:
        a, b = date.fromisoformat(self.o["start"]), date.fromisoformat(self.o["end"])
        if chunks := self.o.get("chunks"):
            every = [MonthOfTicker(*c.rsplit(":", 2)) for c in chunks.split(",")]
        else:
            every = [MonthOfTicker(t.strip(), str(s), str(e)) for t in self.o["tickers"].split(",") for s, e in months(a, b)]
        rate, lanes = float(self.o.get("rate", 0)), int(self.o.get("lanes", 8))
        if not rate:
            return [Lane([m]) for m in every]
        return [Lane(every[k::lanes], k / rate, lanes / rate) for k in range(min(lanes, len(every)))]

    def read(self, partition: Lane) -> Iterator[tuple]:
        pace = Pace(partition.first, partition.every)
        for month in partition.months:
            yield from self._month(month, pace)

    def _month(self, partition: MonthOfTicker, pace: Pace) -> Iterator[tuple]:
        size, attempts, delay = int(self.o.get("page_size", 500)), int(self.o.get("attempts", 5)), float(self.o.get("delay", 0.5))
        mode, offset, seen = self.o.get("mode", "candles"), 0, set()

        def call(uri: str) -> bytes | None:
            pace.wait()
            return open_page(uri)

        while True:
            uri = self.o["url"].format(ticker=partition.ticker, interval=self.o.get("interval", "10"), start=partition.start, end=partition.end, offset=offset)
            body = with_retry(lambda u=uri: call(u), attempts, delay)
            rows = parse_page(body, partition.ticker)
            for row in rows:
                if row[1] not in seen and not (mode == "daily" and row[_CLOSE] is None):
                    seen.add(row[1])
                    yield row
            if mode == "candles" or not rows:
                return
            offset += size
            if mode == "daily":
                at, total, step = json.loads(body).get("cursor", (0, 0, size))
                offset = at + step
                if offset >= total:
                    return


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CandlePages)
