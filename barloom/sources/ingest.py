"""The ingest job: fetch what is missing, add amounts, save, and report.

A ledger beside the bars says how far each (ticker, chunk) is covered.  It is added to
after the bars are saved, so a run that dies in between fetches those chunks again;
bars that are there already stay, and repeated ones are left out.  A chunk without
bars is covered too, and one that had only begun, or whose end has moved, is fetched on
after the last covered day.  Only days that are over count as covered.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.sources import candle_source, connectors
from barloom.sources.bars import expected_bars, month_chunks, with_amount

LEDGER = "ticker string, month date, begin date, covered date"


def planned(spark: SparkSession, tickers: list[str], start: str, end: str, per_day: int = 52) -> DataFrame:
    """The chunks of a range: ticker, begin, finish and the bars that its weekdays should have."""
    names = spark.createDataFrame([(t,) for t in tickers], "ticker string")
    chunks = names.select("ticker", F.explode(month_chunks(start, end)).alias("c")).select("ticker", "c.begin", "c.finish")
    return chunks.withColumn("expected", expected_bars(F.col("begin"), F.col("finish"), per_day))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Days covered so far: a row per fetched chunk and run."""
    if not connectors.exists(spark, f"{path}/ledger"):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{path}/ledger")


def covered(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, month, since, until): the days of each month from its first covered one on without a gap."""
    rows = ledger(spark, path).groupBy("ticker", "month").agg(F.array_sort(F.collect_list(F.struct("begin", "covered"))).alias("spans"))
    joined = F.aggregate(
        "spans",
        F.element_at("spans", 1),
        lambda a, s: F.when(s["begin"] <= F.date_add(a["covered"], 1), F.struct(a["begin"].alias("begin"), F.greatest(a["covered"], s["covered"]).alias("covered"))).otherwise(a),
    )
    return rows.withColumn("span", joined).select("ticker", "month", F.col("span.begin").alias("since"), F.col("span.covered").alias("until"))


def missing(spark: SparkSession, path: str, chunks: DataFrame, today: str | None = None) -> DataFrame:
    """What is left of the chunks up to ``today``, which is asked for whenever it is part of one."""
    own = chunks.withColumn("month", F.trunc("begin", "month")).join(covered(spark, path), ["ticker", "month"], "left")
    begun = F.coalesce((F.col("since") <= F.col("begin")) & (F.col("until") >= F.col("begin")), F.lit(False))
    now = F.lit(today or str(date.today())).cast("date")
    left = own.filter((F.col("begin") <= now) & (~begun | (F.col("until") < F.least("finish", now))))
    per_day = F.col("expected") / F.greatest(F.lit(1), expected_bars(F.col("begin"), F.col("finish"), 1))
    begin = F.when(begun, F.date_add("until", 1)).otherwise(F.col("begin"))
    return left.withColumn("expected", (per_day * expected_bars(begin, F.col("finish"), 1)).cast("int")).withColumn("begin", begin).drop("month", "since", "until")


def merged(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """The bars of ``new`` whose (ticker, ts) ``old`` doesn't have, one of each."""
    once = new.dropDuplicates(["ticker", "ts"])
    return once if old is None else once.join(old.select("ticker", "ts"), ["ticker", "ts"], "left_anti").select(*new.columns)


def ingest(
    spark: SparkSession,
    url: str,
    tickers: list[str],
    start: str,
    end: str,
    path: str,
    lots: DataFrame,
    resume: bool = False,
    dry_run: bool = False,
    today: str | None = None,
    **options: object,
) -> DataFrame:
    """Fetch the months of all tickers, save them with amounts, and return the manifest.

    ``resume`` fetches what the ledger doesn't cover up to ``today`` and adds to what is
    there; a run without it replaces everything.  ``dry_run`` returns the chunks that would
    be fetched and fetches nothing.  More options go to the source: interval, mode,
    attempts, delay, rate, lanes.  The chunks, tickers times months, are listed on the driver.
    """
    today = today or str(date.today())
    chunks = planned(spark, tickers, start, end)
    chunks = missing(spark, path, chunks, today) if resume else chunks.filter(F.col("begin") <= F.lit(today).cast("date"))
    if dry_run:
        return chunks
    asked = [(c.ticker, c.begin, c.finish) for c in chunks.collect()]
    if not asked:
        return status(spark, path)
    candle_source.register(spark)
    only = ",".join(f"{t}:{a}:{b}" for t, a, b in asked)
    reader = spark.read.format("candle_pages").options(tickers=",".join(tickers), start=start, end=end, url=url, chunks=only, **{k: str(v) for k, v in options.items()})
    if not resume:  # what it said of the old bars must be gone before they are
        spark.createDataFrame([], LEDGER).write.mode("overwrite").parquet(f"{path}/ledger")
    old = connectors.load_bars(spark, path) if resume and connectors.exists(spark, f"{path}/bars") else None
    connectors.save_bars(with_amount(merged(old, reader.load()), lots), path, "append" if resume else "overwrite")
    last = date.fromisoformat(today) - timedelta(days=1)
    done = [(t, a.replace(day=1), a, min(b, last)) for t, a, b in asked if a <= last]
    spark.createDataFrame(done, LEDGER).coalesce(1).write.mode("append").parquet(f"{path}/ledger")
    return status(spark, path)


def status(spark: SparkSession, path: str) -> DataFrame:
    """Rows and range of each saved ticker; no rows before the first run."""
    if not connectors.exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], "ticker string, n_rows bigint, first_ts string, last_ts string")
    return connectors.load_manifest(spark, path)
