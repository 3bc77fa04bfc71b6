"""Tables that many queries start from, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.plans.registry import table
from barloom.sources.bars import session_bars


def bars(spark: SparkSession, sf_dir: str, minutes: int = 60) -> DataFrame:
    """Main-session bars of the event feed; tickers are event types."""
    return session_bars(table(spark, sf_dir, "events"), minutes)


RAW_SQL = """raw AS (
    SELECT event_type AS ticker, b AS ts, arg_min(100 + value, t) AS open, max(100 + value) AS high, min(100 + value) AS low,
           arg_max(100 + value, t) AS close, count(*)::DOUBLE AS volume, sum(100 + value) AS amount
    FROM (SELECT event_type, value, ts AS t, time_bucket(INTERVAL 1 hour, ts) AS b FROM events) GROUP BY event_type, b
)"""

NUMBERED_SQL = """numbered AS (
    SELECT *, row_number() OVER w - 1 AS bar_ix, ts::DATE AS session_date, coalesce(ts::DATE <> lag(ts::DATE) OVER w, true) AS is_day_start
    FROM raw WHERE hour(ts) * 60 + minute(ts) BETWEEN 600 AND 1120 WINDOW w AS (PARTITION BY ticker ORDER BY ts)
), bars AS (
    SELECT *, sum(is_day_start::BIGINT) OVER (PARTITION BY ticker ORDER BY bar_ix) AS session_id FROM numbered
)"""

BARS_SQL = f"{RAW_SQL}, {NUMBERED_SQL}"
BY_BAR_SQL = "PARTITION BY ticker ORDER BY bar_ix"


def r(column: str | Column, digits: int = 6) -> Column:
    """Rounded, so that the last bits of sums in another order don't show; minus zero becomes zero."""
    value = F.col(column) if isinstance(column, str) else column
    rounded = F.round(value, digits) + F.lit(0.0)
    return rounded.alias(column) if isinstance(column, str) else rounded
