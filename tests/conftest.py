import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_bars(spark):
    """Bars of one ticker from (open, high, low, close[, volume]) rows, one an hour from 10:00, nine a day."""
    from datetime import datetime, timedelta

    from barloom.sources.bars import numbered

    def make(rows, ticker="T", per_day=9):
        out = []
        for k, row in enumerate(rows):
            o, h, l, c, *v = map(float, row)
            ts = datetime(2024, 1, 1, 10) + timedelta(days=k // per_day, hours=k % per_day)
            out.append((ticker, ts, o, h, l, c, v[0] if v else 1.0))
        df = spark.createDataFrame(out, "ticker string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
        return numbered(df.withColumn("amount", df.close * df.volume))

    return make
