"""Dense matrices and wide files, and strategies loaded from the registry."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import loader, signals
from barloom.operators.signals import Strategy
from barloom.plans import trading
from barloom.sources import connectors, matrix

from .conftest import SMALL

BARS = "ticker string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
SPLITS = {"train": ("2024-01-01", "2024-01-03"), "test": ("2024-01-03", "2024-01-05")}


def bar_rows():
    rows = []
    for k in range(120):
        ts = datetime(2024, 1, 1) + timedelta(hours=k)  # five days, the last outside both splits
        for t, every in (("A", 1), ("B", 5)):
            if k % every != 1 or t == "A":
                rows.append((t, ts, 1.0 + k, 2.5 + k, 0.1 * k, None if k == 7 and t == "A" else 1 / (k + 1), float(k)))
    rows.append(("Z", datetime(2024, 1, 1), *[9.0] * 5))  # not listed
    return rows + [rows[0]]


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_matrix(spark, tmp_path, block):
    rows = bar_rows()
    matrix.save_matrix(spark.createDataFrame(rows, BARS).repartition(5), str(tmp_path), ["B", "none", "A"], SPLITS, block=block)
    assert matrix.layout(spark, str(tmp_path)) == (["B", "none", "A"], list(matrix.FIELDS), block)
    by = {(t, ts): v for t, ts, *v in rows}
    common = sorted(ts for t, ts in by if t == "A" and ("B", ts) in by and ts < datetime(2024, 1, 5))
    want = {ts: np.array([*by["B", ts], *[0.0] * 5, *[math.nan if x is None else x for x in by["A", ts]]], np.float32) for ts in common}
    got = matrix.load_matrix(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and all(np.array_equal(np.array(r.values, np.float32), want[r.ts], equal_nan=True) for r in got)
    assert {r.ts: r.split for r in got} == {ts: "train" if ts < datetime(2024, 1, 3) else "test" for ts in common}
    blocks = spark.read.parquet(f"{tmp_path}/blocks").orderBy("first_ts").collect()
    assert all(len(b.times) <= block and len(b.data) == len(b.times) * 15 * 4 and b.times == sorted(b.times) for b in blocks)
    for split in SPLITS:
        own = [b for b in blocks if b.split == split]
        assert [b.block for b in own] == list(range(len(own))) and all(len(b.times) == block for b in own[:-1])
    start, end = "2024-01-02 05:00:00", "2024-01-03 09:00:00"
    inside = {ts for ts in common if datetime.fromisoformat(start) <= ts < datetime.fromisoformat(end)}
    assert {r.ts for r in matrix.load_matrix(spark, str(tmp_path), None, start, end).collect()} == inside
    assert {r.ts for r in matrix.load_matrix(spark, str(tmp_path), "train", start, start).collect()} == set()
    assert {r.ts for r in matrix.load_matrix(spark, str(tmp_path), "test", None, end).collect()} == {t for t in inside if t >= datetime(2024, 1, 3)}
    long = matrix.matrix_to_long(spark, matrix.load_matrix(spark, str(tmp_path), "train"), str(tmp_path)).filter("ticker = 'B'").collect()
    assert all((r.open, r.volume) == (by["B", r.ts][0], by["B", r.ts][4]) for r in long) and len(long) == sum(ts < datetime(2024, 1, 3) for ts in common)


def test_matrix_of_nothing(spark, tmp_path):
    matrix.save_matrix(spark.createDataFrame([], BARS), str(tmp_path), ["A"], SPLITS)
    assert matrix.load_matrix(spark, str(tmp_path)).count() == 0
    matrix.save_matrix(spark.createDataFrame(bar_rows(), BARS).filter("ticker = 'B'"), str(tmp_path), ["A", "B"], {"train": ("2030-01-01", "2031-01-01")})
    assert matrix.load_matrix(spark, str(tmp_path)).count() == 0


def test_wide_file(spark, tmp_path):
    d = spark.createDataFrame(bar_rows(), BARS).dropDuplicates(["ticker", "ts"])
    matrix.save_wide(d, str(tmp_path / "w"), ["A", "B"], zone="Europe/Moscow")
    wide = spark.read.parquet(str(tmp_path / "w"))
    assert wide.columns == ["timestamp", *[f"{t}_{f}" for t in "AB" for f in matrix.FIELDS]] and {t for c, t in wide.dtypes if c != "timestamp"} == {"float"}
    rows = wide.orderBy("timestamp").collect()
    assert len(rows) == 120 and rows[0].timestamp == datetime(2024, 1, 1, 3) and rows[1].B_open is None and rows[2].B_open == 3.0 and rows[7].A_close is None


STRATEGIES = [Strategy("WF", signals.WF), Strategy("WF+pct", signals.WF, signals.PCT, "no_tp")]


def test_loaded_strategies(spark, tmp_path):
    path, f = str(tmp_path / "r"), trading.feats(spark, SMALL)
    connectors.save_registry(loader.registry_rows(spark, STRATEGIES), path)
    assert loader.load_from(spark, path, f) == STRATEGIES and loader.load_from(spark, path, f, ["WF+pct", "WF"]) == STRATEGIES[::-1]
    rows = lambda s: sorted(map(tuple, signals.signals(f, s, ("ticker", "w")).collect()))
    assert rows(loader.load_from(spark, path, f, ["WF"])) == rows(STRATEGIES[:1]) != []


def test_bad_strategies_are_named(spark):
    f = spark.createDataFrame([], "ticker string, w bigint, pred_ret double, bb_mom boolean")
    bad = {
        "column": (Strategy("column", "1", "no_such > 1"), "gate: .*no_such"),
        "syntax": (Strategy("syntax", "CASE WHEN", "true"), "signal: "),
        "type": (Strategy("type", "bb_mom", "true"), "signal is of type boolean"),
        "gate": (Strategy("gate", "1", "w"), "gate is of type bigint"),
        "aggregate": (Strategy("aggregate", "int(max(w))", "true"), "signal: "),
        "mode": (Strategy("mode", "1", "true", "sometimes"), "unknown mode 'sometimes'"),
        "sig": (Strategy("sig", "sig", "true"), "signal: .*sig"),
    }
    good = Strategy("good", "int(sign(pred_ret))", "sig = 1 AND bb_mom")
    rows = loader.registry_rows(spark, [good, *(s for s, _ in bad.values())])
    with pytest.raises(loader.BadStrategies) as e:
        loader.load_strategies(rows, f)
    assert set(e.value.reasons) == set(bad)
    import re

    for name, (_, why) in bad.items():
        assert re.search(why, e.value.reasons[name]), (name, e.value.reasons[name])
    assert loader.load_strategies(rows, f, skip_bad=True) == [good]
    with pytest.raises(loader.BadStrategies, match="other: not in the registry"):
        loader.load_strategies(rows, f, ["good", "other"])
    assert loader.load_strategies(rows.withColumn("params", F.lit(None).cast("map<string,string>")), f) == []


def test_registry_survives_a_crash(spark, tmp_path):
    """Where the new one isn't in place yet, the old one is read."""
    path = tmp_path / "r"
    connectors.save_registry(loader.registry_rows(spark, STRATEGIES), str(path))
    path.rename(tmp_path / "r.old")
    assert connectors.load_registry(spark, str(path)).count() == 2
    connectors.save_registry(loader.registry_rows(spark, STRATEGIES[:1]), str(path))
    assert connectors.load_registry(spark, str(path)).count() == 1
    connectors.save_registry(connectors.load_registry(spark, str(path)), str(path))
    assert connectors.load_registry(spark, str(path)).count() == 1 and not (tmp_path / "r.old").exists() and not (tmp_path / "r.new").exists()
