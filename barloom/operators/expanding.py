"""Scans along a ticker's bars that windows can't do in linear time.

:func:`ordered_scan` hands the wanted values of a ticker's rows to a small state
machine, batch by batch in the order of an index, so a task holds the state and one
batch, not the history's rows.  Expanding quantiles keep two heaps for each quantile: a value costs
the logarithm of the history, where a window would sort every prefix anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from math import floor, nan

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType, StructField, StructType

Step = Callable[[dict[str, list]], list[list]]


def ordered_scan(df: DataFrame, columns: list[str], outputs: list[str], make: Callable[[], Step], key: str = "ticker", ix: str = "bar_ix") -> DataFrame:
    """``df`` with the double columns ``outputs``.

    ``make`` gives a fresh step for each key; a step maps the next rows' values of
    ``columns`` to the values of ``outputs``.  Only the key, a number and ``columns``
    go to Python; the other columns of a row stay where they are.  Rows come in the
    order of ``ix``: a window numbers them, and a break in the numbers raises.
    """
    number, found = "__barloom_number", "__barloom_found"
    numbered = df.withColumn(number, F.row_number().over(W.partitionBy(key).orderBy(ix)))

    def scan(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        step, at, seen = None, None, 0
        for keys, numbers, *values in batches:
            own, count, pieces = keys.to_pylist(), numbers.to_pylist(), []
            cuts = sorted({0, *(k for k, n in enumerate(count) if n == 1)})
            for a, b in zip(cuts, [*cuts[1:], len(count)], strict=True):
                if count[a : a + 1] == [1]:
                    step, at, seen = make(), own[a], 0
                if count[a:b] != list(range(seen + 1, seen + 1 + b - a)) or any(k != at for k in own[a:b]):
                    raise RuntimeError(f"rows of a {key} did not come in the order of {ix}")
                seen += b - a
                if b > a:
                    part = step({c: v.slice(a, b - a).to_pylist() for c, v in zip(columns, values, strict=True)})
                    pieces.append(pa.StructArray.from_arrays([pa.array(v, pa.float64()) for v in part], names=outputs))
            yield pa.concat_arrays(pieces) if pieces else pa.array([], pa.struct([(name, pa.float64()) for name in outputs]))

    # Not to be moved or left out of a row: what it gives depends on the rows before.
    scanned = arrow_udf(scan, StructType([StructField(name, DoubleType()) for name in outputs])).asNondeterministic()
    return numbered.withColumn(found, scanned(key, number, *columns)).select(*df.columns, *(F.col(f"{found}.{name}").alias(name) for name in outputs))


class Quantile:
    """The interpolated quantile of the values added so far; NaN counts as larger than any other."""

    def __init__(self, p: float):
        self.p, self.low, self.high, self.nans = p, [], [], 0

    def add(self, value: float | None) -> None:
        if value is None:
            return
        low, high = self.low, self.high
        if value != value:
            self.nans += 1
        elif low and value <= -low[0]:
            heappush(low, -value)
        else:
            heappush(high, value)
        # The lower heap holds the values up to the quantile's place.
        known = len(low) + len(high)
        size = min(known, floor(self.p * (known + self.nans - 1)) + 1)
        while len(low) < size:
            heappush(low, -heappop(high))
        while len(low) > size:
            heappush(high, -heappop(low))

    def value(self) -> float | None:
        known = len(self.low) + len(self.high)
        if not known + self.nans:
            return None
        place = self.p * (known + self.nans - 1)
        if place >= known:
            return nan
        below, above, part = -self.low[0], self.high[0] if self.high else nan, place - floor(place)
        return below if not part or above == below else (1 - part) * below + part * above


@dataclass(frozen=True)
class Expanding:
    """A quantile of a column's earlier values; rows with an index under ``current_below`` count the current value too."""

    column: str
    p: float
    name: str
    current_below: int = 0


def expanding_quantiles(df: DataFrame, wanted: list[Expanding], key: str = "ticker", ix: str = "w") -> DataFrame:
    """``df`` with all wanted quantiles in one pass over each key; null where there is no value yet."""

    def make() -> Step:
        tracks = [(e, Quantile(e.p)) for e in wanted]

        def step(rows: dict[str, list]) -> list[list]:
            out = []
            for e, track in tracks:
                found = []
                for at, value in zip(rows[ix], rows[e.column], strict=True):
                    if at < e.current_below:
                        track.add(value)
                        found.append(track.value())
                    else:
                        found.append(track.value())
                        track.add(value)
                out.append(found)
            return out

        return step

    return ordered_scan(df, list({ix, *(e.column for e in wanted)}), [e.name for e in wanted], make, key, ix)


def expanding_quantiles_fast(df: DataFrame, column: str, probabilities: list[float], names: list[str], key: str = "ticker", ix: str = "w") -> DataFrame:
    """(key, ix, names...): quantiles of all earlier values of one column."""
    wanted = [Expanding(column, p, name) for p, name in zip(probabilities, names, strict=True)]
    return expanding_quantiles(df.select(key, F.col(ix).cast("long").alias(ix), column), wanted, key, ix).drop(column)
