"""Strategies as rows of the registry: saved, loaded by name, and checked before anything runs.

A strategy is a signal and a gate in SQL over feature columns.  The analyser checks
both against the features' schema, so a column outside it, a type that doesn't fit or
an aggregate is found by name, without running.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, IntegralType, NumericType, StructType

from barloom.operators.signals import Strategy
from barloom.sources import connectors

MODES = ("default", "no_tp", "no_sl", "weighted")
# A strategy becomes an expression of the plan, so there are only so many in a run.
MOST = 1000


class BadStrategies(ValueError):
    """Strategies that don't fit the features, with the reason for each."""

    def __init__(self, reasons: dict[str, str]):
        self.reasons = reasons
        super().__init__("; ".join(f"{name}: {why}" for name, why in reasons.items()))


def registry_rows(spark: SparkSession, strategies: list[Strategy], status: str = "pending") -> DataFrame:
    """Rows of the registry that hold the strategies' definitions."""
    rows = [(s.name, {"signal": s.signal, "gate": s.gate, "mode": s.mode}, status) for s in strategies]
    named = spark.createDataFrame(rows, "name string, params map<string,string>, status string")
    none = F.lit(None)
    return named.select(
        F.substring(F.md5(F.col("name").cast("binary")), 1, 8).alias("id"), "name", none.cast("string").alias("asset"), "params",
        none.cast("string").alias("data_source"), none.cast("string").alias("code_path"), "status", F.create_map().cast("map<string,double>").alias("metrics"),
    )


def _problem(spark: SparkSession, strategy: Strategy, features: StructType) -> str | None:
    """Why a strategy can't run over these features; None if it can."""
    if strategy.mode not in MODES:
        return f"unknown mode {strategy.mode!r}"
    empty = spark.createDataFrame([], features)
    # A gate sees the signal as ``sig``.
    for what, text, schema, kinds in (("signal", strategy.signal, empty, (IntegralType, NumericType)), ("gate", strategy.gate, empty.withColumn("sig", F.lit(1)), (BooleanType,))):
        try:
            kind = schema.select("*", F.expr(text).alias("__checked")).schema["__checked"].dataType
        except (AnalysisException, ParseException) as e:
            return f"{what}: {str(e).splitlines()[0]}"
        if not isinstance(kind, kinds):
            return f"{what} is of type {kind.simpleString()}"
    return None


def load_strategies(registry: DataFrame, features: DataFrame, names: list[str] | None = None, skip_bad: bool = False) -> list[Strategy]:
    """Strategies of the registry by name (all that have a definition), in the order of names; bad ones raise :class:`BadStrategies`, or are left out."""
    rows = registry.filter(F.try_element_at("params", F.lit("signal")).isNotNull())
    if names is not None:
        rows = rows.filter(F.col("name").isin(names))
    found = {r.name: r.params for r in rows.select("name", "params").limit(MOST + 1).collect()}
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} strategies; name those to load")
    problems = {n: "not in the registry" for n in names or () if n not in found}
    good = []
    for name in names if names is not None else sorted(found):
        if name in problems:
            continue
        p = found[name]
        strategy = Strategy(name, p["signal"], p.get("gate") or "true", p.get("mode") or "default")
        why = _problem(registry.sparkSession, strategy, features.schema)
        if why is None:
            good.append(strategy)
        else:
            problems[name] = why
    if problems and not skip_bad:
        raise BadStrategies(problems)
    return good


def load_from(spark: SparkSession, path: str, features: DataFrame, names: list[str] | None = None) -> list[Strategy]:
    """Strategies of a registry file."""
    return load_strategies(connectors.load_registry(spark, path), features, names)
