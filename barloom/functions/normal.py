"""Normal distribution in expressions, and its inverse for driver-side numbers."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, functions as F

# Coefficients of the rational approximation 26.2.17 of Abramowitz and Stegun (error below 7.5e-8).
P = 0.2316419
B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def cdf(x: Column) -> Column:
    t = 1.0 / (1.0 + P * F.abs(x))
    poly = F.lit(0.0)
    for b in reversed(B):
        poly = (poly + b) * t
    tail = F.exp(-x * x / 2.0) * 0.3989422804014327 * poly
    return F.when(x >= 0, 1.0 - tail).otherwise(tail)


def cdf_sql(x: str) -> str:
    """The same in SQL."""
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {P}::DOUBLE * abs({x})))"
    poly = "0.0::DOUBLE"
    for b in reversed(B):
        poly = f"(({poly} + ({b})::DOUBLE) * {t})"
    tail = f"(exp(-({x}) * ({x}) / 2.0::DOUBLE) * 0.3989422804014327::DOUBLE * {poly})"
    return f"CASE WHEN ({x}) >= 0 THEN 1.0::DOUBLE - {tail} ELSE {tail} END"


def quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
