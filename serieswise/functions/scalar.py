"""Row-level expressions, Column in and Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """Bounded value; null stays null (greatest and least skip nulls)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def ratio(x: Column, d: Column) -> Column:
    """Quotient, null where the divisor is zero."""
    return x / F.when(d != 0, d)


def linear_position(p: Column, base: float = 1.0, scale: float = 1.0) -> Column:
    return clip(F.lit(base) + F.lit(scale) * (p - F.lit(0.5)), 0.0, 2.0)


def _edge(p: Column, scale: float) -> Column:
    return clip(F.lit(scale) * (p - F.lit(0.5)), -10.0, 10.0)


def sigmoid_position(p: Column, scale: float = 5.0) -> Column:
    return F.lit(2.0) / (F.lit(1.0) + F.exp(-_edge(p, scale)))


def tanh_position(p: Column, scale: float = 5.0) -> Column:
    return F.lit(1.0) + F.tanh(_edge(p, scale))


# fixed values: names used in result tables
POSITION_MAPS = {"Linear": linear_position, "Sigmoid": sigmoid_position, "Tanh": tanh_position}


def strategy_return(position: Column, forward: Column, rate: Column) -> Column:
    return rate * (F.lit(1.0) - position) + position * forward


def hard_label(probability: Column) -> Column:
    return (probability >= 0.5).cast("int")


def direction(y: Column, threshold: float = 0.0) -> Column:
    """1 above the threshold, else 0; a missing value counts as not above."""
    return F.coalesce((y > F.lit(threshold)).cast("int"), F.lit(0))


def rate_regime(rate: Column, threshold: float) -> Column:
    return F.coalesce((rate >= F.lit(threshold)).cast("int"), F.lit(0))


def residual(actual: Column, predicted: Column) -> Column:
    return actual - predicted


def finite(x: Column) -> Column:
    """Null instead of NaN and infinities."""
    inf = F.lit(float("inf"))
    return F.when(~F.isnan(x) & (F.abs(x) != inf), x)


def raw_source(feature: Column) -> Column:
    """Raw column an engineered feature comes from, else its first character."""
    found = F.regexp_extract(feature, r"^([A-Z]+\d+)", 1)
    return F.when(found != "", found).otherwise(F.substring(feature, 1, 1))
