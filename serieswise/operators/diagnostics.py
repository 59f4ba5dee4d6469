"""Tables behind the evaluation charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieswise import config as C
from serieswise.config import KEYS, POS
from serieswise.operators.blocks import Frames, rolling, running_sum, scan
from serieswise.operators.features import rolling_mean, rolling_std
from serieswise.operators.frames import one_row, safe_corr, stacked, with_series_rows
from serieswise.operators.ordered import exact_quantiles
from serieswise.operators.scoring import YEAR


def rolling_risk(df: DataFrame, window: int = 63, least: int = 21, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add rolling Sharpe and annual volatility of strategy and market."""
    root = F.sqrt(F.lit(YEAR))

    def build(f: Frames) -> dict[str, Column]:
        w = f.last(window)
        std = rolling_std(F.col("strategy_returns"), w, least)
        market = rolling_std(F.col("forward_returns"), w, least)
        sharpe = rolling_mean(F.col("excess"), w, least) / F.when(std > 0, std) * root
        return {
            "rolling_sharpe": sharpe,
            "rolling_vol": std * root * 100,
            "market_rolling_vol": market * root * 100,
        }

    return rolling(df, build, window, keys=keys)


def residual_table(df: DataFrame, actual: str, predicted: str, window: int = 63, least: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Residual, its rolling mean and its running sum."""
    rows = df.withColumn("residual", F.col(actual) - F.col(predicted))
    rows = rolling(
        rows, lambda f: {"rolling_residual": rolling_mean(F.col("residual"), f.last(window), least)}, window, keys=keys
    )
    return scan(rows, {"cumulative_residual": running_sum(F.col("residual"))}, keys)


def residual_histogram(df: DataFrame, residual: str = "residual", bins: int = 50) -> DataFrame:
    """bin, left_edge, count of the residuals, empty bins too."""
    from serieswise.operators.profile import histogram

    return histogram(df, residual, bins)


def learning_curve(folds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Verdict on bias and variance from fold errors."""
    s = folds.groupBy(*keys).agg(
        F.avg(F.col("mae") - F.col("train_mae")).alias("mae_gap"),
        F.avg("train_mae").alias("train_mae"),
        F.avg("mae").alias("mae"),
        F.percentile("mae", F.lit(0.8)).alias("mae_p80"),  # one value per fold
    )
    verdict = (
        F.when(F.col("train_mae").isNull(), "unknown")
        .when(F.col("mae_gap") > F.col("train_mae") * 0.5, "high_variance")
        .when(F.col("mae") > F.col("mae_p80"), "high_bias")
        .otherwise("balanced")
    )
    return s.withColumn("verdict", verdict)


def learning_curve_folds(folds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per fold of a walk-forward table: sizes, features, errors of training and validation rows, score, and the verdict over all folds."""
    shown = ["fold", "train_size", "val_size", "n_features", "train_mae", "mae", "train_r2", "r2", "adjusted_sharpe"]
    verdict = learning_curve(folds, keys).select(*keys, "mae_gap", "verdict")
    rows = folds.select(*keys, *shown)
    return rows.join(verdict, list(keys)) if keys else rows.crossJoin(verdict)  # one row


def monthly_returns(df: DataFrame, time: str = "dt", keys: Sequence[str] = KEYS) -> DataFrame:
    """Compounded return per calendar month, long form."""
    return df.groupBy(*keys, F.year(time).alias("year"), F.month(time).alias("month")).agg(
        (F.product(F.lit(1.0) + F.col("strategy_returns")) - 1).alias("ret")
    )


def monthly_pivot(monthly: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Year by month, columns m1..m12."""
    month = lambda m: F.max(F.when(F.col("month") == m, F.col("ret"))).alias(f"m{m}")
    return monthly.groupBy(*keys, "year").agg(*[month(m) for m in range(1, 13)])


def chunk_returns(df: DataFrame, chunks: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """Compounded return of consecutive chunks of max(1, n // chunks) rows."""
    rows = with_series_rows(df, keys)
    size = F.greatest(F.lit(1), F.floor(F.col("_n") / chunks))
    return rows.groupBy(*keys, F.floor(F.col(POS) / size).alias("chunk")).agg(
        (F.product(F.lit(1.0) + F.col("strategy_returns")) - 1).alias("ret")
    )


def ic_scatter(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Pearson correlation, least-squares line and symmetric axis limit."""
    sizes = df.select(F.abs(predicted).alias("p"), F.abs(actual).alias("a"))
    limits = exact_quantiles(sizes, ["p", "a"], [0.99])
    lim = one_row(limits.agg(F.max("quantile").alias("v")))
    return df.agg(
        safe_corr(F.col(predicted), F.col(actual)).alias("ic"),
        F.regr_slope(actual, predicted).alias("slope"),
        F.regr_intercept(actual, predicted).alias("intercept"),
    ).select("*", lim["v"].alias("axis_limit"))


def metric_table(strategy: DataFrame, benchmark: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """metric, strategy value, benchmark value, note; from one-row metric tables."""
    bench = one_row(benchmark)
    rows = [
        {
            "metric": F.lit(m),
            "strategy": F.col(m).cast("double"),
            "benchmark": bench[m].cast("double") if m in bench else F.lit(None).cast("double"),
            "note": F.lit(note),
        }
        for m, note in metrics.items()
    ]
    return stacked(strategy, rows)
