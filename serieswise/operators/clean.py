"""Isolated-spike cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieswise.config import KEYS
from serieswise.operators.blocks import Frames, block_rows, is_blocked, rolling
from serieswise.operators.frames import stacked
from serieswise.operators.ordered import attach, quantile_columns


def mark_spikes(
    df: DataFrame,
    cols: Sequence[str],
    quantile: float = 0.005,
    ratio: float = 10.0,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Add ``<col>__spike`` and the thresholds ``<col>__low``, ``<col>__high``.

    A spike lies outside the series' own quantiles, has two known neighbours
    inside them, and exceeds ``ratio`` times both non-zero neighbours in size.
    """
    bound = None if is_blocked(df) else block_rows(df)
    limits = quantile_columns(df, cols, {"low": quantile, "high": 1 - quantile}, keys, bound)
    rows = attach(df, limits, keys)

    def spike(c: str, f: Frames) -> Column:
        out = (F.col(c) < F.col(f"{c}__low")) | (F.col(c) > F.col(f"{c}__high"))
        size = F.abs(F.col(c))
        sides = [F.lag, F.lead]
        calm = [~f.shifted(shift(out, 1)) for shift in sides]
        near = [f.shifted(shift(size, 1)) for shift in sides]
        bigger = [(n > 0) & (size > n * ratio) for n in near]
        return F.coalesce(out & calm[0] & calm[1] & bigger[0] & bigger[1], F.lit(False))

    return rolling(
        rows, lambda f: {f"{c}__spike": spike(c, f) for c in cols}, 1, 1, keys
    )


def clean_spikes(
    df: DataFrame,
    cols: Sequence[str],
    quantile: float = 0.005,
    ratio: float = 10.0,
    keys: Sequence[str] = KEYS,
) -> tuple[DataFrame, DataFrame]:
    """Spikes set to null, and a summary per key and column."""
    marked = mark_spikes(df, cols, quantile, ratio, keys)
    cleaned = marked.select(
        *[
            F.when(~F.col(f"{c}__spike"), F.col(c)).alias(c) if c in cols else F.col(c)
            for c in df.columns
        ]
    )
    counts = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(f"{c}__spike")).alias(c) for c in cols],
        *[F.max(f"{c}__{side}").alias(f"{c}__{side}") for c in cols for side in ("low", "high")],
    )
    summary = stacked(
        counts,
        [
            {
                "feature": F.lit(c),
                "dirty_count": F.col(c),
                "dirty_rate": F.col(c) / F.col("_rows"),
                "lower_thr": F.col(f"{c}__low"),
                "upper_thr": F.col(f"{c}__high"),
            }
            for c in cols
        ],
        keys,
    )
    return cleaned, summary
