"""Backward-looking features; every recipe is one select over one block window."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from serieswise import config as C
from serieswise.config import KEYS, POS
from serieswise.functions.scalar import rate_regime, ratio
from serieswise.operators import whole_series as arrays
from serieswise.operators.blocks import Frames, Span, is_blocked, last_known, rolling, scan
from serieswise.operators.frames import trim_leading_empty


def enough(agg: Column, x: Column, w: Span, least: int) -> Column:
    """Frame result where the frame holds at least ``least`` known values."""
    return w.of(agg) if least <= 1 else F.when(w.of(F.count(x)) >= least, w.of(agg))


def rolling_mean(x: Column, w: Span, least: int = 1) -> Column:
    return enough(F.avg(x), x, w, least)


def rolling_std(x: Column, w: Span, least: int) -> Column:
    return enough(F.stddev_samp(x), x, w, least)


def dev_ratio(x: Column, w: Span) -> Column:
    mean = rolling_mean(x, w)
    return ratio(x - mean, mean)


def momentum(x: Column, f: Frames, lag: int) -> Column:
    return ratio(x, f.shifted(F.lag(x, lag))) - 1


def rank_pct(x: Column, w: Span, least: int = 5) -> Column:
    """Share of the frame's rows not above the current value; nulls rank last."""
    frame = w.of(F.collect_list(F.struct(x.alias("v"))))
    at_most = F.when(x.isNull(), F.size(frame)).otherwise(F.size(F.filter(frame, lambda s: s["v"] <= x)))
    return F.when(w.of(F.count(x)) >= least, at_most / F.size(frame))


def zscore(x: Column, w: Span, least: int) -> Column:
    return ratio(x - rolling_mean(x, w, least), enough(F.stddev_pop(x), x, w, least))


Recipe = Callable[[Frames], Column]


def steps_v1(columns: Sequence[str]) -> dict[str, tuple[str, str, int]]:
    """Name of every first-generation feature whose column is present: its kind, column and window."""
    have, out = set(columns), {}
    for c in [c for c in C.MACRO_COLS if c in have]:
        out |= {f"{c}_dev_ratio_w{w}": ("dev_ratio", c, w) for w in C.MACRO_WINDOWS}
    dynamic = [c for c in C.DYNAMIC_COLS if c in have]
    for c in dynamic:
        out |= {f"{c}_mom_w{w}": ("mom", c, w) for w in C.MOMENTUM_LAGS}
    out |= {f"{c}_rank_pct_w{C.RANK_WINDOW}": ("rank_pct", c, C.RANK_WINDOW) for c in dynamic}
    for c in [c for c in C.PRICE_COLS if c in have]:
        out |= {f"{c}_mr_z_w{w}": ("mr_z", c, w) for w in C.REVERSION_WINDOWS}
    for c in [c for c in C.SENTIMENT_COLS if c in have]:
        out[f"{c}_smooth_w{C.SMOOTH_WINDOW}"] = ("smooth", c, C.SMOOTH_WINDOW)
        out[f"{c}_spike_z_w{C.SPIKE_WINDOW}"] = ("spike_z", c, C.SPIKE_WINDOW)
    return out


# kind of a first-generation feature -> its column, from the raw column, the frames and the window
KINDS_V1: dict[str, Callable[[Column, Frames, int], Column]] = {
    "dev_ratio": lambda x, f, w: dev_ratio(x, f.last(w)),
    "mom": momentum,
    "rank_pct": lambda x, f, w: rank_pct(x, f.last(w)),
    "mr_z": lambda x, f, w: zscore(x, f.last(w), 5),
    "smooth": lambda x, f, w: rolling_mean(x, f.last(w)),
    "spike_z": lambda x, f, w: zscore(x, f.last(w), 3),
}


def recipe_v1(columns: Sequence[str]) -> dict[str, Recipe]:
    """Name and builder of every first-generation feature whose column is present."""
    return {n: lambda f, kind=kind, c=c, w=w: KINDS_V1[kind](F.col(c), f, w) for n, (kind, c, w) in steps_v1(columns).items()}


# the kinds from the values of a series and where they are known: values and where those are known
ARRAYS_V1: dict[str, Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]] = {
    "dev_ratio": arrays.dev_ratio,
    "mom": arrays.momentum,
    "rank_pct": lambda x, there, w: arrays.rank_pct(x, there, w, 5),
    "mr_z": lambda x, there, w: arrays.zscore(x, there, w, 5),
    "smooth": arrays.rolling_mean,
    "spike_z": lambda x, there, w: arrays.zscore(x, there, w, 3),
}
# columns whose values are doubles as they are
EXACT = (T.DoubleType, T.FloatType, T.IntegerType, T.ShortType, T.ByteType)


def features_v1(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """A series that fits a block is an array: Spark's sliding frames visit every row of a frame again for each row."""
    steps = steps_v1(df.columns)
    if not is_blocked(df) and steps and all(isinstance(df.schema[c].dataType, EXACT) for _, c, _ in steps.values()):
        return _whole_features(df, steps, keys)
    back = max([*C.MACRO_WINDOWS, *C.REVERSION_WINDOWS, *C.MOMENTUM_LAGS])
    made = recipe_v1(df.columns)
    return rolling(df, lambda f: {n: build(f) for n, build in made.items()}, back, keys=keys)


def _whole_features(df: DataFrame, steps: dict[str, tuple[str, str, int]], keys: Sequence[str]) -> DataFrame:
    kept = [c for c in df.columns if c not in steps]
    used = sorted({c for _, c, _ in steps.values()})

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(POS)
        cells = {c: (arrays.column(table, c), arrays.known(table, c)) for c in used}
        made = [ARRAYS_V1[kind](*cells[c], w) for kind, c, w in steps.values()]
        columns = [pa.array(values, pa.float64(), mask=~there) for values, there in made]
        return pa.Table.from_arrays([*table.select(kept).columns, *columns], names=[*kept, *steps])

    schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(n, T.DoubleType()) for n in steps]])
    return df.groupBy(*keys).applyInArrow(run, schema)


def _diff(x: Column, f: Frames, lag: int) -> Column:
    return x - F.lag(x, lag).over(f.ordered)


def _lagged_diff(x: Column, f: Frames, lag: int) -> Column:
    return F.lag(x, lag).over(f.ordered) - F.lag(x, lag + 1).over(f.ordered)


def recipe_v2(columns: Sequence[str]) -> dict[str, dict[str, Recipe]]:
    """Raw column -> feature name -> builder."""
    rules: dict[str, Callable[[str], dict[str, Recipe]]] = {
        "M": lambda c: {f"{c}_roll{C.M_WINDOW}": lambda f: rolling_mean(F.col(c), f.last(C.M_WINDOW))},
        "E": lambda c: {f"{c}_diff{w}": lambda f, w=w: _diff(F.col(c), f, w) for w in C.E_LAGS},
        "I": lambda c: {f"{c}_diff1_lag{C.I_LAG}": lambda f: _lagged_diff(F.col(c), f, C.I_LAG)},
        "P": lambda c: {
            f"{c}_dev{C.P_WINDOW}": lambda f: F.col(c) - rolling_mean(F.col(c), f.last(C.P_WINDOW), 5)
        },
        "V": lambda c: {f"{c}_roll{C.V_WINDOW}": lambda f: rolling_mean(F.col(c), f.last(C.V_WINDOW))},
        "S": lambda c: {f"{c}_lag1": lambda f: F.lag(F.col(c), 1).over(f.ordered)},
    }
    have = set(columns)
    return {c: rule(c) for p, rule in rules.items() for c in C.RAW_COLUMNS[p] if c in have}


def engineered_map(columns: Sequence[str]) -> dict[str, list[str]]:
    return {raw: list(made) for raw, made in recipe_v2(columns).items()}


def features_v2(
    df: DataFrame, keys: Sequence[str] = KEYS, trim: bool = True
) -> tuple[DataFrame, dict[str, list[str]]]:
    """Engineered panel and the raw -> engineered name map."""
    made = {n: b for group in recipe_v2(df.columns).values() for n, b in group.items()}

    def build(f: Frames) -> dict[str, Column]:
        out = {n: b(f) for n, b in made.items()}
        out["rate_regime"] = rate_regime(F.col("risk_free_rate"), C.RATE_REGIME_THRESHOLD)
        return out

    out = rolling(df, build, back=max(C.E_LAGS), keys=keys)
    if trim and made:
        out = trim_leading_empty(out, list(made), keys)
    return out, engineered_map(df.columns)


def forward_fill(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    return scan(df, {c: last_known(F.col(c)) for c in cols}, keys)


def fill_columns(df: DataFrame, target: str = C.EXCESS_TARGET) -> list[str]:
    """Everything but keys and the target."""
    from serieswise.operators.frames import HELPER_COLS

    return [c for c in df.columns if c not in {C.DAY, target, *HELPER_COLS}]


def smooth_positions(df: DataFrame, column: str, window: int, keys: Sequence[str] = KEYS) -> DataFrame:
    return rolling(df, lambda f: {column: rolling_mean(F.col(column), f.last(window))}, window, keys=keys)


def sequence_windows(
    df: DataFrame, cols: Sequence[str], target: str, length: int, include_current: bool, keys: Sequence[str] = KEYS
) -> DataFrame:
    """``sequence``: the last ``length`` feature rows as arrays, with the target to predict.

    ``include_current`` ends the sequence on the target's own row, otherwise it
    ends one row earlier. Incomplete sequences are dropped.
    """
    row = F.array(*[F.col(c).cast("double") for c in cols])

    def build(f: Frames) -> dict[str, Column]:
        frame = f.last(length) if include_current else f.rows(-length, -1)
        return {"sequence": frame.of(F.collect_list(row)), "target": F.col(target)}

    out = rolling(df, build, length, keys=keys)
    return out.filter(F.size("sequence") == length)
