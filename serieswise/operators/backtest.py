"""Single back-test, the parameter grid and its winner."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieswise import config as C
from serieswise.config import BLOCK, KEYS, POS
from serieswise.functions.scalar import POSITION_MAPS, clip, ratio, strategy_return
from serieswise.operators.blocks import Frames, is_blocked, rolling, running_max, running_product, scan
from serieswise.operators.features import rolling_mean, rolling_std
from serieswise.operators.scoring import YEAR, v1_columns, v1_sums, with_returns
from serieswise.operators.whole_series import column, grid_sums, nullable, per_series

# cells of the grid's curves held at a time
GRID_CELLS = 500_000


class Setting(NamedTuple):
    grid_idx: int
    name: str
    mapping: str
    target: float
    window: int


def grid(targets: Sequence[float] = C.VOL_TARGETS, windows: Sequence[int] = C.VOL_WINDOWS) -> list[Setting]:
    """Every mapping, volatility target and window, in this nesting order."""
    out = []
    for mapping in POSITION_MAPS:
        for target in targets:
            for window in windows:
                name = f"{mapping} | target={target:.2%}, win={window}"
                out.append(Setting(len(out), name, mapping, target, window))
    return out


def vol_scale(deviation: Column, target: float, top: float = 3.0) -> Column:
    """Scale towards the target volatility from the previous row's deviation."""
    daily = F.lit(target) / F.sqrt(F.lit(YEAR))
    return clip(F.coalesce(daily / (deviation + F.lit(1e-8)), F.lit(1.0)), 0.0, top)


def _previous_std(f: Frames, window: int) -> Column:
    # the frame ends one row back, which is the shifted rolling deviation
    frame = f.rows(-window, -1)
    return rolling_std(F.col("forward_returns"), frame, max(5, window // 3))


def vol_target(df: DataFrame, target: float, window: int, position: str = "position", keys: Sequence[str] = KEYS) -> DataFrame:
    rows = rolling(df, lambda f: {"_std": _previous_std(f, window)}, window, keys=keys)
    scaled = clip(F.col(position) * vol_scale(F.col("_std"), target), 0.0, 2.0)
    return rows.withColumn(position, scaled).drop("_std")


def _rolled(df: DataFrame, settings: Sequence[Setting], probability: str, smooth: int, keys: Sequence[str]) -> DataFrame:
    """Smoothed maps and deviations that the settings share, once per day."""
    maps = sorted({s.mapping for s in settings})
    windows = sorted({s.window for s in settings})
    mapped = df.withColumns({f"_{m}": POSITION_MAPS[m](F.col(probability)) for m in maps})

    def build(f: Frames) -> dict[str, Column]:
        out = {f"_std{w}": _previous_std(f, w) for w in windows}
        if smooth > 1:
            out |= {f"_{m}": rolling_mean(F.col(f"_{m}"), f.last(smooth)) for m in maps}
        return out

    return rolling(mapped, build, max([smooth, *windows]), keys=keys)


def _wide_positions(
    df: DataFrame, settings: Sequence[Setting], probability: str, smooth: int, keys: Sequence[str]
) -> DataFrame:
    """Columns ``_pos<i>`` of every setting; rolling parts are computed once per day."""
    rows = _rolled(df, settings, probability, smooth, keys)
    scaled = lambda s: F.col(f"_{s.mapping}") * vol_scale(F.col(f"_std{s.window}"), s.target)
    kept = [*keys, POS, *[c for c in (BLOCK, C.DAY) if c in rows.columns], "forward_returns", "risk_free_rate"]
    return rows.select(*kept, *[clip(scaled(s), 0.0, 2.0).alias(f"_pos{i}") for i, s in enumerate(settings)])


def _long(wide: DataFrame, settings: Sequence[Setting], fields: dict[str, str], kept: Sequence[str]) -> DataFrame:
    cells = [
        F.struct(
            F.lit(s.grid_idx).cast("long").alias("grid_idx"),
            *[F.col(f"{prefix}{i}").alias(name) for name, prefix in fields.items()],
        )
        for i, s in enumerate(settings)
    ]
    return wide.select(*kept, F.explode(F.array(*cells)).alias("_g")).select(*kept, "_g.*")


def grid_positions(
    df: DataFrame, settings: Sequence[Setting], probability: str = "probability",
    smooth: int = C.VOL_SMOOTH, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """One row per setting and day with its ``position``."""
    wide = _wide_positions(df, settings, probability, smooth, keys)
    kept = [c for c in wide.columns if not c.startswith("_pos")]
    return _long(wide, settings, {"position": "_pos"}, kept)


def chosen_positions(
    df: DataFrame, best: DataFrame, settings: Sequence[Setting], probability: str = "probability",
    smooth: int = C.VOL_SMOOTH, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Each day with the position of its series' setting (``best``: a row per series); rows are not multiplied."""
    wide = _wide_positions(df, settings, probability, smooth, keys)
    kept = [c for c in wide.columns if not c.startswith("_pos")]
    place = F.array_position(F.array(*[F.lit(s.grid_idx) for s in settings]), F.col("grid_idx")).cast("int") - 1
    position = F.get(F.array(*[F.col(f"_pos{i}") for i in range(len(settings))]), place)
    return wide.join(best.select(*keys, "grid_idx"), list(keys)).select(*kept, "grid_idx", position.alias("position"))


def backtest_grid(
    df: DataFrame, settings: Sequence[Setting] | None = None, probability: str = "probability",
    smooth: int = C.VOL_SMOOTH, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Score components and basic statistics of every setting for every series.

    All curves run over the un-multiplied rows. Of a series that fits a block they are rows of an array
    whose sums come out; of longer ones rows are multiplied by the grid on their way into the aggregate.
    """
    settings = settings or grid()
    if not is_blocked(df):
        return _scored_grid(_whole_sums(_rolled(df, settings, probability, smooth, keys), settings, keys), keys)
    wide = _wide_positions(df, settings, probability, smooth, keys)
    forward, rate = F.col("forward_returns"), F.col("risk_free_rate")
    span = range(len(settings))
    growth = {i: F.lit(1.0) + strategy_return(F.col(f"_pos{i}"), forward, rate) for i in span}
    wide = scan(wide, {f"_eq{i}": running_product(growth[i]) for i in span}, keys)
    wide = scan(wide, {f"_top{i}": running_max(F.col(f"_eq{i}")) for i in span}, keys)
    wide = wide.withColumns({f"_dd{i}": ratio(F.col(f"_eq{i}"), F.col(f"_top{i}")) - 1 for i in span})
    kept = [*keys, "forward_returns", "risk_free_rate"]
    rows = with_returns(_long(wide, settings, {"position": "_pos", "drawdown": "_dd"}, kept))
    by = ["grid_idx", *keys]
    sums = rows.groupBy(*by).agg(
        *v1_sums(),
        F.avg("strategy_returns").alias("_mean"),
        F.stddev_pop("strategy_returns").alias("_pop"),
        F.min("drawdown").alias("max_drawdown"),
        F.product(F.lit(1.0) + F.col("strategy_returns")).alias("_total"),
    )
    return _scored_grid(sums, keys)


def _whole_sums(rows: DataFrame, settings: Sequence[Setting], keys: Sequence[str]) -> DataFrame:
    """A row per series and setting with the sums of its curve."""
    parts = {f"_{s.mapping}" for s in settings} | {f"_std{s.window}" for s in settings}
    needed = ["forward_returns", "risk_free_rate", *sorted(parts)]
    sums = ["_prod", "_mprod", "_std", "_mstd", "_mean", "_pop", "max_drawdown", "_total"]

    def run(table: pa.Table) -> dict[str, pa.Array]:
        table = table.sort_by("_at")
        c = {name: column(table, f"_in{i}") for i, name in enumerate(needed)}
        made, step = [], max(1, GRID_CELLS // len(table))
        for some in (settings[a : a + step] for a in range(0, len(settings), step)):
            scale = [s.target / np.sqrt(YEAR) / (c[f"_std{s.window}"] + 1e-8) for s in some]
            scale = [np.clip(np.where(np.isnan(v), 1.0, v), 0.0, 3.0) for v in scale]
            position = np.clip(np.stack([c[f"_{s.mapping}"] * v for s, v in zip(some, scale)]), 0.0, 2.0)
            made.append(grid_sums(position, c["forward_returns"], c["risk_free_rate"]))
        out = {"grid_idx": pa.array([s.grid_idx for s in settings], pa.int64()), "n": pa.array(np.full(len(settings), len(table)), pa.int64())}
        return {**out, **{name: nullable(np.concatenate([m[name] for m in made])) for name in sums}}

    cells = [F.col(name).cast("double").alias(f"_in{i}") for i, name in enumerate(needed)]
    fields = ", ".join(["grid_idx long", "n long", *[f"{name} double" for name in sums]])
    return per_series(rows.select(*keys, F.col(POS).alias("_at"), *cells), keys, run, fields)


def _scored_grid(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    by = ["grid_idx", *keys]
    basic = {
        "annual_return": F.pow(F.lit(1.0) + F.col("_mean"), F.lit(YEAR)) - 1,
        "annual_volatility": F.col("_pop") * F.sqrt(F.lit(YEAR)),
        "max_drawdown": F.col("max_drawdown"),
        "total_return": F.col("_total") - 1,
    }
    return sums.select(*by, *v1_columns(), *[c.alias(n) for n, c in basic.items()])


def backtest_single(df: DataFrame, mapping: str, target: float, window: int, keys: Sequence[str] = KEYS) -> DataFrame:
    return backtest_grid(df, [Setting(0, mapping, mapping, target, window)], keys=keys)


def best_strategy(results: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """First setting with the highest score above -1 per series; none if no such."""
    order = F.struct(F.col("adjusted_sharpe"), -F.col("grid_idx"))
    good = results.filter((F.col("adjusted_sharpe") > -1) & ~F.isnan("adjusted_sharpe"))
    return good.groupBy(*keys).agg(
        F.max_by("grid_idx", order).alias("grid_idx"), F.max("adjusted_sharpe").alias("adjusted_sharpe")
    )


def hold(df: DataFrame) -> DataFrame:
    """Always invested: position 1."""
    return df.withColumn("position", F.lit(1.0))
