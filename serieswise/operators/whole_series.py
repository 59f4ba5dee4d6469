"""Statistics of series that fit one task, from the rows of each series as arrays.

Spark deals the rows by series; a task sees one series at a time, of a block's rows at most, and
returns a few rows for it. Panels with longer series (``is_blocked``) go by the windows and joins
of the modules that use these functions; both ways give equal results. A null is unknown and
counts nowhere; NaN in an array stands for it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from serieswise.operators.correlation import MOMENTS, _moments, merged_moments

# cells of rolling frames held at a time
FRAME_CELLS = 2_000_000


def per_series(df: DataFrame, keys: Sequence[str], run: Callable[[pa.Table], dict[str, pa.Array]], fields: str) -> DataFrame:
    """keys and ``fields``: what ``run`` makes of the rows of each series, a column each."""
    types = {f.name: f.dataType.simpleString() for f in df.select(*keys).schema.fields}

    def rows(table: pa.Table) -> pa.Table:
        made = run(table)
        n = len(next(iter(made.values())))
        own = table.select(list(keys)).take(pa.array(np.zeros(n, np.int64)))
        return pa.Table.from_arrays([*own.columns, *made.values()], names=[*keys, *made])

    return df.groupBy(*keys).applyInArrow(rows, ", ".join([*[f"`{k}` {types[k]}" for k in keys], fields]))


def column(table: pa.Table, name: str) -> np.ndarray:
    """Doubles with NaN for null."""
    return table.column(name).cast(pa.float64()).to_numpy()


def known(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).is_valid().to_numpy()


def ranks_inside(values: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Average rank of every value among those of each row of ``inside`` (..., rows); sorted once."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    same = (v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1]))
    new = np.concatenate([[True], ~same])
    starts = np.flatnonzero(new)
    counts = np.concatenate([np.zeros((*inside.shape[:-1], 1), np.int64), np.cumsum(inside[..., order], axis=-1)], axis=-1)
    less, upto = counts[..., starts], counts[..., np.append(starts[1:], len(v))]
    out = np.empty(inside.shape)
    out[..., order] = (less + (upto - less + 1) / 2)[..., np.cumsum(new) - 1]
    return out


def expanding_ics(
    x: list[np.ndarray], x_known: list[np.ndarray], y: np.ndarray, fold: np.ndarray, folds: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, rank correlation with y and its t statistic, by fold and column, over the rows up to each fold.

    NaN where a side is constant.
    """
    upto = fold[None, :] <= np.arange(folds)[:, None]
    inside = np.stack([upto & k for k in x_known], axis=1)
    n = inside.sum(-1)
    middle = (n + 1)[..., None] / 2
    about = lambda ranks: np.where(inside, ranks - middle, 0.0)
    rx = about(np.stack([ranks_inside(v, inside[:, i]) for i, v in enumerate(x)], axis=1))
    ry = about(ranks_inside(y, inside))
    squares = np.sqrt((rx * rx).sum(-1)) * np.sqrt((ry * ry).sum(-1))
    ic = np.divide((rx * ry).sum(-1), squares, out=np.full(n.shape, np.nan), where=squares > 0)
    return n, ic, ic * np.sqrt(np.maximum(n - 2, 1)) / np.sqrt(np.maximum(1 - ic * ic, 1e-12))


def expanding_moments(values: np.ndarray, fold: np.ndarray, folds: int) -> list[np.ndarray]:
    """Pair moments (as ``pair_moments``) of the rows up to each fold."""
    width, totals = values.shape[1], []
    total = np.zeros((len(MOMENTS), width, width))
    for f in range(folds):
        part = values[fold == f]
        if len(part):
            here = _moments(part)
            total = merged_moments(total, np.where(here[0] > 0, here, 0.0))
        totals.append(total)
    return totals


def correlations(moments: np.ndarray) -> np.ndarray:
    """As ``corr_from_moments``: NaN where undefined."""
    n, m1, m2, q1, q2, p = moments
    varied = lambda q, m: q > n * (1e-14 * np.abs(m)) ** 2
    defined = (n > 1) & varied(q1, m1) & varied(q2, m2)
    return np.divide(p, np.sqrt(q1) * np.sqrt(q2), out=np.full(n.shape, np.nan), where=defined)


def deviation(values: np.ndarray, window: int, least: int = 2, back: int = 0) -> np.ndarray:
    """Sample deviation of the last ``window`` values of each row of the last axis, ending ``back`` before it.

    Unknown values are skipped; NaN below ``least`` known ones.
    """
    n = values.shape[-1]
    lead = np.full((*values.shape[:-1], window - 1 + back), np.nan)
    padded = np.concatenate([lead, values], axis=-1)[..., : n + window - 1]
    frames = np.lib.stride_tricks.sliding_window_view(padded, window, axis=-1)
    out = np.full(values.shape, np.nan)
    step = max(1, FRAME_CELLS // (window * max(1, int(np.prod(values.shape[:-1])))))
    for a in range(0, n, step):
        frame = frames[..., a : a + step, :]
        there = ~np.isnan(frame)
        count = there.sum(-1)
        mean = np.where(there, frame, 0.0).sum(-1) / np.maximum(count, 1)
        off = np.where(there, frame - mean[..., None], 0.0)
        spread = np.sqrt((off * off).sum(-1) / np.maximum(count - 1, 1))
        out[..., a : a + step] = np.where((count >= least) & (count > 1), spread, np.nan)
    return out


def filled(values: np.ndarray, lead_in: bool = False) -> np.ndarray:
    """Last known value along the last axis; with ``lead_in`` the first known one before it."""
    there, at = ~np.isnan(values), np.arange(values.shape[-1])
    last = np.maximum.accumulate(np.where(there, at, -1), axis=-1)
    if lead_in:
        last = np.where(last < 0, np.argmax(there, axis=-1)[..., None], last)
    return np.where(last < 0, np.nan, np.take_along_axis(values, np.maximum(last, 0), -1))


def whole_std(values: np.ndarray) -> np.ndarray:
    """Sample deviation over the last axis, unknown values skipped, NaN for fewer than two."""
    there = ~np.isnan(values)
    count = there.sum(-1)
    mean = np.where(there, values, 0.0).sum(-1) / np.maximum(count, 1)
    off = np.where(there, values - mean[..., None], 0.0)
    return np.where(count > 1, np.sqrt((off * off).sum(-1) / np.maximum(count - 1, 1)), np.nan)


def nullable(values: np.ndarray) -> pa.Array:
    """Doubles with null for NaN."""
    flat = np.ravel(values)
    return pa.array(flat, pa.float64(), mask=np.isnan(flat))


def bounded_positions(prediction: np.ndarray, slope: np.ndarray, window: int) -> np.ndarray:
    """``map_positions`` of the rows of ``prediction`` (one a slope), all of them known.

    Where the rolling deviation has too few rows, the expanding one is that of the same rows.
    """
    spread = deviation(prediction, window)
    spread = filled(np.where(spread >= 1e-12, spread, np.nan), lead_in=True)
    return np.clip(1.0 + slope[:, None] * prediction / np.where(np.isnan(spread), 1.0, spread), 0.0, 2.0)


def strategy_returns(position: np.ndarray, forward: np.ndarray, rate: np.ndarray) -> np.ndarray:
    return rate * (1.0 - position) + position * forward


def _of_known(reduce: Callable[..., np.ndarray], values: np.ndarray, there: np.ndarray, zero: float) -> np.ndarray:
    """A reduction of the last axis over the cells that are there, NaN for none."""
    return np.where(there.any(-1), reduce(np.where(there, values, zero), axis=-1), np.nan)


def product(values: np.ndarray) -> np.ndarray:
    return _of_known(np.prod, values, ~np.isnan(values), 1.0)


def least_known(values: np.ndarray) -> np.ndarray:
    return _of_known(np.min, values, ~np.isnan(values), np.inf)


def mean_known(values: np.ndarray) -> np.ndarray:
    there = ~np.isnan(values)
    return _of_known(np.sum, values, there, 0.0) / np.maximum(there.sum(-1), 1)


def log_sum(values: np.ndarray) -> np.ndarray:
    """Sum of log1p where it is defined."""
    there = values > -1
    return _of_known(np.sum, np.log1p(np.where(there, values, 0.0)), there, 0.0)


def score_sums(position: np.ndarray, forward: np.ndarray, rate: np.ndarray) -> dict[str, np.ndarray]:
    """The sums of ``score_v2`` for each row of ``position``, all of them known."""
    returns, wide = strategy_returns(position, forward, rate), lambda v: np.full(len(position), v)
    excess, market = returns - rate, forward - rate
    return {
        "_high": position.max(-1), "_low": position.min(-1), "_std": whole_std(returns), "_mstd": wide(whole_std(forward)),
        "_log": log_sum(excess), "_mlog": wide(log_sum(market)), "_worst": least_known(excess), "_mworst": wide(least_known(market)),
    }


def grid_sums(position: np.ndarray, forward: np.ndarray, rate: np.ndarray) -> dict[str, np.ndarray]:
    """The sums of ``score_v1`` and the basic statistics for each row of ``position``."""
    returns, wide = strategy_returns(position, forward, rate), lambda v: np.full(len(position), v)
    there = ~np.isnan(returns)
    equity = np.cumprod(np.where(there, 1.0 + returns, 1.0), axis=-1)
    equity[~np.logical_or.accumulate(there, axis=-1)] = np.nan
    top = np.fmax.accumulate(equity, axis=-1)
    fall = np.divide(equity, top, out=np.full(equity.shape, np.nan), where=top != 0) - 1
    return {
        "_prod": product(1.0 + (returns - rate)), "_mprod": wide(product(1.0 + (forward - rate))),
        "_std": whole_std(returns), "_mstd": wide(whole_std(forward)), "_mean": mean_known(returns),
        "_pop": np.sqrt(mean_known((returns - mean_known(returns)[:, None]) ** 2)),
        "max_drawdown": least_known(fall), "_total": product(1.0 + returns),
    }


def _frames(values: np.ndarray, window: int) -> np.ndarray:
    """The last ``window`` values at each row, zeros (or False) ahead of the first."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(window - 1, values.dtype), values]), window)


def _pieces(rows: int, window: int) -> list[slice]:
    step = max(1, FRAME_CELLS // window)
    return [slice(a, a + step) for a in range(0, rows, step)]


def _frame_means(values: np.ndarray, there: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and mean of the known values among the last ``window`` rows."""
    count = _frames(there, window).sum(-1)
    return count, _frames(np.where(there, values, 0.0), window).sum(-1) / np.maximum(count, 1)


def _ratio(x: np.ndarray, d: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quotient, unknown where the divisor is zero."""
    there = there & (d != 0)
    with np.errstate(invalid="ignore", over="ignore"):
        return np.divide(x, d, out=np.full(len(x), np.nan), where=there), there


def rolling_mean(values: np.ndarray, there: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    count, mean = _frame_means(values, there, window)
    return mean, count > 0


def dev_ratio(values: np.ndarray, there: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    mean, _ = rolling_mean(values, there, window)
    return _ratio(values - mean, mean, there)


def momentum(values: np.ndarray, there: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    before = np.concatenate([np.zeros(min(lag, len(values))), values[:-lag]])
    both = there & np.concatenate([np.zeros(min(lag, len(values)), bool), there[:-lag]])
    quotient, both = _ratio(values, before, both)
    return quotient - 1, both


def zscore(values: np.ndarray, there: np.ndarray, window: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """By the population deviation, which is exactly 0 where the known values of a frame are equal."""
    count, mean = _frame_means(values, there, window)
    spread, cells, inside = np.zeros(len(values)), _frames(values, window), _frames(there, window)
    with np.errstate(invalid="ignore", over="ignore"):
        for at in _pieces(len(values), window):
            off = np.where(inside[at], cells[at] - mean[at, None], 0.0)
            same = np.where(inside[at], cells[at], np.inf).min(-1) == np.where(inside[at], cells[at], -np.inf).max(-1)
            spread[at] = np.where(same, 0.0, np.sqrt((off * off).sum(-1) / np.maximum(count[at], 1)))
        return _ratio(values - mean, spread, there & (count >= least))


def rank_pct(values: np.ndarray, there: np.ndarray, window: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of the frame's rows not above the current value; unknown values rank last, NaN above all others."""
    size = np.minimum(np.arange(1, len(values) + 1), window)
    cells, inside, at_most = _frames(values, window), _frames(there, window), np.zeros(len(values), np.int64)
    for at in _pieces(len(values), window):
        x = values[at, None]
        at_most[at] = (inside[at] & ((cells[at] <= x) | np.isnan(x))).sum(-1)
    return np.where(there, at_most, size) / size, inside.sum(-1) >= least
