"""Kendall's tau-b by distributed inversion counts.

Equal pairs are counted before anything moves. Both value ranges are cut at approximate quantiles, and
a value so frequent that several cuts fall on it becomes a slice of its own. Two points are discordant
in one of three ways, each counted where its rows are few:

* in different slices of both values: from the grid of slice counts, by running sums;
* in one slice of x: by merging the slice's rows;
* in one slice of y but different slices of x: likewise, ordered by slice of x.

A slice of a single value holds no discordant pair and is not sent anywhere, so a heavily tied value
costs one row of the grid.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieswise.operators.blocks import longest_group
from serieswise.operators.ordered import _slice_of, small_group
from serieswise.session import settle

#: Points that one task merges, if the values are spread.
SLICE_ROWS = 100_000
#: Slices of one value at most: the grid of a key is one small matrix.
MOST_SLICES = 1024


def inversions(y: np.ndarray, weight: np.ndarray) -> int:
    """Weighted pairs (a before b) with y[a] > y[b], by merging neighbouring runs of doubling length."""
    _, rank = np.unique(y, return_inverse=True)
    at, total, run = np.arange(len(y)), 0, 1
    while run < len(y):
        block, right = at // (2 * run), (at // run) % 2
        order = np.lexsort((right, rank, block))  # on ties the left one first: only smaller values count
        moved = np.where(right[order] == 1, weight[order], 0)
        before = np.cumsum(moved)
        start = np.searchsorted(block[order], block[order])  # first row of the block
        base = np.where(start > 0, before[start - 1], 0)
        total += int((weight[order] * (before - base))[right[order] == 0].sum())
        run *= 2
    return total


def _placed(value: Column, cuts: Column) -> Column:
    """Slice of a value: even between two cuts, odd on a cut that is met at least twice."""
    distinct = F.array_distinct(cuts)
    place = _slice_of(value, distinct)
    on = (place > 0) & (F.try_element_at(distinct, F.greatest(place, F.lit(1))) == value)
    heavy = on & (F.size(F.filter(cuts, lambda c: c == value)) > 1)
    return F.when(heavy, 2 * place - 1).otherwise(2 * place).cast("int")


def kendall(pairs: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """keys, n, tau over rows where both values are known; null where either is constant."""
    known = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    points = settle(known.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("w")))
    whole = "decimal(38,0)"
    twos = lambda c: F.sum((F.col(c).cast(whole) * (F.col(c) - 1) / 2).cast(whole)).cast(whole)
    tied = lambda v, name: points.groupBy(*keys, v).agg(F.sum("w").alias("w")).groupBy(*keys).agg(twos("w").alias(name))
    total = points.groupBy(*keys).agg(F.sum("w").alias("n"), twos("w").alias("_both"))

    cut = min(MOST_SLICES, max(1, -(-longest_group(points, keys) // slice_rows)))
    if cut > 1:
        probs = [i / cut for i in range(1, cut)]
        cuts = points.groupBy(*keys).agg(*[F.percentile_approx(v, probs, 20 * cut).alias(f"_{v}") for v in ("x", "y")])
        placed = points.join(cuts, list(keys)) if keys else points.crossJoin(F.broadcast(cuts))  # one row
        placed = settle(placed.select(*keys, "x", "y", "w", _placed(F.col("x"), F.col("_x")).alias("i"), _placed(F.col("y"), F.col("_y")).alias("j")))
    else:
        placed = points.withColumns({"i": F.lit(0), "j": F.lit(0)})

    types = {f.name: f.dataType.simpleString() for f in pairs.select(*keys).schema.fields}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "_d long"])
    row = lambda pdf, d: pd.DataFrame({**{k: pdf[k].iloc[:1] for k in keys}, "_d": pd.Series([d], index=pdf.index[:1])})

    def grid(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros((int(pdf["i"].max()) + 2, int(pdf["j"].max()) + 2), np.int64)
        np.add.at(cells, (pdf["i"].to_numpy(), pdf["j"].to_numpy() + 1), pdf["w"].to_numpy(np.int64))
        later = cells[::-1].cumsum(0)[::-1]  # in this slice of x or later ones
        below = later.cumsum(1)
        return row(pdf, int((cells[:-1, 1:] * below[1:, :-1]).sum()))

    def inside(first: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([first, "y"], kind="stable")
            return row(pdf, inversions(pdf["y"].to_numpy(), pdf["w"].to_numpy(np.int64)))

        return run

    none = [F.lit(0).alias("_all")]
    open_ = lambda c: F.col(c) % 2 == 0
    counts = placed.groupBy(*keys, "i", "j").agg(F.sum("w").alias("w"))
    parts = placed.filter(open_("i")).groupBy(*keys, "i").applyInPandas(inside("x"), schema)
    if cut > 1:
        parts = parts.unionByName(counts.groupBy(*(keys or none)).applyInPandas(grid, schema))
        parts = parts.unionByName(placed.filter(open_("j")).groupBy(*keys, "j").applyInPandas(inside("i"), schema))
    found = parts.groupBy(*keys).agg(F.sum(F.col("_d").cast(whole)).cast(whole).alias("_d"))

    tables = [tied("x", "_tx"), tied("y", "_ty"), found]
    for table in tables:
        total = total.join(table, list(keys), "left") if keys else total.crossJoin(table)  # one row each
    n, tx, ty = F.col("n").cast(whole), F.col("_tx"), F.col("_ty")
    most = (n * (n - 1) / 2).cast(whole)
    above = (most - tx - ty + F.col("_both") - 2 * F.coalesce("_d", F.lit(0).cast(whole))).cast("double")
    scale = F.sqrt((most - tx).cast("double")) * F.sqrt((most - ty).cast("double"))
    return total.select(*keys, "n", F.when(scale > 0, above / scale).alias("tau"))
