"""Correlations with pairwise null handling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from serieswise.config import KEYS
from serieswise.operators.blocks import block_rows, is_blocked, longest_group
from serieswise.operators.concordance import kendall
from serieswise.operators.frames import drop_null_target, safe_corr, stacked, with_segments
from serieswise.operators.ordered import small_group, spearman, spearman_columns, value_ranks
from serieswise.session import settle

METHODS = ("pearson", "spearman", "kendall")
MOMENTS = ["n", "m1", "m2", "q1", "q2", "p"]


def _signed(table: DataFrame) -> DataFrame:
    """Drop undefined correlations, add the absolute value."""
    known = table.filter(F.col("corr").isNotNull() & ~F.isnan("corr"))
    return known.withColumn("abs_corr", F.abs("corr"))


def _checked(method: str) -> str:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; available: {METHODS}")
    return method


def _rank_corr(pairs: DataFrame, keys: Sequence[str], method: str, largest: int | None = None) -> DataFrame:
    """keys, corr of x and y; ``largest`` is an upper bound of pairs per key if the caller has one."""
    table, name = (spearman(pairs, keys, largest=largest), "ic") if method == "spearman" else (kendall(pairs, keys), "tau")
    return table.select(*keys, F.col(name).alias("corr"))


def corr_target(df: DataFrame, cols: Sequence[str], target: str, method: str = "pearson") -> DataFrame:
    """feature, corr, abs_corr over rows where both values are known, by one of METHODS."""
    if target not in df.columns:
        raise ValueError(f"no target column {target!r}")
    if _checked(method) != "pearson":
        rows = settle(drop_null_target(df, target).select(target, *[c for c in cols if c != target]))  # read several times
        return _signed(_rank_corr(long_pairs(rows, cols, target), ["feature"], method, rows.count()))
    wide = df.agg(*[safe_corr(F.col(c), F.col(target)).alias(c) for c in cols])
    return _signed(stacked(wide, [{"feature": F.lit(c), "corr": F.col(c)} for c in cols]))


def long_pairs(df: DataFrame, cols: Sequence[str], target: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, feature, x, y for every known feature value on a row with a target."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])
    return (
        df.filter(F.col(target).isNotNull())
        .select(*keys, F.col(target).alias("y"), F.explode(cells).alias("_c"))
        .select(*keys, "_c.feature", "_c.x", "y")
        .filter(F.col("x").isNotNull())
    )


def _moments(values: np.ndarray) -> np.ndarray:
    """n, means, squared deviations and co-moment of every pair, over rows where both are known.

    Columns are shifted by their mean first; a constant column by its value, so that its
    deviations are exactly 0.
    """
    known = ~np.isnan(values)
    count = known.sum(0)
    low = np.where(known, values, np.inf).min(0)
    high = np.where(known, values, -np.inf).max(0)
    mean = np.where(known, values, 0.0).sum(0) / np.maximum(count, 1)
    shift = np.where(count == 0, 0.0, np.where(low == high, low, mean))
    m, x = known.astype(float), np.where(known, values - shift, 0.0)
    n, s = m.T @ m, x.T @ m
    q, size = (x * x).T @ m, np.maximum(n, 1.0)
    squares = np.maximum(q - s * s / size, 0.0)
    first = shift[:, None] + s / size
    return np.stack([n, first, first.T, squares, squares.T, x.T @ x - s * s.T / size])


def merged_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of two sets of rows taken together."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    d1, d2, both = b[1] - a[1], b[2] - a[2], a[0] * share
    first = np.where(a[0] > 0, a[1] + d1 * share, b[1])
    second = np.where(a[0] > 0, a[2] + d2 * share, b[2])
    return np.stack([n, first, second, a[3] + b[3] + d1 * d1 * both, a[4] + b[4] + d2 * d2 * both, a[5] + b[5] + d1 * d2 * both])


def pair_moments(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, i, j, n, m1, m2, q1, q2, p for every pair ``i <= j``: rows, means, squared deviations, co-moment.

    Only rows where both columns are known count; a null key is a key. Each task merges its
    batches and emits one row per key and pair, so a shuffle moves pairs per task, not
    rows. Nothing is summed about a centre that other keys share: levels may differ by any
    factor.
    """
    key_list, width = list(keys), len(cols)
    upper_i, upper_j = np.triu_indices(width)

    def emit(key: tuple, moments: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame({"i": upper_i, "j": upper_j})
        for name, matrix in zip(MOMENTS, moments):
            out[name] = matrix[upper_i, upper_j]
        for name, value in zip(key_list, key):
            out[name] = None if pd.isna(value) else value
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            groups = batch.groupby(key_list, sort=False, dropna=False) if key_list else [((), batch)]
            for key, rows in groups:
                key = tuple(None if pd.isna(k) else k for k in key)
                moments = _moments(rows[list(cols)].to_numpy(float))
                held[key] = merged_moments(held[key], moments) if key in held else moments
                if len(held) > 256:
                    for done in list(held):
                        yield emit(done, held.pop(done))
        for key, moments in held.items():
            yield emit(key, moments)

    types = {f.name: f.dataType.simpleString() for f in df.select(*keys).schema.fields}
    fields = [*[f"{k} {types[k]}" for k in keys], "i int", "j int", *[f"{s} double" for s in MOMENTS]]
    values = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    partial = values.mapInPandas(run, ", ".join(fields)).filter("n > 0")
    return merge_moments(partial, [*keys, "i", "j"])


def merge_moments(partial: DataFrame, by: Sequence[str]) -> DataFrame:
    """Moments of all parts with the same ``by`` taken together.

    The mean of the parts first, then deviations about it: one shuffle, and nothing cancels.
    """
    of = Window.partitionBy(*by)
    mean = lambda m: F.sum(F.col("n") * F.col(m)).over(of) / F.sum("n").over(of)
    # a mean that all parts share exactly is that mean
    same = lambda m: F.when(F.min(m).over(of) == F.max(m).over(of), F.min(m).over(of)).otherwise(mean(m))
    centred = partial.withColumns({"c1": same("m1"), "c2": same("m2")})
    d1, d2 = F.col("m1") - F.col("c1"), F.col("m2") - F.col("c2")
    return centred.groupBy(*by).agg(
        F.sum("n").alias("n"), F.first("c1").alias("m1"), F.first("c2").alias("m2"),
        F.sum(F.col("q1") + F.col("n") * d1 * d1).alias("q1"), F.sum(F.col("q2") + F.col("n") * d2 * d2).alias("q2"),
        F.sum(F.col("p") + F.col("n") * d1 * d2).alias("p"),
    )


def fold_moments(
    df: DataFrame, cols: Sequence[str], initial: int, folds: int, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Pair moments of the training rows of every expanding fold, from moments per segment."""
    parts = pair_moments(with_segments(df, initial, folds, keys).filter(F.col("fold") < folds), cols, [*keys, "fold"])
    later = parts.withColumn("fold", F.explode(F.sequence(F.col("fold"), F.lit(folds - 1))))
    return merge_moments(later, [*keys, "fold", "i", "j"])


def corr_from_moments(table: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    # deviations within rounding of the level are none
    varied = lambda q, m: F.col(q) > F.col("n") * F.pow(F.lit(1e-14) * F.abs(F.col(m)), F.lit(2.0))
    name = lambda i: F.array(*[F.lit(c) for c in cols])[F.col(i)]
    corr = F.when((F.col("n") > 1) & varied("q1", "m1") & varied("q2", "m2"), F.col("p") / (F.sqrt("q1") * F.sqrt("q2")))
    return table.filter(F.col("i") < F.col("j")).select(
        *keys, name("i").alias("feature_1"), name("j").alias("feature_2"), corr.alias("corr")
    )


def pair_correlations(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), method: str = "pearson") -> DataFrame:
    """keys, feature_1, feature_2, corr, abs_corr of all unordered pairs.

    Rank methods rank the rows where both columns of a pair are known, so they make a row per row and pair.
    """
    if _checked(method) == "pearson":
        return _signed(corr_from_moments(pair_moments(df, cols, keys), cols, keys))
    double = lambda c: F.col(c).cast("double")
    cells = [
        F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), double(a).alias("x"), double(b).alias("y"))
        for i, a in enumerate(cols) for b in cols[i + 1 :]
    ]
    rows = df.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(*keys, "_c.*")
    return _signed(_rank_corr(rows, [*keys, "feature_1", "feature_2"], method))


def top_pairs(df: DataFrame, cols: Sequence[str], n: int, method: str = "pearson") -> DataFrame:
    pairs = pair_correlations(df, cols, method=method)
    return pairs.orderBy(F.desc("abs_corr"), "feature_1", "feature_2").limit(n)


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Square matrix as one row per column of ``cols``."""
    half = pair_correlations(df, cols).select("feature_1", "feature_2", "corr")
    other = half.select(F.col("feature_2").alias("feature_1"), F.col("feature_1").alias("feature_2"), "corr")
    pivoted = half.unionByName(other).groupBy("feature_1").pivot("feature_2", list(cols)).agg(F.first("corr"))
    return pivoted.select(
        F.col("feature_1").alias("feature"),
        *[F.when(F.col("feature_1") == c, 1.0).otherwise(F.col(c)).alias(c) for c in cols],
    )


def spearman_ic(
    df: DataFrame, cols: Sequence[str], target: str, keys: Sequence[str] = (), written: bool = False
) -> DataFrame:
    """Rank correlation with the target and its t statistic per column.

    The rows are read several times: they are written once before, unless ``written`` says that they are.
    """
    rows = df if written else settle(drop_null_target(df, target).select(*dict.fromkeys([*keys, target, *cols])))
    largest = longest_group(rows, keys) if keys else rows.count()
    if not keys and largest > small_group(rows):
        return _with_t(spearman_columns(rows, cols, target, largest))
    return _with_t(spearman(long_pairs(rows, cols, target, keys), [*keys, "feature"], largest=largest))


def _with_t(table: DataFrame) -> DataFrame:
    """Add the t statistic of a rank correlation."""
    ic, n = F.col("ic"), F.col("n")
    rest = F.sqrt(F.greatest(F.lit(1.0) - ic * ic, F.lit(1e-12)))
    return table.withColumn("t_stat", ic * F.sqrt(F.greatest(n - 2, F.lit(1)).cast("double")) / rest)


def fold_ics(
    df: DataFrame, cols: Sequence[str], target: str, initial: int, folds: int, keys: Sequence[str] = KEYS
) -> DataFrame:
    """keys, fold, feature, n, ic, t_stat over the training rows of every expanding fold.

    A row is ranked once per value, with a running count for each fold: how many training rows of the fold
    lie below it. Rows are not copied for the folds they train in, and each value is sorted once.
    """
    of, fold = [*keys, "feature"], F.col("fold")
    train = drop_null_target(with_segments(df, initial, folds, keys), target).filter(fold < folds)
    rows = long_pairs(train, cols, target, [*keys, "fold"])
    largest = block_rows(df) if not is_blocked(df) else longest_group(rows, of)
    inside = [(fold <= f).cast("long") for f in range(folds)]
    if largest <= small_group(df):
        upto = lambda v: Window.partitionBy(*of).orderBy(v).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        ties = lambda v: Window.partitionBy(*of, v)
        ranks = {
            f"_{v}{f}": F.sum(c).over(upto(v)) - (F.sum(c).over(ties(v)) - 1) / F.lit(2.0) for v in ("x", "y") for f, c in enumerate(inside)
        }
        ranked = rows.select(*of, "fold", *[c.alias(n) for n, c in ranks.items()])
    else:
        ranked = settle(rows)
        for v in ("x", "y"):
            counts = value_ranks(ranked, of, v, {f"c{f}": c for f, c in enumerate(inside)}, largest)
            places = [(F.col(f"c{f}_less") + (F.col(f"c{f}") + 1) / 2).alias(f"_{v}{f}") for f in range(folds)]
            ranked = ranked.join(counts.select(*of, v, *places), [*of, v])
    own = lambda v, f: F.when(fold <= f, F.col(f"_{v}{f}"))
    wide = ranked.groupBy(*of).agg(
        *[F.count_if(fold <= f).alias(f"_n{f}") for f in range(folds)],
        *[safe_corr(own("x", f), own("y", f)).alias(f"_ic{f}") for f in range(folds)],
    )
    table = stacked(wide, [{"fold": F.lit(f), "n": F.col(f"_n{f}"), "ic": F.col(f"_ic{f}")} for f in range(folds)], of)
    return _with_t(table.filter("n > 0")).select(*keys, "fold", "feature", "n", "ic", "t_stat")


def cluster_target_corr(means: DataFrame, groups: Sequence[str], target: str) -> DataFrame:
    table = corr_target(means, [f"mean_{g}" for g in groups], target)
    return table.select(F.substring("feature", 6, 10).alias("cluster"), "corr", "abs_corr")
