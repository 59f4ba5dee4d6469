"""Column choice, row filters, splits and folds."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from serieswise import config as C
from serieswise.config import BLOCK, DAY, KEYS, POS
from serieswise.functions.scalar import ratio
from serieswise.operators.blocks import renumber, scan, whole_series

# columns the library itself adds
HELPER_COLS = [C.SERIES, POS, BLOCK, "dt", "split", "fold", "role"]


def stacked(df: DataFrame, rows: Iterable[dict[str, Column]], keys: Sequence[str] = ()) -> DataFrame:
    """Turn each row of ``df`` into one row per dict."""
    table = F.array(*[F.struct(*[c.alias(n) for n, c in row.items()]) for row in rows])
    return df.select(*keys, F.explode(table).alias("_r")).select(*keys, "_r.*")


def one_row(stats: DataFrame) -> dict[str, Column]:
    """The columns of a one-row statistics table as literals.

    Runs the aggregate now. Later expressions then hold constants instead of
    copies of its plan, which would multiply where statistics build on statistics.
    """
    row = stats.first()
    types = {f.name: f.dataType for f in stats.schema.fields}
    return {name: F.lit(row[name]).cast(types[name]) for name in stats.columns}


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson over rows where both are known; null where either is constant.

    Built from covariance and deviations: the built-in aggregate divides before
    any guard around it is looked at, which is an error for constant columns.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    scale = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(varied & (scale > 0), F.covar_pop(x, y) / scale)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def feature_columns(df: DataFrame) -> list[str]:
    skip = set(C.NON_FEATURE_COLS + HELPER_COLS)
    return [c for c in numeric_columns(df) if c not in skip]


def model_columns(df: DataFrame, extra_drop: Sequence[str] = ()) -> list[str]:
    """Every column but target and leakage, by name."""
    drop = {C.RETURN_TARGET, C.EXCESS_TARGET, *extra_drop, *HELPER_COLS}
    return sorted(c for c in df.columns if c not in drop)


def missing_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select("*", *[F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in cols])


def null_rates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """feature, na_count, na_rate in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in cols],
    )
    return stacked(
        counts,
        [
            {
                "feature": F.lit(c),
                "na_count": F.col(c),
                "na_rate": ratio(F.col(c).cast("double"), F.col("_rows")),
            }
            for c in cols
        ],
    )


def high_na_columns(df: DataFrame, threshold: float = C.HIGH_NA, strict: bool = False) -> DataFrame:
    """Columns whose null rate reaches (``strict``: exceeds) the threshold."""
    rates = null_rates(df, feature_columns(df))
    rate = F.col("na_rate")
    return rates.filter(rate > threshold if strict else rate >= threshold)


def names(features: DataFrame) -> list[str]:
    """Column names from a per-column table (its size is the column count)."""
    return [r.feature for r in features.select("feature").collect()]


def drop_high_na(
    train: DataFrame, test: DataFrame, raw_to_eng: dict[str, list[str]] | None = None
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Drop raw columns that are mostly null in ``train``, and what derives from them."""
    raw = {c for group in C.RAW_COLUMNS.values() for c in group}
    rates = null_rates(train, [c for c in train.columns if c in raw])
    dropped = names(rates.filter(F.col("na_rate") >= C.HIGH_NA))
    derived = [e for c in dropped for e in (raw_to_eng or {}).get(c, [])]
    return train.drop(*dropped, *derived), test.drop(*dropped, *derived), dropped


def dummy_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """feature, is_dummy: values all within -1, 0, 1; ``*_missing`` flags never count."""
    seen = df.agg(
        *[F.max(F.when(~F.col(c).isin(-1, 0, 1), 1)).isNull().alias(c) for c in cols]
    )
    return stacked(
        seen,
        [
            {
                "feature": F.lit(c),
                "is_dummy": (F.lit(False) if c.endswith("_missing") else F.col(c)).cast("int"),
            }
            for c in cols
        ],
    )


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.filter(F.col(target).isNotNull())


def trim_leading_empty(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Drop rows before the first with any of ``cols``; a series with none vanishes."""
    first = F.min(F.when(F.coalesce(*[F.col(c).cast("double") for c in cols]).isNotNull(), F.col(POS)))
    marked = scan(df, {"_first": whole_series(first, F.min, keys)}, keys)
    return renumber(marked.filter(F.col(POS) >= F.col("_first")).drop("_first"), keys, unique=True)


def with_series_rows(df: DataFrame, keys: Sequence[str] = KEYS, name: str = "_n", in_order: bool = True) -> DataFrame:
    """Add the rows of the series; without ``in_order`` they need not come out by position, which saves a sort."""
    return scan(df, {name: whole_series(F.count(F.lit(1)), F.sum, None if in_order else keys)}, keys)


def _boundary(share: float, n: Column) -> Column:
    # one IEEE product and truncation, never decimal arithmetic
    return F.floor(F.lit(float(share)) * n)


def split_three_way(
    df: DataFrame, train: float = C.TRAIN_RATIO, val: float = C.VAL_RATIO, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Add ``split``: train, val or test by position."""
    sized, pos, n = with_series_rows(df, keys), F.col(POS), F.col("_n")
    label = (
        F.when(pos < _boundary(train, n), "train")
        .when(pos < _boundary(train + val, n), "val")
        .otherwise("test")
    )
    return sized.withColumn("split", label).drop("_n")


def split_holdout(df: DataFrame, test: float = C.TEST_RATIO, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add ``split``: train or test, the last rows being the test."""
    sized = with_series_rows(df, keys, in_order=False)
    label = F.when(F.col(POS) < _boundary(1 - test, F.col("_n")), "train").otherwise("test")
    return sized.withColumn("split", label).drop("_n")


def _rows_by_fold(df: DataFrame, folds: int, train_end, val_end, keys: Sequence[str]) -> DataFrame:
    """One copy of each row per fold it trains or validates, with ``fold`` and ``role``."""
    pos = F.col(POS)
    uses = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: pos < val_end(f))
    out = df.withColumn("fold", F.explode(uses))
    role = F.when(pos < train_end(F.col("fold")), "train").otherwise("val")
    return out.withColumn("role", role)


def folds_expanding(
    df: DataFrame, initial: int = C.INITIAL_TRAIN, folds: int = C.TUNE_FOLDS, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Expanding walk-forward folds; earlier folds take the remainder rows.

    A series too short for one validation row per fold yields no rows here;
    ``fold_errors`` names such series.
    """
    sized, n = with_series_rows(df, keys), F.col("_n")
    size, rest = F.floor((n - initial) / folds), (n - initial) % folds
    end = lambda f: F.lit(initial) + f * size + F.least(f, rest)
    usable = sized.filter(n - initial >= folds)
    return _rows_by_fold(usable, folds, end, lambda f: end(f + 1), keys).drop("_n")


def fold_errors(df: DataFrame, initial: int, folds: int, keys: Sequence[str] = KEYS) -> DataFrame:
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    reason = F.when(F.col("rows") <= initial, "too_small").when(
        F.col("rows") - initial < folds, "empty_folds"
    )
    return n.withColumn("reason", reason).filter("reason is not null")


def with_segments(
    df: DataFrame, initial: int = C.INITIAL_TRAIN, folds: int = C.TUNE_FOLDS, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Add ``fold``: the first of ``folds_expanding`` a row trains in (``folds`` for the last validation range).

    A row trains in that fold and all later ones, so sums over segments up to a fold are sums over its training
    rows, with one copy of each row.
    """
    sized, n, pos = with_series_rows(df, keys), F.col("_n"), F.col(POS)
    size, rest = F.floor((n - initial) / folds), (n - initial) % folds
    over, wide = pos - initial, rest * (size + 1)
    later = F.when(over < wide, F.floor(over / (size + 1))).otherwise(rest + F.floor((over - wide) / size))
    fold = F.when(pos < initial, F.lit(0)).otherwise(later + 1).cast("int")
    return sized.filter(n - initial >= folds).withColumn("fold", fold).drop("_n")


def folds_timeseries(df: DataFrame, folds: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Expanding folds with equal test parts of n // (folds + 1) rows at the end."""
    sized, n = with_series_rows(df, keys), F.col("_n")
    size = F.floor(n / (folds + 1))
    end = lambda f: n - (F.lit(folds) - f) * size
    return _rows_by_fold(sized, folds, end, lambda f: end(f + 1), keys).drop("_n")


def with_timeseries_segments(df: DataFrame, folds: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add ``fold``: the first of ``folds_timeseries`` a row trains in (``folds`` for the last test part), with one copy of each row.

    A row trains in that fold and all later ones, and tests the one before.
    """
    sized, n, pos = with_series_rows(df, keys), F.col("_n"), F.col(POS)
    size = F.floor(n / (folds + 1))
    start = n - F.lit(folds) * size
    fold = F.when(pos < start, F.lit(0)).otherwise(F.floor((pos - start) / size) + 1)
    return sized.withColumn("fold", fold.cast("int")).drop("_n")


def context_tail(df: DataFrame, rows: int = C.K_WINDOW, keys: Sequence[str] = KEYS) -> DataFrame:
    return with_series_rows(df, keys).filter(F.col(POS) >= F.col("_n") - rows).drop("_n")


def fit_means(train: DataFrame, cols: Sequence[str]) -> dict[str, Column]:
    return one_row(train.agg(*[F.avg(c).alias(c) for c in cols]))


def mean_impute(df: DataFrame, train: DataFrame, cols: Sequence[str]) -> DataFrame:
    means = fit_means(train, cols)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), means[c]) for c in cols})


def zscore_scale(df: DataFrame, train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Standardise by train mean and population deviation; zero deviation divides by 1."""
    fitted = one_row(
        train.agg(
            *[F.avg(c).alias(f"{c}_mean") for c in cols],
            *[F.stddev_pop(c).alias(f"{c}_std") for c in cols],
        )
    )
    step = lambda c: F.when(fitted[f"{c}_std"] > 0, fitted[f"{c}_std"]).otherwise(F.lit(1.0))
    return df.withColumns({c: (F.col(c) - fitted[f"{c}_mean"]) / step(c) for c in cols})


def align(left: DataFrame, right: DataFrame, keys: Sequence[str] = (C.SERIES, DAY)) -> DataFrame:
    """Predictions or positions set beside returns, by key."""
    return left.join(right, list(keys))


def merge_cached(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """New results, plus earlier ones for keys this run did not produce."""
    return new.unionByName(old.join(new, key, "left_anti"), allowMissingColumns=True)
