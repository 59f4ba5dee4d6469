"""Feature selection: filters on column tables, greedy steps on small tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serieswise import config as C
from serieswise.functions.scalar import raw_source
from serieswise.config import BLOCK, POS
from serieswise.operators.correlation import corr_from_moments, fold_ics, fold_moments, pair_correlations, spearman_ic, top_pairs
from serieswise.operators.frames import (
    drop_null_target,
    dummy_columns,
    feature_columns,
    high_na_columns,
    names,
    one_row,
    stacked,
    with_segments,
)
from serieswise.operators.blocks import is_blocked
from serieswise.operators.profile import variance_profile
from serieswise.operators.whole_series import column, correlations, expanding_ics, expanding_moments, known, nullable, per_series
from serieswise.session import settle


def select_variance(train: DataFrame, cols: Sequence[str], quantile: float = C.VAR_QUANTILE) -> DataFrame:
    """feature, variance, threshold, kept: variance above the quantile of all variances."""
    table = variance_profile(train, cols)
    threshold = one_row(table.agg(F.percentile("variance", F.lit(quantile)).alias("t")))["t"]
    return table.select("feature", "variance", threshold.alias("threshold")).withColumn(
        "kept", F.coalesce((~(F.col("variance") <= F.col("threshold"))).cast("int"), F.lit(1))
    )


def greedy_pairs(pairs: Sequence[tuple[str, str]], cols: Sequence[str], variance: dict[str, float]) -> list[str]:
    """Walk the pairs in order; of two survivors drop the lower variance, on a tie the second."""
    left = list(cols)
    for a, b in pairs:
        if a in left and b in left and variance.get(a) is not None and variance.get(b) is not None:
            left.remove(b if variance[a] >= variance[b] else a)
    return left


def select_corr_greedy(train: DataFrame, cols: Sequence[str], n_pairs: int = C.TOP_PAIRS) -> list[str]:
    """Survivors of the walk over the top pairs; at most ``n_pairs`` rows reach the driver."""
    pairs = [(r.feature_1, r.feature_2) for r in top_pairs(train, cols, n_pairs).collect()]
    variance = {r.feature: r.variance for r in variance_profile(train, cols).collect()}
    return greedy_pairs(pairs, cols, variance)


def cum_gain(importance: DataFrame, keep: float = C.GAIN_KEEP) -> DataFrame:
    """feature, gain, cum_gain, kept: leading gains within the share, at least the first.

    The table has one row per column, so the running sum is not a data window.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("gain"), "feature")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("gain").over(Window.partitionBy(F.lit(0)))
    table = importance.select(
        "feature", "gain", F.sum("gain").over(running).alias("cum_gain"), total.alias("_total"),
        F.row_number().over(order).alias("_place"),
    )
    inside = F.col("cum_gain") <= F.lit(keep) * F.col("_total")
    some = F.max(inside.cast("int")).over(Window.partitionBy(F.lit(0))) == 1
    kept = F.when(some, inside).otherwise(F.col("_place") == 1)
    return table.select("feature", "gain", "cum_gain", kept.cast("int").alias("kept"))


def select_importance(
    train: DataFrame, val: DataFrame, cols: Sequence[str], target: str = C.RETURN_TARGET,
    keep: float = C.GAIN_KEEP, rounds: int = 300,
) -> DataFrame:
    """Gains of a boosted model with a validation stop, then the cumulative-gain cut."""
    from serieswise.plans.models import fit_boosted_gain

    gains = fit_boosted_gain(train, val, cols, target, rounds)
    table = train.sparkSession.createDataFrame(list(gains.items()), "feature string, gain double")
    return cum_gain(table, keep)


def selection_funnel(panel: DataFrame, target: str = C.RETURN_TARGET, rounds: int = 300) -> tuple[list[str], DataFrame]:
    """All stages over a panel with a ``split`` column: names and counts per stage."""
    train = panel.filter("split = 'train'")
    val = panel.filter("split = 'val'")
    stages: list[tuple[str, list[str]]] = [("initial", feature_columns(panel))]
    dummy = set(names(dummy_columns(train, stages[-1][1]).filter("is_dummy = 1")))
    stages.append(("after_dummy", [c for c in stages[-1][1] if c not in dummy]))
    empty = set(names(high_na_columns(train, strict=True)))
    stages.append(("after_missing", [c for c in stages[-1][1] if c not in empty]))
    low = set(names(select_variance(train, stages[-1][1]).filter("kept = 0")))
    stages.append(("after_variance", [c for c in stages[-1][1] if c not in low]))
    stages.append(("after_correlation", select_corr_greedy(train, stages[-1][1])))
    gained = select_importance(train, val, stages[-1][1], target, rounds=rounds).filter("kept = 1")
    stages.append(("after_gain", names(gained)))
    rows = [(i, stage, len(cols)) for i, (stage, cols) in enumerate(stages)]
    table = panel.sparkSession.createDataFrame(rows, "stage_no int, stage string, n_features long")
    return stages[-1][1], table


def ic_table(df: DataFrame, cols: Sequence[str], target: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, feature, n, ic, t_stat, variance for columns with a defined IC on 10 rows or more."""
    return _ic_table(_known(df, cols, target, keys), cols, target, keys)


def _known(df: DataFrame, cols: Sequence[str], target: str, keys: Sequence[str]) -> DataFrame:
    """Rows with a target, written once for the statistics that read them."""
    return settle(drop_null_target(df, target).select(*dict.fromkeys([*keys, target, *cols])))


def _ic_table(known: DataFrame, cols: Sequence[str], target: str, keys: Sequence[str]) -> DataFrame:
    ics = spearman_ic(known, cols, target, keys, written=True).filter("n >= 10 and ic is not null")
    wide = known.groupBy(*keys).agg(*[F.var_pop(c).alias(c) for c in cols])
    variances = stacked(wide, [{"feature": F.lit(c), "variance": F.col(c)} for c in cols], keys)
    return ics.join(variances, [*keys, "feature"])


def greedy_keep(
    features: Sequence[str], groups: dict[str, str], variance: dict[str, float],
    corr: dict[tuple[str, str], float], limit: float = C.CORR_MAX, quantile: float = C.VAR_QUANTILE,
) -> tuple[list[str], list[str]]:
    """Kept and selected names. A pair without a defined correlation counts as too close."""
    kept: list[str] = []
    by_group: dict[str, list[str]] = {}
    for f in features:
        by_group.setdefault(groups[f], []).append(f)
    for members in by_group.values():
        inside: list[str] = []
        for f in sorted(members, key=lambda m: -variance[m]):
            pairs = (corr.get((f, k), corr.get((k, f))) for k in inside)
            if all(c is not None and abs(c) < limit for c in pairs):
                inside.append(f)
        kept.extend(inside)
    if not kept:
        return [], []
    threshold = np.quantile([variance[f] for f in kept], quantile)
    return kept, [f for f in kept if variance[f] > threshold]


def select_ic(
    df: DataFrame, cols: Sequence[str], target: str = C.EXCESS_TARGET, group: Column | None = None,
    keys: Sequence[str] = (), t_min: float = C.IC_T_MIN,
) -> DataFrame:
    """keys, feature, ic, t_stat, variance, kept, selected for columns that pass the t limit.

    Rank correlations and pair correlations come from Spark; the greedy walk sees
    one small table of columns and pairs per key.
    """
    known = _known(df, cols, target, keys)
    pairs = pair_correlations(known, cols, keys)
    return _selected(_ic_table(known, cols, target, keys), pairs, cols, group, keys, t_min)


def _selected(
    table: DataFrame, pairs: DataFrame, cols: Sequence[str], group: Column | None, keys: Sequence[str], t_min: float = C.IC_T_MIN
) -> DataFrame:
    """The greedy walk per key over a table like ``ic_table`` and its pair correlations."""
    group = raw_source(F.col("feature")) if group is None else group
    passed = table.filter(F.abs("t_stat") >= t_min).withColumn("group", group)
    links = pairs.groupBy(*keys, F.col("feature_1").alias("feature")).agg(
        F.map_from_entries(F.collect_list(F.struct("feature_2", "corr"))).alias("corrs")
    )
    order = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("feature"))
    walked = passed.join(links, [*keys, "feature"], "left").select(
        *keys, "feature", "ic", "t_stat", "variance", "group", "corrs", order.alias("ord")
    )

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        corr = {(f, o): c for f, m in zip(pdf["feature"], pdf["corrs"]) if m is not None for o, c in dict(m).items()}
        names_ = list(pdf["feature"])
        kept, chosen = greedy_keep(
            names_, dict(zip(names_, pdf["group"])), dict(zip(names_, pdf["variance"])), corr
        )
        pdf = pdf.assign(kept=pdf["feature"].isin(kept).astype(int), selected=pdf["feature"].isin(chosen).astype(int))
        return pdf[[*keys, "feature", "ic", "t_stat", "variance", "kept", "selected"]]

    types = {f.name: f.dataType.simpleString() for f in table.select(*keys).schema.fields}
    schema = ", ".join(
        [f"{k} {types[k]}" for k in keys]
        + ["feature string", "ic double", "t_stat double", "variance double", "kept int", "selected int"]
    )
    by = list(keys) or [F.lit(0).alias("_all")]
    return walked.groupBy(*by).applyInPandas(walk, schema)


def select_ic_raw(df: DataFrame, cols: Sequence[str], target: str = C.EXCESS_TARGET, keys: Sequence[str] = ()) -> DataFrame:
    """Raw columns without dummies, grouped by prefix letter."""
    return select_ic(df, [c for c in cols if not c.startswith("D")], target, F.substring("feature", 1, 1), keys)


def ic_table_per_fold(
    df: DataFrame, cols: Sequence[str], target: str = C.EXCESS_TARGET,
    initial: int = C.INITIAL_TRAIN, folds: int = C.TUNE_FOLDS, keys: Sequence[str] = C.KEYS,
) -> DataFrame:
    """``ic_table`` of every training window."""
    if not is_blocked(df):
        return _fold_statistics(df, cols, target, initial, folds, keys)
    return _fold_table(df, cols, target, initial, folds, keys, settle(_fold_moments(df, cols, target, initial, folds, keys)))


def _fold_statistics(
    df: DataFrame, cols: Sequence[str], target: str, initial: int, folds: int, keys: Sequence[str], walk: bool = False
) -> DataFrame:
    """``ic_table`` of every training window or, with ``walk``, the selection in it: one pass over each series."""
    names_ = list(cols)
    segments = drop_null_target(with_segments(df, initial, folds, keys), target).filter(F.col("fold") < folds)
    cells = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(names_)]
    rows = segments.select(*keys, F.col("fold").alias("_fold"), F.col(target).cast("double").alias("_y"), *cells)
    rows = rows.dropna(subset=list(keys))  # as the joins of the other way do
    groups = {c: raw_name(c) for c in names_}

    def run(table: pa.Table) -> dict[str, pa.Array]:
        fold, x = table.column("_fold").to_numpy(), [column(table, f"_x{i}") for i in range(len(names_))]
        n, ic, t_stat = expanding_ics(x, [known(table, f"_x{i}") for i in range(len(names_))], column(table, "_y"), fold, folds)
        shown = (n >= 10) & ~np.isnan(ic)
        variance, keeps = np.full(n.shape, np.nan), np.zeros((2, *n.shape), int)
        for f, moments in enumerate(expanding_moments(np.stack(x, axis=1), fold, folds)):
            count = np.diag(moments[0])
            variance[f] = np.divide(np.diag(moments[3]), count, out=np.full(len(names_), np.nan), where=count > 0)
            if walk:
                passed = [i for i in range(len(names_)) if shown[f, i] and abs(t_stat[f, i]) >= C.IC_T_MIN]
                corr = correlations(moments)
                pairs = {(a, b): corr[a, b] for a in passed for b in passed if a < b and not np.isnan(corr[a, b])}
                kept, chosen = greedy_keep(passed, {i: groups[names_[i]] for i in passed}, {i: variance[f, i] for i in passed}, pairs)
                keeps[0, f, kept], keeps[1, f, chosen] = 1, 1
                shown[f] = np.isin(np.arange(len(names_)), passed)
        at, feature = np.nonzero(shown)
        value = lambda of: nullable(of[at, feature])
        out = {"fold": pa.array(at, pa.int32()), "feature": pa.array([names_[i] for i in feature], pa.string())}
        if not walk:
            out["n"] = pa.array(n[at, feature], pa.int64())
        out |= {"ic": value(ic), "t_stat": value(t_stat), "variance": value(variance)}
        if walk:
            out |= {name: pa.array(keep[at, feature], pa.int32()) for name, keep in zip(("kept", "selected"), keeps)}
        return out

    more = ("", ", kept int, selected int") if walk else (", n long", "")
    return per_series(rows, keys, run, f"fold int, feature string{more[0]}, ic double, t_stat double, variance double{more[1]}")


def raw_name(feature: str) -> str:
    """Raw column of one feature name: the column function ``raw_source`` on the driver."""
    found = re.match(r"[A-Z]+\d+", feature)
    return found.group(0) if found else feature[:1]


def _fold_moments(df: DataFrame, cols: Sequence[str], target: str, initial: int, folds: int, keys: Sequence[str]) -> DataFrame:
    # a row without a target keeps its place in the folds but counts in no moment
    known = [F.when(F.col(target).isNotNull(), F.col(c).cast("double")).alias(c) for c in cols]
    kept = [c for c in (*keys, POS, BLOCK) if c in df.columns]
    return fold_moments(df.select(*kept, *known), cols, initial, folds, keys)


def _fold_table(
    df: DataFrame, cols: Sequence[str], target: str, initial: int, folds: int, keys: Sequence[str], moments: DataFrame
) -> DataFrame:
    ics = fold_ics(df, cols, target, initial, folds, keys).filter("n >= 10 and ic is not null")
    name = F.array(*[F.lit(c) for c in cols])[F.col("i")]
    variances = moments.filter("i = j").select(*keys, "fold", name.alias("feature"), (F.col("q1") / F.col("n")).alias("variance"))
    return ics.join(variances, [*keys, "fold", "feature"])


def select_per_fold(
    df: DataFrame, cols: Sequence[str], target: str = C.EXCESS_TARGET,
    initial: int = C.INITIAL_TRAIN, folds: int = C.TUNE_FOLDS, keys: Sequence[str] = C.KEYS,
) -> DataFrame:
    """The selection inside every training window, from one copy of each row."""
    if not is_blocked(df):
        return _fold_statistics(df, cols, target, initial, folds, keys, walk=True)
    moments, by = settle(_fold_moments(df, cols, target, initial, folds, keys)), [*keys, "fold"]
    pairs = corr_from_moments(moments, cols, by).filter("corr is not null")
    return _selected(_fold_table(df, cols, target, initial, folds, keys, moments), pairs, cols, None, by)
