"""Parameter candidates, successive halving and model comparison."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from serieswise import config as C
from serieswise.config import BLOCK, KEYS, POS
from serieswise.operators.frames import folds_timeseries, with_timeseries_segments
from serieswise.operators.ordered import small_group
from serieswise.operators.scoring import (
    auc_accuracy,
    cum_return_pct,
    ic_metrics,
    regression_metrics,
    risk_metrics,
    score_v2,
    with_returns,
)
from serieswise.plans.models import LINEAR, assembled, counted_fold, direction_model, fit_direction, fit_drawn, fit_regressor, fits_at_once, predict
from serieswise.plans.trees import boosted_trees, boosting, counted_auc, merged_cells
from serieswise.plans.walk_forward import fold_summary, score_paths, walk_forward_estimator, walk_forward_linear
from serieswise.session import settle, side_by_side

# fixed values: search ranges; kind, low, high, step
SPACES: dict[str, dict[str, tuple]] = {
    "linear": {},
    "ridge": {"alpha": ("log", 1e-3, 1e2)},
    "lasso": {"alpha": ("log", 1e-4, 1.0)},
    "elasticnet": {"alpha": ("log", 1e-4, 1.0), "l1_ratio": ("real", 0.0, 1.0)},
    "rf": {
        "n_estimators": ("int", 100, 400, 50),
        "max_depth": ("int", 3, 10, 1),
        "min_samples_leaf": ("int", 1, 20, 1),
        "max_features": ("real", 0.3, 1.0),
    },
    "boosted": {
        "n_estimators": ("int", 100, 500, 50),
        "max_depth": ("int", 3, 8, 1),
        "learning_rate": ("log", 0.01, 0.3),
        "subsample": ("real", 0.5, 1.0),
        "colsample": ("real", 0.5, 1.0),
    },
    "direction": {
        "learning_rate": ("log", 0.005, 0.2),
        "max_depth": ("int", 3, 12, 1),
        "min_child": ("int", 5, 59, 1),
        "subsample": ("real", 0.5, 1.0),
        "colsample": ("real", 0.5, 1.0),
    },
}
SLOPE = ("real", 0.5, 3.0)
#: Trees of a halving that are grown by fits on rows.
MANY_TREES = 1_000
FAILED = -1e6


def _draw(rng: random.Random, kind: str, low: float, high: float, step: int = 1) -> float:
    if kind == "log":
        return math.exp(rng.uniform(math.log(low), math.log(high)))
    if kind == "int":
        return low + step * rng.randrange((high - low) // step + 1)
    return rng.uniform(low, high)


def candidates(model: str, n: int, slope: bool = True, seed: int = C.SEED) -> list[dict[str, float]]:
    """Seeded random parameter sets; the seed does not depend on the process."""
    rng = random.Random(f"{model}-{seed}")
    space = dict(SPACES[model], **({"k": SLOPE} if slope else {}))
    return [{name: _draw(rng, *spec) for name, spec in space.items()} for _ in range(n)]


def candidate_table(spark, model: str, params: Sequence[dict[str, float]]) -> DataFrame:
    rows = [(i, model, {k: float(v) for k, v in p.items()}) for i, p in enumerate(params)]
    return spark.createDataFrame(rows, "candidate int, model string, params map<string,double>")


def tune(
    df: DataFrame, cols: Sequence[str], model: str, trials: int = 30, initial: int = C.INITIAL_TRAIN,
    folds: int = C.TUNE_FOLDS, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Candidates with their mean fold score; best first.

    All candidates of a linear model are scored by one job. Of the others each is validated by its own
    fits, several side by side. A candidate without a score, or whose parameters the model refuses, scores far
    below; ``error`` says why.
    """
    spark, params = df.sparkSession, candidates(model, max(trials, 1))
    if model in LINEAR:
        table = score_paths(df, cols, model, params, initial=initial, folds=folds, keys=keys)
        means = table.groupBy("candidate").agg(F.avg("adjusted_sharpe").alias("_s"), F.min("converged").alias("_c"))
        undefined = F.col("_s").isNull() | F.isnan("_s")
        error = F.when(undefined, "no fold has a score").when(~F.col("_c"), "a descent did not settle")
        score = F.when(undefined, F.lit(FAILED)).otherwise(F.col("_s"))
        listed = candidate_table(spark, model, params).join(means, "candidate", "left")
        return listed.select("candidate", "model", "params", score.alias("score"), error.alias("error")).orderBy(F.desc("score"), "candidate")

    def validated(i: int) -> tuple[int, float, str | None]:
        try:
            table, _ = walk_forward_estimator(df, cols, model=model, initial=initial, folds=folds, keys=keys, **params[i])
            score = fold_summary(table).first()["adjusted_sharpe"]
        except (ValueError, IllegalArgumentException) as refused:  # the model's own refusals; a lost job is an error
            return i, FAILED, f"{type(refused).__name__}: {refused}"[:500]
        known = score is not None and math.isfinite(score)
        return i, float(score) if known else FAILED, None if known else "no fold has a score"

    scores = side_by_side(spark, [partial(validated, i) for i in range(len(params))])
    result = spark.createDataFrame(scores, "candidate int, score double, error string")
    return candidate_table(spark, model, params).join(result, "candidate").orderBy(F.desc("score"), "candidate")


def evaluate_tuned(
    df: DataFrame, cols: Sequence[str], model: str, tuned: DataFrame, initial: int = C.INITIAL_TRAIN,
    folds: int = C.EVAL_FOLDS, keys: Sequence[str] = KEYS, keep: Sequence[str] | None = None,
) -> tuple[dict[str, float], DataFrame, DataFrame, DataFrame]:
    """The best candidate of ``tune`` validated on more folds: parameters, fold table, stitched rows, summary.

    With ``keep`` the stitched rows of a linear model have these columns besides those of the scores, and are written once.
    """
    best = tuned.orderBy(F.desc("score"), "candidate").first()  # a row per candidate
    if best is None or best["score"] <= FAILED:
        raise ValueError("no candidate was scored")
    params = {k: int(v) if SPACES[model].get(k, ("",))[0] == "int" else v for k, v in best["params"].items()}
    run = partial(walk_forward_linear, keep=keep) if model in LINEAR else walk_forward_estimator
    table, val = run(df, cols, model=model, initial=initial, folds=folds, keys=keys, **params)
    summary = cv_summary(table, val, keys).withColumns(
        {"model": F.lit(model), "k": F.lit(float(params.get("k", C.K_DEFAULT))), "n_trials": F.lit(tuned.count()), "tuned_score": F.lit(best["score"])}
    )
    return params, table, val, summary


def cv_summary(folds: DataFrame, val: DataFrame, keys: Sequence[str] = KEYS, target: str = C.EXCESS_TARGET) -> DataFrame:
    """Scores, risk, IC and fold means of the validation rows of all folds, stitched per series."""
    rows = val.drop(BLOCK).withColumn(POS, F.col(C.DAY))
    key = list(keys)
    table = score_v2(rows, key).drop("n").join(risk_metrics(rows, key).drop("n"), key)
    table = table.join(cum_return_pct(with_returns(rows), key), key)
    table = table.join(ic_metrics(rows, "prediction", target, key).drop("n"), key, "left")
    mean = fold_summary(folds, key).withColumnRenamed("adjusted_sharpe", "adj_sharpe_fold_avg")
    return table.join(mean, key, "left")


def cv_report(summaries: dict[str, DataFrame], val: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per model, the mean of its ``evaluate_tuned`` summary over series, and one of buy-and-hold on the same rows.

    ``beats_hold`` is 1 where the mean adjusted Sharpe is above that of buy-and-hold.
    """
    held, key = val.drop(BLOCK).withColumns({POS: F.col(C.DAY), "position": F.lit(1.0)}), list(keys)
    bench = score_v2(held, key).drop("n").join(risk_metrics(held, key).drop("n"), key).join(cum_return_pct(with_returns(held), key), key)
    same = ["model", "status", *key]
    mean = lambda t: t.groupBy().agg(*[F.avg(c).alias(c) for c in t.columns if c not in same])
    rows = [mean(t).withColumn("model", F.lit(name)) for name, t in {"buy_and_hold": bench, **summaries}.items()]
    table = reduce(partial(DataFrame.unionByName, allowMissingColumns=True), rows)
    level = F.max(F.when(F.col("model") == "buy_and_hold", F.col("adjusted_sharpe"))).over(Window.partitionBy(F.lit(0)))  # a row per model
    return table.withColumn("beats_hold", (F.col("adjusted_sharpe") > level).cast("int"))


def best_direction(
    train: DataFrame, cols: Sequence[str], label: str, log: DataFrame, n_candidates: int = 30
) -> tuple[PipelineModel, dict[str, float], float]:
    """The halving's winner refitted on all training rows, with its parameters and score.

    Training sets of more than ``small_group`` rows are fitted from counts of cells, as in the halving.
    """
    top = log.filter("kept = 1").orderBy(F.desc("rung"), F.desc("auc"), "candidate").first()
    params = candidates("direction", n_candidates, slope=False)[top["candidate"]]
    fitted = fit_drawn(train, cols, label, top["trees"], **params) if train.count() > small_group(train) else None
    fitted = fitted or fit_direction(train, cols, label, n_estimators=top["trees"], **params)
    return fitted, {**params, "n_estimators": top["trees"]}, top["auc"]


def rungs(n_candidates: int, factor: int, min_trees: int, max_trees: int) -> list[tuple[int, int]]:
    """Candidates and trees of each rung of the halving; one candidate of the last is kept."""
    listed = [(n_candidates, min_trees)]
    while listed[-1][0] > factor and listed[-1][1] * factor <= max_trees:
        listed.append((math.ceil(listed[-1][0] / factor), listed[-1][1] * factor))
    return listed


def successive_halving(
    train: DataFrame, cols: Sequence[str], label: str, n_candidates: int = 30, factor: int = 3,
    min_trees: int = 50, max_trees: int = 500, folds: int = 5, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """candidate, rung, trees, auc, kept: each rung keeps a third and triples the trees.

    Many trees, or those of many rows, are grown from the counts of cells (``counted_aucs``), unless the cells
    are too many; others by fits on rows. The candidate list is small and lives on the driver.
    """
    spark, params = train.sparkSession, candidates("direction", n_candidates, slope=False)
    listed = rungs(n_candidates, factor, min_trees, max_trees)
    # one fit reads all rows several times a tree: beyond these bounds the cells are counted first
    many = sum(n * trees for n, trees in listed) * folds > MANY_TREES or train.count() > small_group(train)
    counted = counted_aucs(train, cols, label, params, folds, keys) if many else None
    score, held = (counted, []) if counted else row_aucs(train, cols, label, params, folds, keys)
    alive, log = list(range(n_candidates)), []
    for rung, (_, trees) in enumerate(listed):
        aucs = score([(c, f) for c in alive for f in range(folds)], trees)
        scores = {}
        for c in alive:
            known = [aucs[c, f] for f in range(folds) if aucs[c, f] is not None]
            scores[c] = sum(known) / len(known) if known else 0.0
        order = sorted(alive, key=lambda c: (-scores[c], c))
        kept = order[: listed[rung + 1][0]] if rung + 1 < len(listed) else order[:1]
        log += [(c, rung, trees, scores[c], int(c in kept)) for c in alive]
        alive = sorted(kept)
    for part in held:
        part.unpersist()
    return spark.createDataFrame(log, "candidate int, rung int, trees int, auc double, kept int")


Aucs = Callable[[list[tuple[int, int]], int], dict[tuple[int, int], float | None]]


def row_aucs(
    train: DataFrame, cols: Sequence[str], label: str, params: Sequence[dict[str, float]], folds: int, keys: Sequence[str]
) -> tuple[Aucs, list[DataFrame]]:
    """Areas under the curve of candidates on folds, each from a fit on the rows, and the tables it holds.

    The rows of every fold are filled and assembled once and serve all fits, of which small ones run side by side.
    """
    spark = train.sparkSession
    rows = folds_timeseries(train, folds, keys).select(*cols, label, "fold", "role").persist()
    role = lambda fold, name: rows.filter((F.col("fold") == fold) & (F.col("role") == name))
    most = fits_at_once(rows.count() // max(folds, 1))
    parts = side_by_side(spark, [partial(assembled, role(f, "train"), role(f, "val"), cols, label) for f in range(folds)], most)

    def fold_auc(candidate: int, trees: int, fold: int) -> float | None:
        own, held = parts[fold]
        fitted = direction_model(label, n_estimators=trees, **params[candidate]).fit(own)
        scored = fitted.transform(held).select(label, vector_to_array("probability")[1].alias("probability"))
        return auc_accuracy(scored, label, "probability").first()["auc"]

    aucs = lambda fits, trees: dict(zip(fits, side_by_side(spark, [partial(fold_auc, c, trees, f) for c, f in fits], most)))
    return aucs, [rows, *[p for pair in parts for p in pair]]


def counted_aucs(
    train: DataFrame, cols: Sequence[str], label: str, params: Sequence[dict[str, float]], folds: int, keys: Sequence[str]
) -> Aucs | None:
    """Like ``row_aucs``, each from the rows of both labels in the cells of a fold; None where the cells are too many.

    The rows are counted once a fold. A fit is a task over the cells of its fold, which are bounded whatever the
    rows, so the fits of a rung are one job.
    """
    spark = train.sparkSession
    segments = with_timeseries_segments(train, folds, keys)
    rows = settle(segments.select(*cols, label, F.col("fold").alias("_seg")))
    part = lambda f: counted_fold(rows.filter(F.col("_seg") <= f), rows.filter(F.col("_seg") == f + 1), cols, label)
    cells = side_by_side(spark, [partial(part, f) for f in range(folds)], fits_at_once(rows.count()))
    if any(c is None for c in cells):
        return None
    counted = reduce(DataFrame.unionByName, [c.withColumn("fold", F.lit(f)) for f, c in enumerate(cells)])
    bins = [c for c in counted.columns if c not in ("up", "rows", "held", "fold")]

    def aucs(fits: list[tuple[int, int]], trees: int) -> dict[tuple[int, int], float | None]:
        def run(table: pa.Table) -> pa.Table:
            at = table.column("fit")[0].as_py()
            candidate, fold = fits[at]
            auc = trees_auc(table.select(bins), *[table.column(c).to_numpy() for c in ("up", "rows", "held")], trees, params[candidate], fold)
            return pa.table({"fit": pa.array([at], pa.int32()), "auc": pa.array([auc], pa.float64())})

        asked = spark.createDataFrame([(i, f) for i, (_, f) in enumerate(fits)], "fit int, fold int")
        # a row a fit: each meets the cells of its fold; with more partitions than fits few tasks have several
        met = counted.join(F.broadcast(asked), "fold").drop("fold").repartition(4 * len(fits), "fit")
        found = met.groupBy("fit").applyInArrow(run, "fit int, auc double").collect()
        return {**dict.fromkeys(fits), **{fits[r["fit"]]: r["auc"] for r in found}}

    return aucs


def trees_auc(
    bins: pa.Table, up: np.ndarray, rows: np.ndarray, held: np.ndarray, trees: int, params: dict[str, float], fold: int
) -> float | None:
    """Area under the curve of held rows by the trees of the others, from counts of cells and label."""
    cells, counts = merged_cells(bins, [(held == h) & (up == u) for h in (False, True) for u in (True, False)], rows)
    own_up, own_down, held_up, held_down = counts
    if not (own_up + own_down).any():
        return None
    _, said = boosted_trees(cells, own_up, own_down, trees, seed=(C.SEED, fold), **boosting(params))
    return counted_auc(said, held_up, held_down)


# fixed values: the compared regressors and their parameters
COMPARED = {
    "linear": {},
    "ridge": {"alpha": 1.0},
    "lasso": {"alpha": 0.001},
    "boosted": {"n_estimators": 500, "max_depth": 6, "learning_rate": 0.05, "subsample": 0.8, "colsample": 0.8},
}


def compare_models(
    panel: DataFrame, cols: Sequence[str], target: str = C.RETURN_TARGET, models: dict[str, dict] | None = None
) -> DataFrame:
    """model, split, mse, mae, r2 over the three splits, and the rank by test R2."""
    parts = {s: panel.filter(F.col("split") == s) for s in ("train", "val", "test")}

    def scored(name: str, params: dict) -> DataFrame:
        fitted = fit_regressor(parts["train"], cols, target, name, val=parts["val"], **params)
        return regression_metrics(predict(fitted, panel), target, "prediction", ["split"]).withColumn("model", F.lit(name))

    tables = side_by_side(panel.sparkSession, [partial(scored, n, p) for n, p in (models or COMPARED).items()])
    table = reduce(DataFrame.unionByName, tables)
    test = Window.partitionBy("split").orderBy(F.desc("r2"), "model")
    ranks = table.withColumn("_r", F.row_number().over(test)).filter("split = 'test'").select(
        "model", F.col("_r").cast("long").alias("place")
    )
    return table.join(ranks, "model").select("model", "place", "split", "mse", "mae", "r2")
