"""Regressors and the direction classifier as pyspark.ml pipelines.

Filling and scaling are one SQL stage with the training means and deviations, so
a saved pipeline carries everything it needs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieswise import config as C
from serieswise.operators.frames import drop_null_target
from serieswise.operators.ordered import small_group
from serieswise.plans.trees import BINS, BinnedTrees, boosted_trees, boosting, grown_forest, histogram_bytes, merged_cells, packed, trees_json
from serieswise.session import settle

#: Memory that the working copies of fits side by side may take, all executors together.
FIT_BYTES = 4 << 30
#: Sums of one level of a forest that a task holds.
HISTOGRAM_BYTES = 256 << 20
#: Quantiles of a column of many values that its split candidates are picked from.
FINE = 2_000
#: Cells of bins and label that one task boosts: all there can be of four columns.
CELLS = 2 * BINS**4
#: Of a row in a tree fit: its binned values, sample counts, errors of the last rounds; besides 4 for each tree grown at a time.
ROW_BYTES = 200

LINEAR = ("linear", "ridge", "lasso", "elasticnet")


def _normal(**params: float) -> LinearRegression:
    return LinearRegression(featuresCol="features", solver="normal", standardization=False, **params)


def linear(n: int, sd: float) -> LinearRegression:
    return _normal(regParam=0.0)


def ridge(n: int, sd: float, alpha: float = 1.0) -> LinearRegression:
    # the penalty is on the sum of squared errors; Spark's is on its mean over a scaled target
    return _normal(regParam=alpha / n * sd, elasticNetParam=0.0)


def lasso(n: int, sd: float, alpha: float = 1.0) -> LinearRegression:
    return _normal(regParam=alpha, elasticNetParam=1.0)


def elasticnet(n: int, sd: float, alpha: float = 1.0, l1_ratio: float = 0.5) -> LinearRegression:
    reg = alpha * (l1_ratio + (1 - l1_ratio) * sd)
    return _normal(regParam=reg, elasticNetParam=alpha * l1_ratio / reg if reg else 0.0)


def forest(
    n: int, sd: float, n_estimators: int = 100, max_depth: int = 5, min_samples_leaf: int = 1, max_features: float = 1.0
) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="features", numTrees=n_estimators, maxDepth=max_depth, minInstancesPerNode=min_samples_leaf,
        featureSubsetStrategy=str(float(max_features)) if max_features < 1 else "all", seed=C.SEED,
    )


def boosted(
    n: int, sd: float, n_estimators: int = 100, max_depth: int = 5, learning_rate: float = 0.1,
    subsample: float = 1.0, colsample: float = 1.0, min_child: int = 1,
) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="features", maxIter=n_estimators, maxDepth=max_depth, stepSize=learning_rate,
        subsamplingRate=subsample, minInstancesPerNode=min_child,
        featureSubsetStrategy=str(float(colsample)) if colsample < 1 else "all", seed=C.SEED,
    )


# model name -> builder taking the row count and target deviation, and the parameters
REGISTRY: dict[str, Callable[..., Estimator]] = {
    "linear": linear, "ridge": ridge, "lasso": lasso, "elasticnet": elasticnet, "rf": forest, "boosted": boosted,
}


def build(name: str, n: int, sd: float, **params: float) -> Estimator:
    if name not in REGISTRY:
        raise ValueError(f"unknown model {name!r}; available: {sorted(REGISTRY)}")
    return REGISTRY[name](n, sd, **params)


def _stages(means: dict[str, float], steps: dict[str, float] | None) -> list:
    """Fill nulls, optionally scale, and assemble; the values are part of the stage."""
    double = lambda v: f"CAST('{v!r}' AS DOUBLE)"
    cells = {c: f"coalesce(CAST(`{c}` AS DOUBLE), {double(m)})" for c, m in means.items()}
    if steps is not None:
        cells = {c: f"({e} - {double(means[c])}) / {double(steps[c])}" for c, e in cells.items()}
    text = ", ".join(f"{e} AS `_x_{c}`" for c, e in cells.items())
    return [
        SQLTransformer(statement=f"SELECT *, {text} FROM __THIS__"),
        VectorAssembler(inputCols=[f"_x_{c}" for c in means], outputCol="features"),
    ]


def train_statistics(train: DataFrame, cols: Sequence[str], target: str) -> tuple[int, float, dict, dict]:
    """Rows, target deviation, column means and mean-filled column deviations, in one pass."""
    stats = train.agg(
        F.count(F.lit(1)).alias("_n"),
        F.stddev_pop(target).alias("_sd"),
        *[f(F.col(c).cast("double")).alias(f"{c}__{k}") for c in cols for k, f in (("m", F.avg), ("v", F.var_pop), ("k", F.count))],
    ).first()
    n = stats["_n"]
    if not n:
        raise ValueError("no training row has a target")
    means = {c: float(stats[f"{c}__m"] or 0.0) for c in cols}
    # a filled cell sits on the mean, so it only adds to the row count
    steps = {c: float((stats[f"{c}__v"] or 0.0) * stats[f"{c}__k"] / n) ** 0.5 or 1.0 for c in cols}
    return n, float(stats["_sd"]), means, steps


def fits_at_once(rows: int, trees: int = 1, most: int = 8) -> int:
    """Tree fits of so many rows that may run side by side; a large one has the executors for itself."""
    return max(1, min(most, FIT_BYTES // max(rows * (ROW_BYTES + 4 * trees), 1)))


def grown(model: Estimator, n: int) -> list:
    """The stages that fit a model on n rows.

    A forest keeps a sample count for each row and tree. If all would not fit, its trees, which are independent,
    are grown in groups with a seed each, and the prediction is the mean over all trees.
    """
    size = max(1, FIT_BYTES // (4 * n))
    if not isinstance(model, RandomForestRegressor) or model.getNumTrees() <= size:
        return [model]
    trees = model.getNumTrees()
    groups = -(-trees // size)
    sizes = [trees // groups + (i < trees % groups) for i in range(groups)]
    parts = [model.copy().setNumTrees(s).setSeed(C.SEED + i).setPredictionCol(f"_x_forest{i}") for i, s in enumerate(sizes)]
    total = " + ".join(f"`_x_forest{i}` * {s}" for i, s in enumerate(sizes))
    return [*parts, SQLTransformer(statement=f"SELECT *, ({total}) / {trees} AS prediction FROM __THIS__")]


def fit_regressor(
    train: DataFrame, cols: Sequence[str], target: str, name: str, val: DataFrame | None = None, written: bool = False, **params: float
) -> PipelineModel:
    """Fitted pipeline; with ``val``, boosting stops when the validation error stops falling. Rows that are ``written`` are not kept again."""
    rows = drop_null_target(train, target).select(*cols, target)
    rows = rows if written else rows.persist()
    try:
        n, sd, means, steps = train_statistics(rows, cols, target)
        model = build(name, n, sd, **params).setLabelCol(target)
        if counts_by_bin(model, n, rows, len(cols)):
            return fit_forest(rows, means, target, model)
        data = rows
        if val is not None and isinstance(model, GBTRegressor):
            model.setValidationIndicatorCol("_held")
            held = drop_null_target(val, target).select(*cols, target).withColumn("_held", F.lit(True))
            data = rows.withColumn("_held", F.lit(False)).unionByName(held)
        return Pipeline(stages=[*_stages(means, steps if name in LINEAR else None), *grown(model, n)]).fit(data)
    finally:
        if not written:
            rows.unpersist()


def counts_by_bin(model: Estimator, n: int, rows: DataFrame, width: int) -> bool:
    """Whether a forest is grown from histograms: of more rows than ``small_group``, where the sums of a level fit a task."""
    if not isinstance(model, RandomForestRegressor) or n <= small_group(rows):
        return False
    return histogram_bytes(model.getNumTrees(), model.getMaxDepth(), width) <= HISTOGRAM_BYTES


def fit_forest(rows: DataFrame, means: dict[str, float], target: str, model: RandomForestRegressor) -> PipelineModel:
    """``model`` from the bins of the rows: a job a level of all trees, in which a task sends sums only.

    The split candidates come from all rows, while Spark ML draws 10,000 by partition; the random draws are others, too.
    """
    xs, into = [f"_x_{c}" for c in means], [f"_x_bin_{c}" for c in means]
    fill = _stages(means, None)[0]
    filled = fill.transform(rows)
    values = split_candidates(filled, xs)
    binned = bucketizer([values[x] for x in xs], xs, into).transform(filled)
    cells = F.array(*[F.struct(F.lit(j).alias("j"), F.col(b).cast("int").alias("b"), F.col(x).alias("x")) for j, (b, x) in enumerate(zip(into, xs))])
    lows = binned.select(F.explode(cells).alias("_c")).groupBy("_c.j", "_c.b").agg(F.min("_c.x").alias("low")).collect()
    low = {(r["j"], r["b"]): r["low"] for r in lows}
    cuts = [[(v + low[j, i + 1]) / 2.0 for i, v in enumerate(values[x])] for j, x in enumerate(xs)]
    few = max(2 * rows.sparkSession.sparkContext.defaultParallelism, 16)
    slim = settle(binned.select(*packed(into), F.col(target).cast("double").alias("_x_y")).coalesce(few))
    share = model.getFeatureSubsetStrategy()
    trees = grown_forest(
        slim, len(xs), model.getNumTrees(), model.getMaxDepth(), model.getMinInstancesPerNode(), 1.0 if share == "all" else float(share), C.SEED
    )
    return PipelineModel([fill, bucketizer(cuts, xs, into), BinnedTrees(into, "prediction", trees_json(trees))])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out.drop("features", "rawPrediction", *[c for c in out.columns if c.startswith("_x_")])


def coefficients(model: PipelineModel, cols: Sequence[str]) -> dict[str, float]:
    return dict(zip(cols, model.stages[-1].coefficients.toArray().tolist()))


def fit_boosted_gain(train: DataFrame, val: DataFrame, cols: Sequence[str], target: str, rounds: int) -> dict[str, float]:
    """Importance of every column in a boosted model with a validation stop."""
    model = fit_regressor(
        train, cols, target, "boosted", val, n_estimators=rounds, max_depth=5, learning_rate=0.05,
        subsample=0.8, colsample=0.8,
    )
    return dict(zip(cols, model.stages[-1].featureImportances.toArray().tolist()))


def direction_model(
    label: str, n_estimators: int = 500, max_depth: int = 5, learning_rate: float = 0.1, min_child: int = 20,
    subsample: float = 1.0, colsample: float = 1.0,
) -> GBTClassifier:
    return GBTClassifier(
        featuresCol="features", labelCol=label, maxIter=n_estimators, maxDepth=max_depth, stepSize=learning_rate,
        minInstancesPerNode=min_child, subsamplingRate=subsample,
        featureSubsetStrategy=str(float(colsample)) if colsample < 1 else "all", seed=C.SEED,
    )


def fit_direction(train: DataFrame, cols: Sequence[str], label: str, **params: float) -> PipelineModel:
    """Boosted classifier of the direction label.

    A training set of more than ``small_group`` rows is fitted by ``fit_counted``, unless rounds draw rows.
    """
    model = direction_model(label, **params)
    rows = train.select(*cols, label).persist()
    try:
        n, _, means, _ = train_statistics(rows, cols, label)
        if n > max(small_group(rows), 2 * model.getMinInstancesPerNode()) and model.getSubsamplingRate() == 1.0:
            return fit_counted(rows, means, label, model, n)
        return Pipeline(stages=[*_stages(means, None), model]).fit(rows)
    finally:
        rows.unpersist()


def split_values(rows: DataFrame, cols: Sequence[str]) -> dict[str, list[float]]:
    """Values of each column after which a tree may split: all but the largest of few, else the quantiles of all rows."""
    probs = [i / BINS for i in range(1, BINS)]
    stats = rows.agg(*[
        f.alias(f"{c}__{k}") for c in cols
        for k, f in (("q", F.percentile_approx(c, probs, 10_000)), ("top", F.max(c)), ("few", F.approx_count_distinct(c)))
    ]).first()
    made = {}
    for c in cols:
        values = set(stats[f"{c}__q"])
        if stats[f"{c}__few"] <= 2 * BINS:
            every = [r[0] for r in rows.select(c).distinct().collect()]
            values = set(every) if len(every) <= BINS else values
        made[c] = sorted(v for v in values if v < stats[f"{c}__top"])
    return made


def strided(counts: Sequence[tuple[float, int]]) -> list[float]:
    """Values after which a tree may split, from the rows of each in order, as Spark ML picks them: all but the last of few, else
    those nearest to equal strides of the rows. A value of many strides leaves its surplus to the next ones."""
    if len(counts) <= BINS:
        return [v for v, _ in counts[:-1]]
    stride = sum(n for _, n in counts) / BINS
    target, so_far, made = stride, counts[0][1], []
    for (before, _), (_, n) in zip(counts, counts[1:]):
        if abs(so_far - target) < abs(so_far + n - target):
            made.append(before)
            target += stride
        so_far += n
    return made[: BINS - 1]


def split_candidates(rows: DataFrame, cols: Sequence[str]) -> dict[str, list[float]]:
    """``strided`` values of each column, by the counts of few values or by fine quantiles of all rows."""
    probs = [(i + 0.5) / FINE for i in range(FINE)]
    stats = rows.agg(*[
        f.alias(f"{c}__{k}") for c in cols for k, f in (("q", F.percentile_approx(c, probs, 10_000)), ("few", F.approx_count_distinct(c)))
    ]).first()
    few = lambda c: [(r[0], r[1]) for r in rows.groupBy(c).count().collect()]
    return {c: strided(sorted(few(c) if stats[f"{c}__few"] <= 2 * BINS else Counter(stats[f"{c}__q"]).items())) for c in cols}


def bucketizer(cuts: Sequence[Sequence[float]], xs: Sequence[str], into: Sequence[str]) -> Bucketizer:
    """Bins of the columns ``xs``: a value at a cut stays below it, as in a tree, while a bucket holds its lower edge."""
    edges = [[-math.inf, *[math.nextafter(v, math.inf) for v in own or [0.0]], math.inf] for own in cuts]
    return Bucketizer(splitsArray=edges, inputCols=list(xs), outputCols=list(into))


def counted_cells(
    filled: DataFrame, xs: Sequence[str], into: Sequence[str], label: str, values: dict[str, list[float]]
) -> tuple[DataFrame, list[list[float]]]:
    """Rows of each cell of bins, up to ``values`` each, and label as ``_x_rows``, written, and the cuts between the bins."""
    counted = bucketizer([values[x] for x in xs], xs, into).transform(filled).groupBy(*into, label).agg(
        F.count(F.lit(1)).cast("double").alias("_x_rows"), *[F.min(x).alias(x) for x in xs]
    )
    # bins are ordered: without the mark of categories that the bucketizer leaves
    ordered = [F.col(b).alias(b, metadata={"ordered": True}) for b in into]
    cells = settle(counted.select(*ordered, label, "_x_rows", *xs))
    # between the last value of a bin, which is a cut, and the first of the next
    lows = [{r[0]: r[1] for r in cells.groupBy(b).agg(F.min(x)).collect()} for b, x in zip(into, xs)]
    return cells, [[(v + low[i + 1.0]) / 2.0 for i, v in enumerate(values[x])] for x, low in zip(xs, lows)]


def fit_counted(rows: DataFrame, means: dict[str, float], label: str, model: GBTClassifier, n: int) -> PipelineModel:
    """``model`` from the number of rows in each cell of bins and label, as weights.

    A tree sees the bin of a value only, and rows of a cell share their label, so they share their error in every
    round: a round reads a row a cell, at most as many as there are cells, not all rows. The split candidates
    come from all rows, while Spark ML draws 10,000 by partition.
    """
    xs, into = [f"_x_{c}" for c in means], [f"_x_bin_{c}" for c in means]
    fill = _stages(means, None)[0]
    filled = fill.transform(rows)
    cells, cuts = counted_cells(filled, xs, into, label, split_values(filled, xs))
    assemble = VectorAssembler(inputCols=into, outputCol="features")
    weighted = model.copy().setWeightCol("_x_rows").setMinInstancesPerNode(1)
    # leaves are held to rows, not cells; Spark ML draws no cells where all are fewer than the square of its bins
    weighted.setMinWeightFractionPerNode((model.getMinInstancesPerNode() - 0.5) / n)
    weighted.setMaxBins(max(BINS, math.isqrt(cells.count()) + 1))
    fitted = weighted.fit(assemble.transform(cells).select("features", label, "_x_rows"))
    return PipelineModel([fill, bucketizer(cuts, xs, into), assemble, fitted])


def fit_drawn(train: DataFrame, cols: Sequence[str], label: str, n_estimators: int, **params: float) -> PipelineModel | None:
    """``fit_direction`` by the trees of the halving, from the rows of each cell and label; None where the cells are too many.

    What a round draws of the rows of a cell and label is a binomial number. The rounds are one task over the cells,
    which are bounded whatever the rows.
    """
    train = drop_null_target(train.select(*cols, label), label)
    _, _, means, _ = train_statistics(train, cols, label)
    xs, into = [f"_x_{c}" for c in means], [f"_x_bin_{c}" for c in means]
    fill = _stages(means, None)[0]
    filled = fill.transform(train)
    cells, cuts = counted_cells(filled, xs, into, label, split_candidates(filled, xs))
    if cells.count() > CELLS:
        return None

    def run(table: pa.Table) -> pa.Table:
        up, rows = (table.column(c).to_numpy() for c in ("up", "rows"))
        bins, counts = merged_cells(table.select(into), [up, ~up], rows)
        trees, _ = boosted_trees(bins, *counts, n_estimators, **boosting(params))
        return pa.table({"trees": pa.array([trees_json(trees)], pa.string())})

    slim = cells.select(*[F.col(b).cast("byte").alias(b) for b in into], (F.col(label) == 1).alias("up"), F.col("_x_rows").alias("rows"))
    trees = slim.groupBy(F.lit(0).alias("_all")).applyInArrow(run, "trees string").first()["trees"]
    model = BinnedTrees(into, "probability", trees, rate=params.get("learning_rate", 0.1))
    return PipelineModel([fill, bucketizer(cuts, xs, into), model])


def counted_fold(train: DataFrame, held: DataFrame, cols: Sequence[str], label: str) -> DataFrame | None:
    """Rows of each cell and label of both tables: bins, ``up``, ``rows`` and ``held``; None where the cells are too many."""
    train = drop_null_target(train, label)
    _, _, means, _ = train_statistics(train, cols, label)
    xs, into = [f"_x_{c}" for c in means], [f"_x_bin_{c}" for c in means]
    fill = _stages(means, None)[0]
    filled = fill.transform(train)
    cells, cuts = counted_cells(filled, xs, into, label, split_candidates(filled, xs))
    if cells.count() > CELLS:
        return None
    later = bucketizer(cuts, xs, into).transform(fill.transform(held)).groupBy(*into, label).agg(F.count(F.lit(1)).cast("double").alias("_x_rows"))
    slim = lambda df, held: df.select(
        *[F.col(b).cast("byte").alias(b) for b in into], (F.col(label) == 1).alias("up"), F.col("_x_rows").alias("rows"), F.lit(held).alias("held")
    )
    return settle(slim(cells, False).unionByName(slim(later, True)))


def assembled(train: DataFrame, other: DataFrame, cols: Sequence[str], label: str) -> tuple[DataFrame, DataFrame]:
    """Label and filled feature vector of both tables, persisted, for many fits of one training set."""
    rows = drop_null_target(train, label).select(*cols, label)
    _, _, means, _ = train_statistics(rows, cols, label)
    filled = PipelineModel(_stages(means, None))
    slim = lambda df: filled.transform(df.select(*cols, label)).select(label, "features").persist()
    return slim(rows), slim(other)


def predict_probability(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add the probability of an up day."""
    out = model.transform(df).withColumn("probability", vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "prediction", *[c for c in out.columns if c.startswith("_x_")])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
