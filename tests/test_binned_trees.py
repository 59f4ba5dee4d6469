"""Forests from histograms and refits from counts against Spark ML's fits on rows."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from serieswise.plans import models, search, trees, walk_forward
from serieswise.session import side_by_side


@pytest.fixture()
def rows(spark):
    """4,000 rows: ``a`` of 20 values, ``b`` of 9 with nulls, ``c`` of many; ``y`` of all and noise, ``label``."""
    of = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    a, b, c = (of(1, 20) - 7).cast("double"), F.when(of(2, 11) > 0, of(3, 9) / 4), of(5, 10**9) / 1e8
    y = a * a / 9 - F.coalesce(b, F.lit(2.0)) + F.when(c > 4, 3.0).otherwise(0.0) + of(6, 1000) / 1000
    return spark.range(4000).select("id", a.alias("a"), b.alias("b"), c.alias("c"), y.alias("y"), (y > 2).cast("int").alias("label")).repartition(3).checkpoint()


@pytest.fixture()
def large(spark):
    """Fits of over 100 rows count as large."""
    spark.conf.set("serieswise.smallGroup", "100")
    yield
    spark.conf.unset("serieswise.smallGroup")


@pytest.mark.parametrize("cols", [["a", "b"], ["a", "c"], [f"x{i}" for i in range(13)]])
def test_a_tree_of_all_rows_is_that_of_spark_ml(rows, cols):
    """With every row drawn once all trees are alike: of equal rows summed first, of unlike rows, and of several packed longs."""
    rows = rows.select("*", *[(F.pmod(F.xxhash64("id", F.lit(20 + i)), F.lit(3)) + F.col("a") * 3).alias(f"x{i}") for i in range(13)])
    rows = rows.withColumn("b", F.coalesce("b", F.lit(2.0))).checkpoint()
    values = {c: sorted(r[0] for r in rows.select(c).distinct().collect()) for c in cols}
    values = {c: v if len(v) <= 32 else v[:: len(v) // 31 + 1] for c, v in values.items()}
    into = [f"_x_bin_{c}" for c in cols]
    binned = models.bucketizer([values[c][:-1] for c in cols], cols, into).transform(rows)
    binned = binned.withColumns({b: F.col(b).alias(b, metadata={"ordered": True}) for b in into})  # no categories
    slim = binned.select(*trees.packed(into), F.col("y").alias("_x_y")).checkpoint()
    assert len(slim.columns) == len(cols) // 12 + 2
    grown = trees.grown_forest(slim, len(cols), 2, depth=4, least=40, table=np.ones(65_536))
    filled = VectorAssembler(inputCols=into, outputCol="features").transform(binned)
    tree = DecisionTreeRegressor(labelCol="y", maxDepth=4, minInstancesPerNode=40).fit(filled)
    want = {r.id: r.prediction for r in tree.transform(filled).select("id", "prediction").collect()}
    bins = np.array([[r[b] for b in into] for r in binned.orderBy("id").collect()]).astype(np.uint8)
    for one in grown:
        assert one.predict(bins).tolist() == pytest.approx([want[i] for i in range(4000)], abs=1e-9)


def test_a_large_forest_is_grown_from_histograms(rows, large, tmp_path):
    fitted = models.fit_regressor(rows, ["a", "b", "c"], "y", "rf", n_estimators=30, max_depth=5, max_features=0.6)
    rows.sparkSession.conf.unset("serieswise.smallGroup")
    whole = models.fit_regressor(rows, ["a", "b", "c"], "y", "rf", n_estimators=30, max_depth=5, max_features=0.6)
    assert isinstance(fitted.stages[-1], trees.BinnedTrees) and not isinstance(whole.stages[-1], trees.BinnedTrees)
    grown = trees.trees_of(fitted.stages[-1].getOrDefault("trees"))
    assert len(grown) == 30 and len({t.value[0] for t in grown}) == 30  # every tree draws its own rows
    said = models.predict(fitted, rows)
    assert said.columns == [*rows.columns, "prediction"]
    both = said.join(models.predict(whole, rows).select("id", F.col("prediction").alias("other")), "id")
    r = both.agg(F.corr("prediction", "other").alias("r"), F.avg(F.pow(F.col("prediction") - F.col("y"), 2)).alias("a"), F.avg(F.pow(F.col("other") - F.col("y"), 2)).alias("b")).first()
    assert r.r > 0.99 and r.a < 1.2 * r.b
    models.save_model(fitted, str(tmp_path / "forest"))
    loaded = models.predict(models.load_model(str(tmp_path / "forest")), rows)
    values = lambda df: [r.prediction for r in df.orderBy("id").select("prediction").collect()]
    assert values(loaded) == values(said) == values(models.predict(fitted, rows))


def test_split_candidates_are_picked_as_spark_ml_does(rows):
    """A value of a third of the rows leaves the places it takes to others: 31 candidates, not the distinct ones of 31 quantiles."""
    heavy = rows.select(F.when(F.pmod("id", F.lit(3)) == 0, 40.0).otherwise(F.floor(F.col("c") * 10)).alias("c"), "a", "y")
    found = models.split_candidates(heavy, ["c", "a"])
    assert len(found["c"]) == 31 and len(models.split_values(heavy, ["c"])["c"]) < 25
    assert found["a"] == sorted(r.a for r in rows.select("a").distinct().collect())[:-1]
    assert models.strided([(1.0, 5), (2.0, 1)]) == [1.0]
    each = [(float(v), 900 if v == 40 else 10) for v in range(100)]
    tree = DecisionTreeRegressor(labelCol="y", maxDepth=1)  # Spark ML's own: a stump's candidates are not shown, its best split is
    features = heavy.select("y", "c").withColumn("y", (F.col("c") > models.split_candidates(heavy, ["c"])["c"][20]).cast("double"))
    stump = tree.fit(VectorAssembler(inputCols=["c"], outputCol="features").transform(features))
    cut = stump.toDebugString.split("<= ")[1].split(")")[0]
    assert any(v <= float(cut) < v + 1 for v in found["c"])
    assert len(models.strided(each)) == 31


def test_drawn_numbers_are_poisson():
    table = trees.poisson_table()
    assert table.mean() == pytest.approx(1, abs=1e-4) and table.var() == pytest.approx(1, abs=1e-3)
    assert (table == 0).mean() == pytest.approx(np.exp(-1), abs=2e-5)


def test_wide_and_deep_forests_are_left_to_spark_ml(rows, large, monkeypatch):
    monkeypatch.setattr(models, "HISTOGRAM_BYTES", 2 * 3 * 32 * 16)
    flat = models.fit_regressor(rows, ["a", "b", "c"], "y", "rf", n_estimators=2, max_depth=1)
    deep = models.fit_regressor(rows, ["a", "b", "c"], "y", "rf", n_estimators=2, max_depth=2)
    assert isinstance(flat.stages[-1], trees.BinnedTrees) and deep.stages[-1].getNumTrees == 2


def test_a_large_refit_equals_the_fit_on_rows(rows, spark, large, tmp_path):
    params = {"learning_rate": 0.2, "max_depth": 4, "min_child": 30, "subsample": 1.0, "colsample": 1.0}
    cells = models.fit_drawn(rows, ["a", "b"], "label", 6, **params)
    spark.conf.unset("serieswise.smallGroup")
    whole = models.fit_direction(rows, ["a", "b"], "label", n_estimators=6, **params)
    values = lambda model: [r.probability for r in models.predict_probability(model, rows).orderBy("id").collect()]
    assert values(cells) == pytest.approx(values(whole), abs=1e-9)
    models.save_model(cells, str(tmp_path / "model"))
    assert values(models.load_model(str(tmp_path / "model"))) == values(cells)
    drawn = models.fit_drawn(rows, ["a", "b"], "label", 6, **{**params, "subsample": 0.6})
    assert 0 < np.abs(np.subtract(values(drawn), values(cells))).mean() < 0.05


def test_the_winner_of_many_rows_is_refitted_from_cells(rows, large, monkeypatch):
    panel = rows.withColumns({"series_id": F.lit(1), "pos": F.col("id")})
    log = search.successive_halving(panel, ["a", "b"], "label", n_candidates=2, factor=2, min_trees=2, max_trees=2, folds=2)
    fitted, params, auc = search.best_direction(panel, ["a", "b"], "label", log, n_candidates=2)
    assert isinstance(fitted.stages[-1], trees.BinnedTrees) and params["n_estimators"] == 2 and auc > 0.8
    assert len(trees.trees_of(fitted.stages[-1].getOrDefault("trees"))) == 2
    monkeypatch.setattr(models, "CELLS", 10)
    fitted, _, _ = search.best_direction(panel, ["a", "b"], "label", log, n_candidates=2)
    assert not isinstance(fitted.stages[-1], trees.BinnedTrees)


def test_unlike_cells_are_predicted_row_by_row(rows):
    """More columns than a table of all cells holds."""
    into = ["a", "b", "c", "d", "e"]
    bins = rows.select("id", *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(32)).cast("double").alias(c) for i, c in enumerate(into)])
    tree = trees.Tree(np.array([4, 0, 0]), np.array([9, 32, 32]), np.array([1, 1, 2]), np.array([0.0, -1.0, 2.5]), 1)
    said = trees.BinnedTrees(into, "prediction", trees.trees_json([tree, tree])).transform(bins)
    assert said.filter("prediction <> if(e <= 9, -1.0, 2.5)").count() == 0


def test_folds_of_large_forests_read_the_written_rows_and_run_side_by_side(rows, large, monkeypatch):
    """Against the folds of Spark ML's forests: the same sizes and columns, and nearly the same errors."""
    seen, written = [], []

    def noted(spark, jobs, most=8):
        seen.append(most)
        return side_by_side(spark, jobs, most)

    def fitted(*args, **kwargs):
        written.append(kwargs.get("written", False))
        return models.fit_regressor(*args, **kwargs)

    panel = rows.select(
        F.pmod("id", F.lit(2)).alias("series_id"), *[F.floor(F.col("id") / 2).alias(c) for c in ("date_id", "pos")], "a", "b", "c",
        F.col("y").alias("market_forward_excess_returns"), (F.col("y") / 100).alias("forward_returns"), F.lit(0.0).alias("risk_free_rate"),
    )
    monkeypatch.setattr(walk_forward, "side_by_side", noted)
    monkeypatch.setattr(walk_forward, "fit_regressor", fitted)
    run = lambda: {
        (r.series_id, r.fold): r for r in walk_forward.walk_forward_estimator(panel, ["a", "b", "c"], initial=500, folds=3, n_estimators=20)[0].collect()
    }
    ours = run()
    rows.sparkSession.conf.unset("serieswise.smallGroup")
    theirs = run()
    assert written == [True] * 3 + [False] * 3 and seen[0] == 3
    assert sorted(ours) == sorted(theirs) and len(ours) == 6
    for key, r in ours.items():
        assert (r.train_size, r.val_size, r.n_features) == (theirs[key].train_size, theirs[key].val_size, theirs[key].n_features)
        assert r.mae == pytest.approx(theirs[key].mae, rel=0.1)
