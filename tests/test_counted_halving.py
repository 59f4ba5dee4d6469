"""The halving on counted cells against fits on rows, and the parameters of the registered query."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from serieswise.operators.frames import folds_timeseries, with_timeseries_segments
from serieswise.operators.scoring import auc_accuracy
from serieswise.plans import models, search, trees

PLAIN = {"learning_rate": 0.2, "max_depth": 4, "min_child": 30, "subsample": 1.0, "colsample": 1.0}


@pytest.fixture()
def panel(spark):
    """Three series of 700 rows: ``a`` of 20 values, ``b`` of 9 with nulls, a label of both and of noise."""
    of = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    a, b = (of(1, 20) - 7).cast("double"), F.when(of(2, 11) > 0, of(3, 9) / 4)
    up = (a + F.coalesce(b, F.lit(1.0)) + of(4, 9) > 7).cast("int")
    series, day = F.pmod("id", F.lit(3)), F.floor(F.col("id") / 3)
    return spark.range(2100).select(
        series.alias("series_id"), day.alias("date_id"), day.alias("pos"), a.alias("a"), b.alias("b"), up.alias("label")
    ).checkpoint()


def test_the_query_runs_the_whole_search(spark, sf_dir, monkeypatch):
    from serieswise.catalog import QUERIES, model_queries

    given = {}

    def noted(train, cols, label, n_candidates=30, factor=3, min_trees=50, max_trees=500, folds=5):
        given.update(n_candidates=n_candidates, factor=factor, min_trees=min_trees, max_trees=max_trees, folds=folds)
        return train

    monkeypatch.setattr(model_queries.H, "successive_halving", noted)
    QUERIES["successive_halving"](spark, sf_dir)
    assert given == {"n_candidates": 30, "factor": 3, "min_trees": 50, "max_trees": 500, "folds": 5}
    assert search.rungs(30, 3, 50, 500) == [(30, 50), (10, 150), (4, 450)]


def test_counted_areas_equal_those_of_fits_on_rows(panel):
    counted = search.counted_aucs(panel, ["a", "b"], "label", [PLAIN], 2, ["series_id"])
    on_rows, _ = search.row_aucs(panel, ["a", "b"], "label", [PLAIN], 2, ["series_id"])
    fits = [(0, 0), (0, 1)]
    a, b = counted(fits, 8), on_rows(fits, 8)
    assert [a[f] for f in fits] == pytest.approx([b[f] for f in fits], abs=1e-9)


def test_many_trees_are_grown_from_cells(panel, monkeypatch):
    monkeypatch.setattr(search, "MANY_TREES", 0)
    monkeypatch.setattr(search, "row_aucs", lambda *a: pytest.fail("rows were read"))
    log = search.successive_halving(panel, ["a", "b"], "label", n_candidates=4, factor=2, min_trees=2, max_trees=4, folds=2).collect()
    assert [(r.rung, r.trees) for r in log] == [(0, 2)] * 4 + [(1, 4)] * 2
    assert sum(r.kept for r in log if r.rung == 0) == 2 and all(0.5 < r.auc < 1 for r in log)


def test_too_many_cells_are_fitted_by_rows(panel, monkeypatch):
    monkeypatch.setattr(search, "MANY_TREES", 0)
    monkeypatch.setattr(models, "CELLS", 10)
    log = search.successive_halving(panel, ["a", "b"], "label", n_candidates=2, factor=2, min_trees=1, max_trees=1, folds=2).collect()
    assert len(log) == 2 and all(r.auc > 0.5 for r in log)


@pytest.mark.parametrize("folds", [3, 800])
def test_segments_are_the_folds(panel, folds):
    """Also where a series is shorter than its folds, which then have no test part."""
    panel = panel.filter("date_id < 50")
    copies = folds_timeseries(panel, folds).filter(F.col("fold") < 3).select("series_id", "pos", "fold", "role")
    each = with_timeseries_segments(panel, folds).withColumnRenamed("fold", "seg").crossJoin(panel.sparkSession.range(3).toDF("fold"))
    role = F.when(F.col("seg") <= F.col("fold"), "train").when(F.col("seg") == F.col("fold") + 1, "val")
    ours = each.select("series_id", "pos", "fold", role.alias("role")).dropna()
    rows = lambda df: sorted((r.series_id, r.pos, r.fold, r.role) for r in df.collect())
    assert rows(ours) == rows(copies)


def test_drawn_rows_are_a_share_of_each_cell_and_label():
    cells = np.array([[0], [1]], np.uint8)
    up, down = np.array([60_000, 20_000]), np.array([20_000, 60_000])
    whole, said = trees.boosted_trees(cells, up, down, 1, depth=1)
    assert whole[0].value.tolist() == pytest.approx([0.0, 0.5, -0.5]) and whole[0].predict(cells).tolist() == [0.5, -0.5]
    drawn, _ = trees.boosted_trees(cells, up, down, 1, depth=1, draw=0.5)
    assert drawn[0].value.tolist() != whole[0].value.tolist()
    assert drawn[0].value.tolist() == pytest.approx([0.0, 0.5, -0.5], abs=0.02)
    # a side keeps 35,000 rows of the drawn 40,000, but not 45,000
    assert len(trees.boosted_trees(cells, up, down, 1, depth=1, draw=0.5, least=35_000)[0][0].value) == 3
    assert len(trees.boosted_trees(cells, up, down, 1, depth=1, draw=0.5, least=45_000)[0][0].value) == 1


def test_counted_area_under_the_curve(spark):
    score, up, down = np.array([0.1, 0.4, 0.4, 0.9]), np.array([1, 2, 0, 3]), np.array([2, 0, 3, 1])
    rows = [(float(s), v) for s, u, d in zip(score, up, down) for v in [1] * u + [0] * d]
    want = auc_accuracy(spark.createDataFrame(rows, "score double, label int"), "label", "score").first()["auc"]
    assert trees.counted_auc(score, up, down) == pytest.approx(want, abs=1e-12)
    assert trees.counted_auc(score, up, 0 * down) is None
