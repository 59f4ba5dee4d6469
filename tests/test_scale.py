"""Steps that have to stay small as the tables grow."""

import numpy as np
import pandas as pd
import pytest

from serieswise.operators import ordered


@pytest.fixture()
def large_groups(spark):
    spark.conf.set("serieswise.smallGroup", "60")
    yield
    spark.conf.unset("serieswise.smallGroup")


def test_ranks_write_distinct_values_not_rows(spark, large_groups, monkeypatch):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"x": rng.integers(0, 9, 3000).astype(float), "y": rng.integers(0, 7, 3000).astype(float)})
    pairs, written = spark.createDataFrame(pdf), []

    def settle(df):
        out = df.checkpoint()
        written.append(out.count())
        return out

    monkeypatch.setattr(ordered, "settle", settle)
    got = ordered.spearman(pairs, []).first()
    assert written and max(written) <= 9
    assert got.n == 3000 and got.ic == pytest.approx(pdf["x"].rank().corr(pdf["y"].rank()), abs=1e-12)


@pytest.fixture()
def panel(spark, sf_dir):
    from serieswise.operators.features import features_v2
    from serieswise.sources.fixtures import fx_panel

    def make():
        return features_v2(fx_panel(spark, sf_dir))[0].checkpoint()

    return make


def both_ways(spark, make, run, by):
    """Sorted results of whole series and of blocks of 128 rows."""
    out = []
    for rows in (None, "128"):
        if rows:
            spark.conf.set("serieswise.blockRows", rows)
        try:
            out.append(run(make()).toPandas().sort_values(by, ignore_index=True))
        finally:
            spark.conf.unset("serieswise.blockRows")
    pd.testing.assert_frame_equal(out[0], out[1][out[0].columns], rtol=1e-7, atol=1e-9, check_dtype=False)
    return out[0]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_selection_of_folds_reads_each_series_once(spark, panel):
    from serieswise.catalog.selection_queries import COLS, TARGET
    from serieswise.plans.selection import ic_table_per_fold, select_per_fold

    for table in (ic_table_per_fold, select_per_fold):
        run = lambda df: table(df, COLS, TARGET, 252, 5)
        assert len(both_ways(spark, panel, run, ["series_id", "fold", "feature"]))
        plan = plan_of(run(panel()))
        assert "FlatMapGroupsInArrow" in plan and "Generate" not in plan


def test_fold_models_of_whole_series_and_of_blocks_agree(spark, panel):
    from serieswise.catalog.selection_queries import COLS, TARGET
    from serieswise.plans.walk_forward import fit_folds
    from pyspark.sql import functions as F

    run = lambda df: fit_folds(df, COLS, TARGET, "ridge", initial=252).select(
        "series_id", "fold", "train_size", "n_features", "intercept", *[F.col("weights")[i].alias(f"w{i}") for i in range(len(COLS))]
    )
    assert len(both_ways(spark, panel, run, ["series_id", "fold"]))
    assert "Generate" not in plan_of(run(panel()))


def test_candidates_are_not_rows(spark, panel):
    from serieswise.catalog.selection_queries import COLS
    from serieswise.plans.search import candidates
    from serieswise.plans.walk_forward import score_paths

    run = lambda df: score_paths(df, COLS, "ridge", candidates("ridge", 6), initial=252)
    assert both_ways(spark, panel, run, ["series_id", "fold", "candidate"])["adjusted_sharpe"].notna().all()
    assert "Generate" not in plan_of(run(panel()))


def test_grid_curves_are_not_rows(spark, sf_dir):
    from pyspark.sql import functions as F
    from serieswise.catalog.base import scored
    from serieswise.operators.backtest import backtest_grid

    # unknown returns and probabilities stay unknown
    gap = lambda c, k: F.when(F.col("date_id") % k != 5, F.col(c)).alias(c)
    make = lambda: scored(spark, sf_dir).withColumns({c: gap(c, k) for c, k in (("forward_returns", 97), ("probability", 61))}).checkpoint()
    assert len(both_ways(spark, make, backtest_grid, ["series_id", "grid_idx"]))
    assert "Generate" not in plan_of(backtest_grid(make()))


def test_rows_without_a_series_have_no_folds(spark, panel):
    from pyspark.sql import functions as F
    from serieswise.catalog.selection_queries import COLS, TARGET
    from serieswise.plans.search import candidates
    from serieswise.plans.selection import select_per_fold
    from serieswise.plans.walk_forward import score_paths

    df = panel().filter("series_id < 2").withColumn("series_id", F.when(F.col("series_id") > 0, F.col("series_id")))
    for table in (select_per_fold(df, COLS, TARGET, 252, 5), score_paths(df, COLS, "ridge", candidates("ridge", 2), initial=252)):
        assert {r.series_id for r in table.select("series_id").distinct().collect()} == {1}


def test_first_features_of_whole_series_are_arrays(spark):
    """Unknown values, equal ones, zeros, NaN and a one-row series give what windows over blocks give (F27)."""
    from serieswise.operators.blocks import number_rows
    from serieswise.operators.features import features_v1

    rng = np.random.default_rng(5)
    names = ["E18", "M3", "P5", "S2"]
    rows = []
    for series, n in ((1, 300), (2, 1), (3, 40), (None, 30)):
        for day in range(n):
            cells = [None if u < 0.2 else float(v) for u, v in zip(rng.random(4), rng.integers(0, 4, 4) * 0.37)]
            if 100 <= day < 180:
                cells = [0.37, 0.0, 0.37, None]
            if series == 3 and day == 20:
                cells = [float("nan")] * 4
            rows.append((series, day, *cells))
    table = spark.createDataFrame(rows, "series_id long, date_id long, " + ", ".join(f"{c} double" for c in names))

    def run(df):
        return features_v1(df)

    assert "FlatMapGroupsInArrow" in plan_of(run(number_rows(table)))
    got = both_ways(spark, lambda: number_rows(table), lambda df: run(df).drop("_block"), ["series_id", "date_id"])
    assert len(got) == len(rows) and got["M3_rank_pct_w20"].notna().any() and got["P5_mr_z_w30"].notna().any()


def test_first_look_at_a_table_reads_it_once(spark):
    """No part computes the rows again (F26)."""
    from pyspark.sql import functions as F

    from serieswise.operators.profile import basic_eda

    df = spark.range(500).select((F.col("id") % 7).cast("double").alias("M1"), F.col("id").cast("double").alias("M2"))
    parts = basic_eda(df)
    assert not any("Range" in plan_of(part) for part in parts.values())
    assert {r.feature: r.na_count for r in parts["missing"].collect()} == {"M1": 0, "M2": 0}
    assert parts["histograms"].groupBy("feature").sum("count").collect()[0][1] == 500
