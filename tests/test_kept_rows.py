"""Validation rows that are written once give the summary of those that are worked out for each reading."""

import pytest
from pyspark.sql import functions as F

from serieswise.operators.features import features_v2
from serieswise.plans import search
from serieswise.sources.fixtures import fx_panel


@pytest.mark.parametrize("size", [None, 100])
def test_kept_rows_are_written_once(spark, sf_dir, size):
    if size:
        spark.conf.set("serieswise.blockRows", str(size))
    df, made = features_v2(fx_panel(spark, sf_dir))
    df = df.filter("series_id <= 3").persist()
    cols = [c for group in made.values() for c in group]
    tuned = search.tune(df, cols, "ridge", trials=2, initial=150, folds=3).persist()
    run = lambda keep: search.evaluate_tuned(df, cols, "ridge", tuned, initial=150, folds=3, keep=keep)
    (_, lazy_folds, lazy_val, lazy), (_, kept_folds, val, kept) = run(None), run(["date_id"])
    rows = lambda t: [tuple(f"{v:.9g}" if isinstance(v, float) else v for v in r) for r in t.select(sorted(t.columns)).orderBy("series_id").collect()]
    assert rows(kept) == rows(lazy) and len(rows(kept)) > 0
    by_fold = lambda t: rows(t.withColumn("series_id", F.col("series_id") * 10 + F.col("fold")))
    assert by_fold(kept_folds) == by_fold(lazy_folds)
    plan = lambda t: t._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(val) and "Window" not in plan(val) and "Window" in plan(lazy_val)
    wanted = {"series_id", "fold", "date_id", "pos", "role", "forward_returns", "risk_free_rate", "market_forward_excess_returns", "prediction", "position"}
    assert wanted <= set(val.columns) and not set(cols) & set(val.columns) and set(cols) <= set(lazy_val.columns)
    same = [c for c in val.columns if c != "_block"]
    assert val.select(same).exceptAll(lazy_val.select(same)).count() == 0 and val.count() == lazy_val.count()
    spark.conf.unset("serieswise.blockRows")
    df.unpersist()
