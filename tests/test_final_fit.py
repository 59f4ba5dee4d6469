"""Steps of the final fit: the panel's plan, its rounding, rank correlations of columns side by side."""

import pytest
from pyspark.sql import functions as F

from serieswise.catalog.base import quick_rnd, rnd
from serieswise.operators import frames
from serieswise.operators.correlation import long_pairs, spearman_ic
from serieswise.operators.features import features_v2
from serieswise.operators.ordered import spearman
from serieswise.sources.fixtures import fx_panel


def test_engineered_panel_is_sorted_by_day_and_by_position_only(spark, sf_dir):
    df = frames.split_holdout(features_v2(fx_panel(spark, sf_dir))[0])
    assert df._jdf.queryExecution().executedPlan().toString().count("Sort [") == 2


def test_quick_rounding_equals_decimal_rounding(spark):
    x = [0.0, 2.5e-6, -2.5e-6, 1.0000005, 1.00000049999999, 0.1234565, 3e5 + 5e-7, 1e12 + 0.1, float("nan"), float("inf"), None]
    rows = spark.createDataFrame([(v,) for v in x], "x double").union(
        spark.range(3000).select(((F.col("id") - 1500) * 5e-7 + F.rand(1) * 3e-9 * (F.col("id") % 3)).alias("x"))
    )
    other = rows.filter(~quick_rnd("x", 6).eqNullSafe(rnd("x", 6)))
    assert other.count() == 0


@pytest.mark.parametrize("days", [7, 5000])
def test_rank_correlations_of_columns_meet_no_exploded_rows(spark, days):
    of = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m)).cast("double")
    gap = lambda c, k: F.when(of(k, 5) > 0, c)
    rows = spark.range(700).select(gap(of(1, days), 2).alias("y"), gap(of(1, 9) + of(3, 9), 4).alias("a"), of(5, 900).alias("b"), F.lit(1.0).alias("c"), F.lit(None).cast("double").alias("d")).checkpoint()
    cols = ["a", "b", "c", "d"]
    small = {r.feature: (r.n, r.ic) for r in spearman(long_pairs(rows, cols, "y"), ["feature"]).collect()}
    spark.conf.set("serieswise.smallGroup", "60")
    try:
        found = spearman_ic(rows, cols, "y")
        large = {r.feature: (r.n, r.ic) for r in found.collect()}
    finally:
        spark.conf.unset("serieswise.smallGroup")
    assert large.keys() == small.keys() == {"a", "b", "c"} and large["c"][1] is None and small["c"][1] is None
    for c in ("a", "b"):
        assert large[c][0] == small[c][0] and large[c][1] == pytest.approx(small[c][1], abs=1e-12)
