"""A classifier fit on counted cells against the fit on all rows."""

import pytest
from pyspark.sql import functions as F

from serieswise.plans import models


@pytest.fixture()
def labelled(spark):
    """4,000 rows: ``a`` of 20 values, ``b`` of 9 with nulls, ``c`` of many values; zeros and negative ones."""
    of = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    a, b = (of(1, 20) - 7).cast("double"), F.when(of(2, 11) > 0, of(3, 9) / 4)
    up = (a + of(4, 13) > 4).cast("int")
    return spark.range(4000).select("id", a.alias("a"), b.alias("b"), (of(5, 10**9) / 1e8).alias("c"), up.alias("label")).checkpoint()


@pytest.fixture()
def large(spark):
    """Fits of over 100 rows count as large."""
    spark.conf.set("serieswise.smallGroup", "100")
    yield
    spark.conf.unset("serieswise.smallGroup")


def probabilities(model, rows):
    return [r.probability for r in models.predict_probability(model, rows).orderBy("id").collect()]


def test_counted_fit_equals_the_fit_on_all_rows(spark, labelled, large):
    train = labelled.filter("id < 3500")
    counted = models.fit_direction(train, ["a", "b"], "label", n_estimators=6, min_child=150)
    spark.conf.unset("serieswise.smallGroup")
    whole = models.fit_direction(train, ["a", "b"], "label", n_estimators=6, min_child=150)
    # few values: the candidates of both are all of them; leaves hold 150 rows, not cells
    assert counted.stages[-1].totalNumNodes == whole.stages[-1].totalNumNodes
    assert probabilities(counted, labelled) == pytest.approx(probabilities(whole, labelled), abs=1e-9)
    # the rounds read a row a cell
    assert counted.stages[-1].isSet("weightCol") and not whole.stages[-1].isSet("weightCol")


def test_counted_fit_cuts_many_values_at_the_quantiles_of_all_rows(labelled):
    values = models.split_values(labelled, ["c", "a"])
    assert len(values["c"]) == models.BINS - 1 and len(values["a"]) == 19
    below = [labelled.filter(F.col("c") <= v).count() for v in values["c"][::10]]
    assert below == pytest.approx([4000 * (i + 1) / models.BINS for i in range(0, 31, 10)], abs=10)


def test_counted_fit_is_saved_whole(labelled, large, tmp_path):
    model = models.fit_direction(labelled, ["a", "c"], "label", n_estimators=3, min_child=20)
    models.save_model(model, str(tmp_path / "model"))
    assert probabilities(models.load_model(str(tmp_path / "model")), labelled) == probabilities(model, labelled)


def test_fit_with_drawn_rows_reads_rows(labelled, large):
    model = models.fit_direction(labelled, ["a", "b"], "label", n_estimators=2, subsample=0.5)
    assert not model.stages[-1].isSet("weightCol")


def test_counted_fit_of_a_constant_column(labelled, large):
    rows = labelled.withColumn("k", F.lit(3.0))
    one, two = (models.fit_direction(rows, cols, "label", n_estimators=2) for cols in (["a"], ["a", "k"]))
    assert probabilities(one, rows) == pytest.approx(probabilities(two, rows), abs=1e-9)
