"""Every query with an SQL twin, and the long-series paths against the same SQL."""

import pytest
from check import connect, differences

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

LONG_PATHS = [
    "score_v2", "map_positions", "drawdown", "ffill", "features_v2", "spike_clean", "ic_metrics", "trim_leading_empty",
    "split_three_way", "folds_expanding", "chunk_returns", "residual_table", "backtest_single", "sequence_windows_before",
    "auc_acc", "roc_points", "spearman_ic", "describe", "outlier_rate_iqr", "context_tail", "sort_series",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLES[name]).df()) == []


@pytest.mark.parametrize("name", LONG_PATHS)
def test_long_series_equal_sql(spark, con, sf_dir, tiny_blocks, name):
    assert differences(QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLES[name]).df()) == []


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0].asDict().keys() == {"series_id", "n", "status", "adjusted_sharpe"}
