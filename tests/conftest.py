from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from serieswise.session import local_session

    session = local_session(8, partitions=4)
    session.sparkContext.setLogLevel("OFF")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture()
def tiny_blocks(spark):
    """Blocks of 128 rows and groups of 60: every long-series and large-group path."""
    spark.conf.set("serieswise.blockRows", "128")
    spark.conf.set("serieswise.smallGroup", "60")
    yield
    spark.conf.unset("serieswise.blockRows")
    spark.conf.unset("serieswise.smallGroup")


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture()
def frame(spark):
    """Panel from lists: one series, positions by list order."""

    def make(**columns):
        n = len(next(iter(columns.values())))
        rows = [(0, i, i, *[None if c[i] is None else float(c[i]) for c in columns.values()]) for i in range(n)]
        fields = ", ".join(["series_id long", "date_id long", "pos long", *[f"{c} double" for c in columns]])
        return spark.createDataFrame(rows, fields)

    return make


def column(df, name):
    return [r[name] for r in df.orderBy("series_id", "date_id").collect()]
