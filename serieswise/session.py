"""Session settings and the shared folder for written tables."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

# Adaptive execution merges small shuffle partitions and splits skewed ones, so
# a high partition count costs little on small inputs.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("serieswise")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        # local inputs are small but window work per row is not: keep tasks for all cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names, which every executor can reach.

    Only a local session without one, as in tests, gets a temporary folder.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="serieswise-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """New folder below the checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage in the checkpoint folder.

    Used where one result feeds several branches that Spark would otherwise
    compute separately.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], T]], most: int = 8) -> list[T]:
    """Results of functions that each run Spark jobs, in order, up to ``most`` of them at a time.

    Small fits leave most of a cluster idle one by one. With ``spark.scheduler.mode`` FAIR each shares
    the executors through its own pool; with FIFO later ones fill what earlier ones leave.
    """
    if len(jobs) < 2:
        return [job() for job in jobs]

    def run(at: int) -> T:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"serieswise-{at % most}")
        try:
            return jobs[at]()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(min(most, len(jobs))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(run), range(len(jobs))))


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once per application: their functions import it by name."""
    context = spark.sparkContext
    if getattr(context, "_serieswise_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="serieswise-package-"), "serieswise.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._serieswise_shipped = True


def shipped(fn):
    """A query that ships the package before it runs."""

    @functools.wraps(fn)
    def run(spark: SparkSession, *args, **kwargs):
        ship_package(spark)
        return fn(spark, *args, **kwargs)

    return run
