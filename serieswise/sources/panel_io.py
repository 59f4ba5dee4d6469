"""Reading panels, and writing and re-reading result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from serieswise.config import DAY, KEYS
from serieswise.functions.scalar import finite
from serieswise.operators.blocks import number_rows


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    for path in paths:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {list(paths)} exists")


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = (T.DoubleType, T.FloatType)
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, floats)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols}) if cols else df


def read_panel(
    spark: SparkSession,
    paths: Sequence[str],
    schema: T.StructType | str | None = None,
    rename: dict[str, str] | None = None,
    order: str = DAY,
    bucket: Column | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """First existing CSV or Parquet path as a panel: NaN to null, position added.

    CSV needs a schema; a table without the series key becomes one series.
    """
    path = first_existing(spark, paths)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if path.rstrip("/").endswith(".csv"):
        df = reader.option("header", True).csv(path)
    else:
        df = reader.parquet(path)
    df = nan_to_null(df.withColumnsRenamed(rename or {}))
    for key in keys:
        if key not in df.columns:
            df = df.withColumn(key, F.lit(0).cast("long"))
    return number_rows(df, order=order, bucket=bucket, keys=keys)


def write_tables(tables: dict[str, DataFrame], folder: str, partition_by: dict[str, str] | None = None) -> None:
    """One Parquet dataset per table name; a repeated call replaces it."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        column = (partition_by or {}).get(name)
        (writer.partitionBy(column) if column else writer).parquet(f"{folder}/{name}")


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV dataset, a file per partition, each with a header."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def finite_numbers(df: DataFrame) -> DataFrame:
    """Non-finite numbers to null, as JSON has no such values."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: finite(F.col(c)) for c in cols}) if cols else df


def write_report(df: DataFrame, path: str) -> None:
    finite_numbers(df).write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A report written earlier; a missing one is an error that names it."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no report at {path}; run the step that writes it first")
    return spark.read.schema(schema).json(path)


RUNS = "run string, kind string, key string, value double"


def append_run(df: DataFrame, run: str, kind: str, path: str) -> None:
    """Put the numeric columns of one-row ``df`` into the run table as (run, kind, key, value).

    The rows of a run and kind are a partition that is replaced whole when the job commits: a repeated or
    retried call leaves one copy, other runs are untouched.
    """
    if not run or not kind:
        raise ValueError("a run and its kind need names")
    cells = [
        F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in df.columns
    ]
    rows = df.select(F.explode(F.array(*cells)).alias("_c")).select(
        F.lit(run).alias("run"), F.lit(kind).alias("kind"), "_c.*"
    )
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run", "kind").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run table; names stay text even where all look like numbers."""
    return spark.read.schema(RUNS).parquet(path).select("run", "kind", "key", "value")
