"""Helpers shared by the operators: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from serieswise.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Written once to the shared folder and read again, so that every later job sees the same rows."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo: the fold of a document. A null key counts as an empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus


def ceil_div(amount: int | None, size: int, least: int = 1) -> int:
    return max(least, -(-int(amount or 0) // size))


def bounded_sample(rows: DataFrame, bound: int, *keys: str) -> DataFrame:
    """All rows, or, of more than `bound`, about 95 % of that many: those with the smallest hashes of the keys.

    The rows are chosen where they are; nothing is ordered and no task sends more than its share.
    """
    n = rows.count()
    if n <= bound:
        return rows
    cut = max(1, int(0.95 * bound / n * (1 << 30)))
    return rows.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < cut).limit(bound)


def sheltered(df: DataFrame, needed: Collection[str], results: Collection[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `run` makes of `df`, with all columns of `df` under their own names and then the result columns.

    While it runs, columns that it does not need have names of their position, so that none can clash with
    one of its own. Columns of `df` named like a result column are replaced.
    """
    kept = [c for c in df.columns if c not in results]
    names = {c: c if c in needed else f"_own{i}" for i, c in enumerate(kept)}
    out = run(df.select(*[F.col(f"`{c.replace('`', '``')}`").alias(n) for c, n in names.items()]))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], *[c for c in out.columns if c in results])


def _reads_files(df: DataFrame) -> bool:
    """Whether each row is one row of a file: a scan below projections and filters only."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() in ("LogicalRelation", "Relation")


def identified(df: DataFrame, name: str, purpose: str) -> DataFrame:
    """`df` with a row id `name` that is the same in every job.

    Rows read from files are told by their file's number and their place in it. Others are written to the shared
    folder first. The driver sees one path a file, as it does to read them.
    """
    if "_metadata" not in df.columns and _reads_files(df):
        marked = df.select("*", F.col("_metadata.file_path").alias(f"{name}_file"), F.col("_metadata.row_index").alias(f"{name}_row"))
        paths = sorted(r[0] for r in df.select(F.col("_metadata.file_path")).distinct().collect())
        if not paths:
            return df.withColumn(name, F.lit(0).cast("long"))
        files = df.sparkSession.createDataFrame(list(enumerate(paths)), f"`{name}_no` long, `{name}_path` string")
        joined = marked.join(F.broadcast(files), F.col(f"{name}_file") == F.col(f"{name}_path"))  # one row a file
        return joined.select(*df.columns, F.shiftleft(f"{name}_no", 40).bitwiseOR(F.col(f"{name}_row")).alias(name))
    return stage(df.withColumn(name, F.monotonically_increasing_id()), purpose)
