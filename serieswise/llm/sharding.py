"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The row counts of the partitions and the wanted shard sizes fix the margins of a matrix; its
entries, how many rows go from each partition to each shard, are drawn from the multivariate
hypergeometric law that a uniform permutation of all rows would give. Each partition then
permutes its rows locally and cuts the permutation by its matrix row, the rows are exchanged,
and every shard permutes again. Any order of all rows is equally likely, shard sizes differ
by one at most, and no shard is sorted in one task: the second permutation ranks random keys
within key ranges and adds the counts of the ranges before.

The rows are written to the shared folder first, with their partition and place, so a lost
executor cannot change what the matrix was drawn for. The driver holds one row of `shards`
counts for each input partition, as it holds the tasks themselves.

Null texts and null or repeated ids need no special case, for no column is looked at. An empty
table gives an empty result. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from serieswise.llm.common import ceil_div, sheltered, stage

#: Rows whose keys are ranked together in the second permutation.
RANGE_ROWS = 20_000
LEAST_RANGES = 16


def communication_matrix(rows: np.ndarray, shards: np.ndarray, seed: int) -> np.ndarray:
    """Rows that go from each partition to each shard; margins are exact."""
    rng, left = np.random.default_rng(seed), shards.astype(np.int64).copy()
    matrix = np.zeros((len(rows), len(shards)), np.int64)
    for p, n in enumerate(rows):
        rest = int(n)
        total = int(left.sum())
        for s in range(len(shards) - 1):  # one hypergeometric draw a shard, conditional on those before
            total -= int(left[s])
            matrix[p, s] = rng.hypergeometric(left[s], total, rest) if rest else 0
            rest -= matrix[p, s]
        matrix[p, -1] = rest
        left -= matrix[p]
    return matrix


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """Rows of `df` with shard (0 to shards - 1) and slot (0, 1, ... within the shard)."""
    return sheltered(df, (), ("shard", "slot"), lambda rows: _shuffle(rows, shards, seed))


def _shuffle(df: DataFrame, shards: int, seed: int) -> DataFrame:
    own = df.columns
    staged = stage(
        df.select(*own, F.monotonically_increasing_id().alias("_at")), "shards"
    ).withColumn("_part", F.shiftright("_at", 33).cast("int")).withColumn("_place", F.col("_at").bitwiseAND((1 << 33) - 1))
    counts = {r["_part"]: r["n"] for r in staged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    parts = sorted(counts)
    n = sum(counts.values())
    sizes = np.full(shards, n // shards)
    sizes[: n % shards] += 1
    rows = np.array([counts[p] for p in parts], np.int64)
    drawn = dict(zip(parts, communication_matrix(rows, sizes, seed)))

    def destinations(part: pd.Series, place: pd.Series) -> pd.Series:
        out = np.empty(len(part), np.int32)
        part, place = part.to_numpy(), place.to_numpy()
        for p in np.unique(part):
            # the local permutation: a shuffled list of the partition's destinations
            if held.get("p") != p:
                order = np.repeat(np.arange(shards, dtype=np.int32), drawn[p])
                np.random.default_rng([seed, int(p)]).shuffle(order)
                held.update(p=p, order=order)
            mine = part == p
            out[mine] = held["order"][place[mine]]
        return pd.Series(out)

    held: dict = {}
    to = F.pandas_udf(destinations, "int")(F.col("_part"), F.col("_place"))
    ranges = ceil_div(n, shards * RANGE_ROWS, LEAST_RANGES)
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("second"), F.col("_at")), 1)
    width = (1 << 63) // ranges + 1
    sent = staged.withColumn("shard", to).withColumn("_key", key).withColumn("_range", F.expr(f"int(_key DIV {width})"))
    filled = sent.groupBy("shard", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = filled.select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = sent.withColumn("_rank", F.row_number().over(Window.partitionBy("shard", "_range").orderBy("_key", "_at")))
    placed = ranked.join(starts, ["shard", "_range"])
    return placed.select(*own, "shard", (F.col("_start") + F.col("_rank") - 1).cast("long").alias("slot"))
