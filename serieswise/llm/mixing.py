"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent and normalised. The exponent is bisected:
entropy of the weights falls with it, so a target entropy has one solution; a limit on
repetition asks for the smallest exponent at which no source is read more often than the
limit. The weights are then realised: a source gives whole copies of itself and, for the rest
of its token budget, a prefix of its permuted blocks, the last block cut at a document.

Blocks hold a bounded number of rows, so a source with a third of all rows is cut into many
and no task orders a whole source: only block totals are accumulated per source.

A null source is a source of its own; a null text has no tokens and belongs to its block. Equal
documents are separate rows. Sources without tokens get weight 0 but their rows, which cost
nothing, are given once. An empty table gives an empty result. Input columns named like a
result column are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serieswise.llm.common import ceil_div, identified, sheltered, stage

BLOCK_ROWS = 2_000
BROADCAST_SOURCES = 100_000
#: Beyond this exponent only the largest sources are left.
MOST_EXPONENT = 4096.0
RESULT = ["weight", "copy", "block", "place", "n_tokens"]


def tempered(shares: np.ndarray, exponent: float) -> np.ndarray:
    """Shares to the exponent, normalised; a share of 0 stays 0."""
    known = shares > 0
    logs = np.where(known, exponent * np.log(np.where(known, shares, 1.0)), -np.inf)
    raised = np.exp(logs - logs.max()) if known.any() else shares
    return raised / raised.sum() if known.any() else raised


def entropy(weights: np.ndarray) -> float:
    w = weights[weights > 0]
    return float(-(w * np.log(w)).sum())


def solve_exponent(shares: np.ndarray, target_entropy: float | None = None, max_repeats: float | None = None, keep_all: bool = True) -> float:
    """The smallest exponent that meets the targets, by bisection; 1 leaves the shares as they are, 0 makes them equal.

    Entropy falls with the exponent, over 1 too, where large sources gain; repetition falls up to 1 and rises
    beyond. With both targets the larger exponent of the two holds, and if it repeats too much, or no exponent has so
    little entropy, there is no answer and a ValueError says so. `keep_all` says how repetition is
    counted: against the budget at which the most reduced source is read once (True), or against a budget of
    all tokens (False).
    """
    known = shares > 0
    if not known.any():
        return 0.0

    def even(a: float) -> bool:
        rate = tempered(shares, a)[known] / shares[known]
        return max_repeats is None or (rate.max() / rate.min() if keep_all else rate.max()) <= max_repeats + 1e-9

    def narrow(a: float) -> bool:
        return target_entropy is None or entropy(tempered(shares, a)) <= target_entropy + 1e-12

    def least(fits, low: float, high: float) -> float:
        if fits(low):
            return low
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (low, middle) if fits(middle) else (middle, high)
        return high

    if not even(1.0):
        raise ValueError(f"no exponent keeps repetition at {max_repeats}")
    top = 1.0
    while not narrow(top):
        top *= 2
        if top > MOST_EXPONENT:
            raise ValueError(f"no exponent brings the entropy to {target_entropy}")
    exponent = max(least(even, 0.0, 1.0), least(narrow, 0.0, top))
    if not even(exponent):
        raise ValueError(f"at entropy {target_entropy} a source is repeated more than {max_repeats} times")
    return exponent


def whitespace_tokens(text: str = "text") -> Column:
    words = F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.array_remove(words, "")).cast("long")


def mix(
    docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None,
    tokens: Column | None = None, seed: int = 11,
) -> DataFrame:
    """Rows of the mixture: the documents, repeated or left out, with their source's weight.

    Without a `budget` in tokens, the mixture is as large as it must be for every source to be
    read at least once. `copy` counts the times a document is given (from 0), `block` and
    `place` order a copy of a source: blocks are permuted within it and rows within a block.
    """
    if tokens is not None:
        docs = docs.withColumn("n_tokens", tokens)
    needed = ("source", "text") if tokens is None else ("source", "n_tokens")
    results = RESULT if tokens is None else [c for c in RESULT if c != "n_tokens"]
    made = sheltered(docs, needed, results, lambda d: _mix(d, target_entropy, max_repeats, budget, seed))
    return made.select(*[c for c in made.columns if c not in RESULT], *RESULT)


def _mix(docs: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: int | None, seed: int) -> DataFrame:
    rows = identified(docs, "_at", "mixing")
    size = F.col("n_tokens") if "n_tokens" in docs.columns else whitespace_tokens()
    # everything is decided on these few numbers a row; the documents are only joined to the result
    slim = stage(rows.select("_at", "source", size.alias("n_tokens")), "mixing-rows")
    totals = slim.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()
    total = sum(r["t"] for r in totals)
    shares = np.array([r["t"] / total if total else 0.0 for r in totals])
    weights = tempered(shares, solve_exponent(shares, target_entropy, max_repeats, budget is None))
    if budget is None:
        rates = weights[shares > 0] / shares[shares > 0]
        budget = total / rates.min() if total else 0.0
    plan = []
    for r, w in zip(totals, weights):
        want = float(w) * budget
        full = int(math.floor(want / r["t"] + 1e-9)) if r["t"] else 1
        rest = max(0, int(math.floor(want - full * r["t"] + 1e-6))) if r["t"] else 0
        plan.append((r["source"], float(w), full, rest, ceil_div(r["n"], BLOCK_ROWS)))
    spark = docs.sparkSession
    # one row a source; beyond the limit the join shuffles
    sources = spark.createDataFrame(plan, f"_source {docs.schema['source'].dataType.simpleString()}, weight double, _full int, _rest long, _blocks int")
    if len(plan) <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    slim = slim.join(sources, F.col("source").eqNullSafe(F.col("_source")))
    slim = slim.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "_at"), F.col("_blocks")).cast("int"))
    # copies 0 to _full - 1 are whole; copy _full is the one that the rest of the budget cuts
    blocks = slim.groupBy("source", "block").agg(F.sum("n_tokens").alias("_t"))
    order = F.xxhash64(F.lit(seed), F.lit("blocks"), "source", "block")
    earlier = Window.partitionBy("source").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        F.col("source").alias("_s"), F.col("block").alias("_b"), F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_start")
    )
    key = F.xxhash64(F.lit(seed), F.lit("rows"), "_at")
    inside = Window.partitionBy("source", "block").orderBy(key, "_at")
    ranked = slim.withColumn("place", F.row_number().over(inside) - 1).withColumn(
        "_upto", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    placed = ranked.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    partial = (F.col("_start") + F.col("_upto") <= F.col("_rest")) & (F.col("_rest") > 0)
    times = F.col("_full") + F.when(partial, 1).otherwise(0)
    given = placed.select(F.col("_at").alias("_of"), "weight", "block", "place", F.col("n_tokens").alias("_size"), times.alias("_times")).where("_times > 0")
    whole = rows.drop("n_tokens").join(given, F.col("_at") == F.col("_of")).withColumnRenamed("_size", "n_tokens")
    return whole.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
