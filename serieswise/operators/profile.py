"""Column profiles: one wide pass over the rows, then one row per column."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieswise import config as C
from serieswise.functions.scalar import ratio
from serieswise.operators.frames import feature_columns, one_row, safe_corr, stacked
from serieswise.operators.ordered import exact_quantiles, quantile_columns
from serieswise.session import settle

#: Bandwidths after which a kernel adds less than a double's last place to its peak: exp(-8.5 ** 2 / 2) < 2 ** -52.
REACH = 8.5


def table_shape(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(cols)).cast("long"))


def outlier_rates(df: DataFrame, cols: Sequence[str], k: float = 1.5, guarded: bool = False, written: bool = False) -> DataFrame:
    """Rows outside the quartile fences: count, and rate over all rows incl. null.

    ``guarded``: null for an empty column, 0 where the quartiles coincide.
    """
    q = one_row(quantile_columns(df, cols, {"q1": 0.25, "q3": 0.75}, written=written))
    out = {}
    for c in cols:
        q1, q3 = q[f"{c}__q1"], q[f"{c}__q3"]
        fence = F.lit(k) * (q3 - q1)
        out[c] = (F.col(c) < q1 - fence) | (F.col(c) > q3 + fence)
        if guarded:
            out[c] = out[c] & (q3 != q1)
    flags = df.select(*[out[c].alias(c) for c in cols], *[F.col(c).isNotNull().alias(f"{c}__k") for c in cols])
    counts = flags.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c)).alias(c) for c in cols],
        *[F.count_if(F.col(f"{c}__k")).alias(f"{c}__k") for c in cols],
    )

    def rate(c: str) -> Column:
        share = ratio(F.col(c), F.col("_rows"))
        return F.when(F.col(f"{c}__k") > 0, share) if guarded else share

    return stacked(
        counts,
        [{"feature": F.lit(c), "outlier_count": F.col(c), "outlier_rate": rate(c)} for c in cols],
    )


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per column."""
    simple = df.agg(
        *[
            f(c).alias(f"{c}__{n}")
            for c in cols
            for n, f in {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}.items()
        ]
    )
    table = stacked(
        simple,
        [
            {
                "feature": F.lit(c),
                "count": F.col(f"{c}__count"),
                **{n: F.col(f"{c}__{n}").cast("double") for n in ("mean", "std", "min", "max")},
            }
            for c in cols
        ],
    )
    parts = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    pick = lambda p: F.max(F.when(F.col("prob") == p, F.col("quantile")))
    quartiles = parts.groupBy("feature").agg(
        pick(0.25).alias("q25"), pick(0.5).alias("q50"), pick(0.75).alias("q75")
    )
    return table.join(quartiles, "feature")


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """mean, median, and skew and excess kurtosis with sample correction."""
    simple = df.agg(
        *[
            f(c).alias(f"{c}__{n}")
            for c in cols
            for n, f in {"n": F.count, "mean": F.avg, "g1": F.skewness, "g2": F.kurtosis}.items()
        ]
    )

    def row(c: str) -> dict[str, Column]:
        n, g1, g2 = (F.col(f"{c}__{k}") for k in ("n", "g1", "g2"))
        skew = ratio(g1 * F.sqrt(n * (n - 1)), n - 2)
        kurt = ratio(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
        return {
            "feature": F.lit(c),
            "mean": F.col(f"{c}__mean"),
            "skew": F.when(n > 2, skew),
            "kurtosis": F.when(n > 3, kurt),
        }

    medians = exact_quantiles(df, cols, [0.5]).select("feature", F.col("quantile").alias("median"))
    return stacked(simple, [row(c) for c in cols]).join(medians, "feature")


def histogram(df: DataFrame, col: str, bins: int | None = None) -> DataFrame:
    """Equal-width bins with counts, empty ones too; ``None`` takes min(150, int(2 n^(1/3))) bins."""
    return histograms(df, [col], bins).drop("feature")


def histograms(df: DataFrame, cols: Sequence[str], bins: int | None = None) -> DataFrame:
    """feature, bin, left_edge, count of several columns in one pass; a column without values has no bins."""
    s = df.agg(
        *[f(c).alias(f"{c}__{n}") for c in cols for n, f in {"lo": F.min, "hi": F.max, "n": F.count}.items()]
    )
    edges = stacked(
        s,
        [
            {"feature": F.lit(c), "lo": F.col(f"{c}__lo").cast("double"), "hi": F.col(f"{c}__hi").cast("double"), "n": F.col(f"{c}__n")}
            for c in cols
        ],
    ).filter("n > 0")
    flat = F.col("lo") == F.col("hi")
    count = F.lit(bins) if bins else F.least(F.lit(150), F.floor(2 * F.pow("n", F.lit(1 / 3))))
    edges = edges.select(
        "feature", count.cast("long").alias("k"),
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    ).withColumn("w", (F.col("hi") - F.col("lo")) / F.col("k"))
    known = {r["feature"]: r for r in edges.collect()}  # a row a column
    over = {c: F.floor((F.col(c).cast("double") - F.lit(r["lo"])) / F.lit(r["w"])) for c, r in known.items()}
    # least() skips nulls
    place = {c: F.when(F.col(c).isNotNull(), F.least(over[c], F.lit(r["k"] - 1))).cast("long") for c, r in known.items()}
    cells = [{"feature": F.lit(c), "bin": b} for c, b in place.items()]
    every = edges.select("feature", "lo", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("bin"))
    counts = every.select("feature", "bin").limit(0).withColumn("count", F.lit(0).cast("long"))
    if cells:
        counts = stacked(df, cells).filter("bin is not null").groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("count"))
    return every.join(counts, ["feature", "bin"], "left").select(
        "feature", "bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("left_edge"), F.coalesce("count", F.lit(0)).cast("long").alias("count")
    )


def density_curve(df: DataFrame, col: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density with Scott bandwidth on a grid from min to max; null without spread.

    A kernel is counted within REACH bandwidths, beyond which it is lost beside its peak. Every value goes
    to its nearest grid point; a task sums the kernels at each offset from there and sends a row a grid
    point, so rows are neither copied nor shuffled.
    """
    if points < 2:
        raise ValueError("a grid has at least two points")
    value = F.col(col).cast("double")
    s = df.agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"), F.stddev_samp(value).alias("sd")
    ).first()
    lo, n = s["lo"] or 0.0, s["n"]
    step = ((s["hi"] or 0.0) - lo) / (points - 1)
    h = (s["sd"] or 0.0) * max(n, 1) ** -0.2
    grid = df.sparkSession.range(0, points if n else 0, 1, 1).select(
        F.col("id").alias("point"), (F.lit(lo) + F.col("id") * F.lit(step)).alias("x")
    )
    if h == 0 or step == 0:
        return grid.withColumn("density", F.lit(None).cast("double"))
    most = min(points - 1, math.ceil(REACH * h / step + 0.5))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(points + 2 * most)
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False)
            near = np.minimum(np.floor((v - lo) / step + 0.5), points - 1).astype(np.int64)
            rest = v - (lo + near * step)
            for m in range(-most, most + 1):
                z = (rest - m * step) / h
                weight[m + most : m + most + points] += np.bincount(near, np.exp(-z * z / 2), points)
        inside = weight[most : most + points]
        at = np.flatnonzero(inside)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(inside[at])], ["point", "weight"])

    reached = df.filter(value.isNotNull()).select(value.alias("v")).mapInArrow(summed, "point long, weight double")
    sums = reached.groupBy("point").agg(F.sum("weight").alias("weight"))
    return grid.join(sums, "point", "left").select(
        "point", "x", (F.coalesce("weight", F.lit(0.0)) / F.lit(n * h * math.sqrt(2 * math.pi))).alias("density")
    )


def nullity_corr(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Correlation of null indicators over columns that are partly null."""
    gap = {c: F.col(c).isNull().cast("double") for c in cols}
    pairs = list(combinations(cols, 2))
    wide = df.agg(
        *[F.avg(gap[c]).alias(c) for c in cols],
        *[safe_corr(gap[a], gap[b]).alias(f"{a}__{b}") for a, b in pairs],
    )
    part = lambda c: (F.col(c) > 0) & (F.col(c) < 1)
    rows = [
        {
            "feature_1": F.lit(a),
            "feature_2": F.lit(b),
            "corr": F.when(part(a) & part(b), F.col(f"{a}__{b}")),
        }
        for a, b in pairs
    ]
    return stacked(wide, rows).filter(F.col("corr").isNotNull())


def missing_over_time(df: DataFrame, cols: Sequence[str], buckets: int = 100) -> DataFrame:
    """Null rate per column and time bucket of the positions, all series together."""
    s = one_row(df.agg((F.max(C.POS) + 1).alias("n")))
    rows = df.withColumn("bucket", F.floor(F.col(C.POS) * buckets / s["n"]))
    wide = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    )
    return stacked(
        wide, [{"feature": F.lit(c), "null_rate": ratio(F.col(c), F.col("_rows"))} for c in cols], ["bucket"]
    )


def label_distribution(df: DataFrame, label: Column) -> DataFrame:
    counts = df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = one_row(counts.agg(F.sum("n").alias("n")))
    return counts.select("label", "n", ratio(F.col("n"), total["n"]).alias("share"))


def null_cell_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    values = F.array(*[F.col(c) for c in cols])
    return counts.select(
        F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v).alias("null_cells"),
        F.size(F.filter(values, lambda v: v > 0)).cast("long").alias("columns_with_nulls"),
    )


def variance_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    wide = df.agg(*[F.var_pop(c).alias(c) for c in cols])
    return stacked(wide, [{"feature": F.lit(c), "variance": F.col(c)} for c in cols])


def cluster_groups(cols: Sequence[str]) -> dict[str, list[str]]:
    """Prefix -> columns; momentum names do not count as market dynamics."""
    out = {}
    for prefix in C.PREFIXES:
        mom = prefix == "MOM"
        hit = [c for c in cols if c.startswith(prefix) and (mom or not c.startswith("MOM"))]
        if hit:
            out[prefix] = hit
    return out


def cluster_means(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Row mean of standardised columns per prefix group, nulls skipped."""
    s = one_row(
        df.agg(
            *[F.avg(c).alias(f"{c}__m") for c in cols], *[F.stddev_pop(c).alias(f"{c}__s") for c in cols]
        )
    )
    z = df.withColumns({f"{c}__z": ratio(F.col(c) - s[f"{c}__m"], s[f"{c}__s"]) for c in cols})

    def mean(group: list[str]) -> Column:
        parts = [F.col(f"{c}__z") for c in group]
        total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
        known = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
        return ratio(total, known)

    return z.withColumns({f"mean_{g}": mean(group) for g, group in cluster_groups(cols).items()}).drop(
        *[f"{c}__z" for c in cols]
    )


def rows_per_day(df: DataFrame) -> DataFrame:
    return df.groupBy(C.DAY).agg(F.count(F.lit(1)).alias("n_rows"))


def basic_eda(df: DataFrame, top_n: int = 30, bins: int = 40) -> dict[str, DataFrame]:
    """Missing and outlier summaries and the histograms of the worst columns."""
    cols = feature_columns(df) + [c for c in C.FINANCE_COLS if c in df.columns]
    from serieswise.operators.frames import names, null_rates

    # every part reads the rows, some of them several times
    df = settle(df.select(*cols))
    outliers = settle(outlier_rates(df, cols, written=True))
    top = names(outliers.orderBy(F.desc("outlier_rate"), "feature").limit(top_n))
    return {"missing": null_rates(df, cols), "outliers": outliers, "histograms": histograms(df, top, bins)}
