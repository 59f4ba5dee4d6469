"""Order statistics without sorting a whole column in one task.

Groups that fit one task use plain windows and aggregates. For larger ones
``value_ranks`` counts each distinct value before anything is shuffled, cuts the
value range at approximate quantiles and numbers values inside their slice, and
``exact_quantiles`` brackets each quantile by a sketch and sorts only the
bracket. Both are exact; sketches only decide where rows go.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serieswise.config import BLOCK
from serieswise.operators.blocks import is_blocked, longest_group
from serieswise.operators.frames import one_row, safe_corr, stacked
from serieswise.session import settle

SLICES = 256
SMALL_GROUP = 1_000_000
# distinct values with their ranks that every task may hold
FEW_VALUES = 100_000


def small_group(df: DataFrame) -> int:
    """Rows one task may sort as one group, ``serieswise.smallGroup`` of the session if set."""
    return int(df.sparkSession.conf.get("serieswise.smallGroup", str(SMALL_GROUP)))


STEP = 16


def _every_step(cuts: Column) -> Column:
    return F.filter(cuts, lambda c, i: i % STEP == STEP - 1)


def _with_steps(cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cut points and every 16th of them, so that a value meets 32 of 256."""
    return cuts.select(*keys, "_cuts", _every_step(F.col("_cuts")).alias("_steps"))


def _slice_of(value: Column, cuts: Column, steps: Column | None = None) -> Column:
    """Number of cut points not above the value, found in two steps of 16."""
    base = F.size(F.filter(_every_step(cuts) if steps is None else steps, lambda c: c <= value)) * STEP
    return base + F.size(F.filter(F.slice(cuts, base + 1, F.lit(STEP)), lambda c: c <= value))


def value_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: dict[str, Column] | None = None,
    largest: int | None = None,
    descending: bool = False,
    counted: bool = False,
) -> DataFrame:
    """One row per distinct value: ``cnt`` rows, ``less`` rows before it, ``total``.

    ``counted`` says that ``df`` already holds one row per distinct value with its ``cnt``.

    ``sums`` adds further totals per value with their ``<name>_less`` and
    ``<name>_total``. ``largest`` is an upper bound of rows per group, counted if
    not given; only groups larger than ``small_group`` are cut into slices.
    """
    sums = sums or {}
    rows = df.filter(F.col(value).isNotNull())
    if largest is None:
        largest = longest_group(rows, keys)
    sliced = largest > small_group(df)
    table = rows if counted else rows.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("cnt"), *[F.sum(c).alias(n) for n, c in sums.items()]
    )
    names, zero = ["cnt", *sums], F.lit(0)
    order = (lambda c: F.col(c).desc()) if descending else F.col
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    rename = lambda n, kind: {"less": "less", "total": "total"}[kind] if n == "cnt" else f"{n}_{kind}"
    if not sliced:
        inside, whole = until(Window.partitionBy(*keys).orderBy(order(value))), Window.partitionBy(*keys)
        return table.select(
            *keys,
            value,
            *names,
            *[F.coalesce(F.sum(n).over(inside), zero).alias(rename(n, "less")) for n in names],
            *[F.sum(n).over(whole).alias(rename(n, "total")) for n in names],
        )
    # the slices hold like numbers of distinct values: those are what is sorted
    table = settle(table)
    probs = [i / SLICES for i in range(1, SLICES)]
    cuts = _with_steps(table.groupBy(*keys).agg(F.percentile_approx(value, probs, 2_000).alias("_cuts")), keys)
    # one row without keys; as literals the cuts would become part of what Spark infers for the joins below
    placed = table.join(cuts, list(keys)) if keys else table.crossJoin(F.broadcast(cuts))
    placed = settle(placed.withColumn("_slice", _slice_of(F.col(value), F.col("_cuts"), F.col("_steps"))).drop("_cuts", "_steps"))
    parts = placed.groupBy(*keys, "_slice").agg(*[F.sum(n).alias(f"_{n}") for n in names])
    earlier = until(Window.partitionBy(*keys).orderBy(order("_slice")))
    whole = Window.partitionBy(*keys)
    starts = parts.select(
        *keys,
        "_slice",
        *[F.coalesce(F.sum(f"_{n}").over(earlier), zero).alias(f"_{n}_start") for n in names],
        *[F.sum(f"_{n}").over(whole).alias(rename(n, "total")) for n in names],
    )
    inside = until(Window.partitionBy(*keys, "_slice").orderBy(order(value)))
    less = [
        (F.col(f"_{n}_start") + F.coalesce(F.sum(n).over(inside), zero)).alias(rename(n, "less")) for n in names
    ]
    totals = [rename(n, "total") for n in names]
    return placed.join(starts, [*keys, "_slice"]).select(*keys, value, *names, *less, *totals)


def average_ranks(
    df: DataFrame, keys: Sequence[str], value: str, name: str, largest: int | None = None
) -> DataFrame:
    """keys, value and its 1-based average rank."""
    ranks = value_ranks(df, keys, value, largest=largest)
    return ranks.select(*keys, value, (F.col("less") + (F.col("cnt") + 1) / 2).alias(name))


def window_rank(keys: Sequence[str], value: str) -> Column:
    """Average rank by plain windows, for groups that fit one task."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (ties - 1) / F.lit(2.0)


def rank_corr() -> Column:
    """Correlation of ``_rx`` and ``_ry``, null where either side is constant."""
    return safe_corr(F.col("_rx"), F.col("_ry"))


def _centred() -> Column:
    """Average rank about the mean rank: sums of squares of large ranks would lose digits."""
    return F.col("less") + (F.col("cnt") + 1) / 2 - (F.col("total") + 1) / 2


def spearman(
    pairs: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y",
    largest: int | None = None,
) -> DataFrame:
    """keys, ``n``, ``ic`` over rows where both values are known.

    Small groups are ranked by windows. Large ones are never joined with the ranks of x: a rank
    belongs to a value, so the products are those of the ranks of the distinct x with the sums of the
    ranks of y beside them. ``pairs`` is read twice, so the caller writes what is costly to make.
    """
    both = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    if largest is None:
        largest = longest_group(both, keys)
    if largest <= small_group(pairs):
        ranked = both.withColumn("_rx", window_rank(keys, x)).withColumn("_ry", window_rank(keys, y))
        return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rank_corr().alias("ic"))
    ranks = settle(value_ranks(both, keys, y, largest=largest).select(*keys, y, "cnt", _centred().alias("_ry")))
    few = ranks.count() <= FEW_VALUES
    sides = ranks.select(*keys, y, "_ry")
    return _rank_products(ranks, both.join(F.broadcast(sides) if few else sides, [*keys, y]), keys, x, largest)


def _rank_products(ranks: DataFrame, beside: DataFrame, keys: Sequence[str], x: str, largest: int) -> DataFrame:
    """keys, ``n``, ``ic`` from the ranks of the distinct y, and the values of x with the rank of y beside them."""
    table = value_ranks(beside, keys, x, {"_s": F.col("_ry")}, largest).withColumn("_rx", _centred())
    square = lambda r: F.sum(F.col("cnt") * F.col(r) * F.col(r))
    sums = table.groupBy(*keys).agg(F.sum("cnt").alias("n"), F.sum(F.col("_rx") * F.col("_s")).alias("_p"), square("_rx").alias("_xx"))
    others = ranks.groupBy(*keys).agg(square("_ry").alias("_yy"))
    both_sums = sums.join(others, list(keys)) if keys else sums.crossJoin(others)
    ic = F.when((F.col("_xx") > 0) & (F.col("_yy") > 0), F.col("_p") / (F.sqrt("_xx") * F.sqrt("_yy")))
    return both_sums.select(*keys, "n", ic.alias("ic"))


def spearman_columns(rows: DataFrame, cols: Sequence[str], y: str, largest: int) -> DataFrame:
    """``feature``, ``n``, ``ic`` of each column with y over rows where both are known, for more rows than one task sorts.

    The columns stay side by side until x is ranked: a row counts once for the ranks of y and meets them once.
    """
    xs = [f"_x{i}" for i in range(len(cols))]
    known = rows.filter(F.col(y).isNotNull()).select(F.col(y).alias("y"), *[F.col(c).cast("double").alias(x) for c, x in zip(cols, xs)])
    counts = known.groupBy("y").agg(*[F.count(x).alias(x) for x in xs])
    each = stacked(counts, [{"feature": F.lit(c), "cnt": F.col(x)} for c, x in zip(cols, xs)], ["y"]).filter("cnt > 0")
    ranked = value_ranks(each, ["feature"], "y", largest=largest, counted=True)
    ranks = settle(ranked.select("feature", "y", "cnt", _centred().alias("_ry")))
    few = ranks.count() <= FEW_VALUES
    sides = ranks.groupBy("y").agg(*[F.max(F.when(F.col("feature") == c, F.col("_ry"))).alias(f"_r{x}") for c, x in zip(cols, xs)])
    met = known.join(F.broadcast(sides) if few else sides, "y")
    cells = [{"feature": F.lit(c), "x": F.col(x), "_ry": F.col(f"_r{x}")} for c, x in zip(cols, xs)]
    return _rank_products(ranks, stacked(met, cells).filter(F.col("x").isNotNull()), ["feature"], "x", largest)


def attach(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Set per-series values beside rows; long series are joined block by block."""
    if not is_blocked(df):
        return df.join(table, list(keys))
    at = [*keys, BLOCK]
    return df.join(df.select(*at).distinct().join(table, list(keys)), at)


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
    accuracy: int = 10_000,
    largest: int | None = None,
    written: bool = False,
) -> DataFrame:
    """keys, feature, prob, n, quantile with linear interpolation.

    Groups up to ``small_group`` rows use the exact aggregate, whose memory grows
    with the distinct values. Beyond, a sketch brackets each quantile and only the
    bracket's values are counted and sorted. ``df`` is read several times: it is written first, unless it
    is ``written`` already.
    """
    if largest is None:
        largest = longest_group(df, keys)
    cells = [(c, i, p) for c in cols for i, p in enumerate(probs)]
    if largest <= small_group(df):
        share = F.array(*[F.lit(float(p)) for p in probs])
        wide = df.groupBy(*keys).agg(
            *[F.percentile(c, share).alias(c) for c in cols], *[F.count(c).alias(f"{c}__n") for c in cols]
        )
        rows = [
            {
                "feature": F.lit(c), "prob": F.lit(float(p)), "n": F.col(f"{c}__n"),
                "quantile": F.col(c)[i].cast("double"),
            }
            for c, i, p in cells
        ]
        return stacked(wide, rows, keys)
    margin = 2.0 / accuracy
    low = [max(p - margin, 0.0) for p in probs]
    high = [min(p + margin, 1.0) for p in probs]
    block = [BLOCK] if keys and is_blocked(df) else []
    typed = df.select(*keys, *block, *[F.col(c).cast("double").alias(c) for c in cols])
    typed = typed if written else settle(typed)
    sketched = typed.groupBy(*keys).agg(
        *[f(c).alias(f"{c}__{n}") for c in cols for n, f in {"n": F.count, "min": F.min, "max": F.max}.items()],
        *[F.percentile_approx(c, [*low, *high], accuracy).alias(f"{c}__at") for c in cols],
    )

    def bracket(c: str, end: str, first: int) -> Column:
        few = F.array(*[F.col(f"{c}__{end}")] * len(probs))
        return F.when(F.col(f"{c}__n") <= accuracy, few).otherwise(F.slice(f"{c}__at", first + 1, len(probs)))

    rough = sketched.select(
        *keys,
        *[F.col(f"{c}__n") for c in cols],
        *[bracket(c, "min", 0).alias(f"{c}__lo") for c in cols],
        *[bracket(c, "max", len(probs)).alias(f"{c}__hi") for c in cols],
    )
    if keys:
        rows = attach(typed, rough, keys)
        side = lambda name: F.col(name)
    else:
        fitted = one_row(rough)
        rows = typed
        side = lambda name: fitted[name]
    rows = rows.select(
        *keys,
        *[
            F.struct(
                F.col(c).alias("v"),
                side(f"{c}__lo")[i].alias("lo"),
                side(f"{c}__hi")[i].alias("hi"),
            ).alias(f"{c}__{i}")
            for c, i, _ in cells
        ],
    )
    inside = [
        F.when(
            F.col(f"{c}__{i}.v").between(F.col(f"{c}__{i}.lo"), F.col(f"{c}__{i}.hi")),
            F.struct(F.lit(c).alias("feature"), F.lit(i).alias("idx"), F.col(f"{c}__{i}.v").alias("value")),
        )
        for c, i, _ in cells
    ]
    picked = (
        rows.select(*keys, F.explode(F.array_compact(F.array(*inside))).alias("_m"))
        .select(*keys, "_m.*")
        .groupBy(*keys, "feature", "idx", "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    below = rows.groupBy(*keys).agg(
        *[F.count_if(F.col(f"{c}__{i}.v") < F.col(f"{c}__{i}.lo")).alias(f"{c}__{i}") for c, i, _ in cells],
        *[F.count(F.col(f"{c}__0.v")).alias(f"{c}__n") for c in cols],
    )
    heads = stacked(
        below,
        [
            {
                "feature": F.lit(c),
                "idx": F.lit(i),
                "prob": F.lit(float(p)),
                "n": F.col(f"{c}__n"),
                "below": F.col(f"{c}__{i}"),
            }
            for c, i, p in cells
        ],
        keys,
    )
    at = [*keys, "feature", "idx"]
    running = Window.partitionBy(*at).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    upto = picked.withColumn("upto", F.sum("cnt").over(running)).drop("cnt")
    want = (F.col("n") - 1) * F.col("prob")
    reached = F.col("below") + F.col("upto")
    return (
        heads.join(upto, at, "left")
        .groupBy(*keys, "feature", "idx", "prob", "n")
        .agg(
            F.min(F.when(reached > F.floor(want), F.col("value"))).alias("_a"),
            F.min(F.when(reached > F.ceil(want), F.col("value"))).alias("_b"),
        )
        .select(
            *keys, "feature", "prob", "n",
            (F.col("_a") + (F.col("_b") - F.col("_a")) * (want - F.floor(want))).alias("quantile"),
        )
    )


def quantile_columns(
    df: DataFrame, cols: Sequence[str], probs: dict[str, float], keys: Sequence[str] = (), largest: int | None = None,
    written: bool = False,
) -> DataFrame:
    """The quantiles pivoted: one row per key, columns ``<col>__<name>`` and ``<col>__n``."""
    table = exact_quantiles(df, cols, list(probs.values()), keys, largest=largest, written=written)
    pick = lambda c, p, v: F.max(F.when((F.col("feature") == c) & (F.col("prob") == p), F.col(v)))
    out = [pick(c, p, "quantile").alias(f"{c}__{n}") for c in cols for n, p in probs.items()]
    first = next(iter(probs.values()))
    return table.groupBy(*keys).agg(*out, *[pick(c, first, "n").alias(f"{c}__n") for c in cols])
