"""Windows over series of any length.

``number_rows`` gives every row its dense position and decides how the panel is
worked on. If no series is longer than ``BLOCK_ROWS``, all windows are partitioned
by series: one shuffle serves a whole chain of operators. If one is longer, the
panel gets a ``_block`` column (position // BLOCK_ROWS), every window is
partitioned by ``(series, block)``, and no task ever holds a whole series:

* bounded frames (``rolling``): the last ``back`` rows of a block are copied into
  the next one before the shuffle, so each block sees its full look-back;
* unbounded frames (``scan``): one summary row per block, a window over that
  small table, and a join back on ``(series, block)``.

Both ways give equal results. Operators keep the ``_block`` column of their input.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from serieswise.config import BLOCK, BLOCK_ROWS, DAY, KEYS, POS
from serieswise.session import settle


def longest_group(df: DataFrame, keys: Sequence[str] = KEYS) -> int:
    """Rows of the largest group; counted before the shuffle, one number returned."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


def block_rows(df: DataFrame) -> int:
    """Rows per block, ``serieswise.blockRows`` of the session if set."""
    return int(df.sparkSession.conf.get("serieswise.blockRows", str(BLOCK_ROWS)))


def is_blocked(df: DataFrame) -> bool:
    return BLOCK in df.columns


def number_rows(
    df: DataFrame,
    order: str = DAY,
    bucket: Column | None = None,
    keys: Sequence[str] = KEYS,
    name: str = POS,
    longest: int | None = None,
    unique: bool = False,
) -> DataFrame:
    """Add the dense 0-based position by ``order`` within ``keys``.

    Rows with equal ``order`` follow a hash of their other columns, so that a repeated run numbers them
    alike; ``unique`` says that there are none. ``longest`` is an upper bound of rows per series if the caller
    has one, else they are counted. Long series are cut into ranges of (order, hash), whatever the type
    of ``order`` and however its values bunch; a caller whose rows fall into buckets of bounded size that do
    not decrease with ``order`` passes them as ``bucket``, which saves looking for the ranges.
    """
    rows, size = df.drop(name), block_rows(df)
    if longest is None:
        longest = longest_group(rows, keys)
    others = [c for c in rows.columns if c not in (*keys, order, BLOCK)]
    tie = F.lit(0).cast("long") if unique or not others else F.xxhash64(*others)
    if longest <= size:
        by = [order] if unique else [F.col(order), tie]
        at = F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) - 1
        return rows.drop(BLOCK).withColumn(name, at.cast("long"))
    block = F.floor(F.col(name) / F.lit(size))
    if bucket is None:
        return _numbered_by_ranges(rows.drop(BLOCK), order, tie, keys, name, 16 * size).withColumn(BLOCK, block)
    at = [*keys, "_bucket"]
    parts = settle(rows.withColumn("_bucket", bucket).drop(BLOCK))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy(*at).agg(F.count(F.lit(1)).alias("_rows")).select(
        *at, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start")
    )
    inside = F.row_number().over(Window.partitionBy(*at).orderBy(order, tie))
    numbered = parts.join(starts, at).withColumn(name, (F.col("_start") + inside - 1).cast("long"))
    return numbered.drop("_bucket", "_start").withColumn(BLOCK, block)


def _numbered_by_ranges(df: DataFrame, order: str, tie: Column, keys: Sequence[str], name: str, part_rows: int) -> DataFrame:
    """Positions from the place in a range partition plus the rows of the series in the partitions before.

    Spark cuts (keys, order, hash) at sampled quantiles, so a series, a day or a single instant with
    most of the rows is as many partitions as it needs; none is sorted in one task.
    """
    rows = settle(df)
    by = [*[F.col(k) for k in keys], F.col(order), F.col("_tie")]
    parts = max(8, -(-rows.count() // part_rows))
    ranged = rows.withColumn("_tie", tie).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_tie")
    # the id holds the partition and the place in it; the written table fixes it
    placed = settle(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    counts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")
    starts = counts.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_part").alias("_of_part"), start.alias("_start"))
    same = placed["_part"] == starts["_of_part"]
    for k in keys:
        same = same & placed[k].eqNullSafe(starts[f"_of_{k}"])
    return placed.join(starts, same).select(*df.columns, (F.col("_at") + F.col("_start")).cast("long").alias(name))


def renumber(df: DataFrame, keys: Sequence[str] = KEYS, unique: bool = False) -> DataFrame:
    """Close the gaps a row filter left in the positions; ``unique`` says that none occurs twice in a series."""
    longest = block_rows(df) + 1 if is_blocked(df) else 0
    rows = df.withColumnRenamed(POS, "_at")
    bucket = F.col(BLOCK) if is_blocked(df) else None
    return number_rows(rows, "_at", bucket, keys, POS, longest, unique).drop("_at")


class Span:
    """A frame whose aggregates are computed once, however often a formula uses them."""

    def __init__(self, spec: WindowSpec, parts: dict[str, tuple[str, Column]]):
        self.spec, self.parts = spec, parts

    def of(self, agg: Column) -> Column:
        column = agg.over(self.spec)
        name, _ = self.parts.setdefault(str(column), (f"_w{len(self.parts)}", column))
        return F.col(name)


class Frames:
    """Windows handed to the column builders of ``rolling``."""

    def __init__(self, ordered: WindowSpec):
        self.ordered = ordered  # for lag / lead
        self.parts: dict[str, tuple[str, Column]] = {}

    def rows(self, start: int, end: int) -> Span:
        return Span(self.ordered.rowsBetween(start, end), self.parts)

    def last(self, n: int) -> Span:
        return self.rows(-(n - 1), 0)

    def shifted(self, column: Column) -> Column:
        """A lag or lead that several formulas share."""
        return Span(self.ordered, self.parts).of(column)


def _with_frames(df: DataFrame, build: Callable[[Frames], dict[str, Column]], ordered: WindowSpec) -> DataFrame:
    frames = Frames(ordered)
    made = build(frames)
    parts = df.select("*", *[column.alias(name) for name, column in frames.parts.values()])
    kept = [c for c in df.columns if c not in made]
    return parts.select(*kept, *[c.alias(n) for n, c in made.items()])


def rolling(
    df: DataFrame,
    build: Callable[[Frames], dict[str, Column]],
    back: int,
    ahead: int = 0,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Add columns whose frames reach ``back`` rows back and ``ahead`` forward."""
    if not is_blocked(df):
        return _with_frames(df, build, Window.partitionBy(*keys).orderBy(POS))
    size = block_rows(df)
    own = F.floor(F.col(POS) / F.lit(size))
    inside = F.col(POS) - own * size
    # a row goes to every later block whose first row looks back to it, and to earlier ones that look ahead
    reach = lambda rows: range(1, -(-rows // size) + 1)
    targets = [own, *[F.when(inside >= m * size - back, own + m) for m in reach(back)]]
    targets += [F.when((inside < ahead - (m - 1) * size) & (own >= m), own - m) for m in reach(ahead)]
    spread = df.drop(BLOCK).withColumn(BLOCK, F.explode(F.array_compact(F.array(*targets))))
    framed = _with_frames(spread, build, Window.partitionBy(*keys, BLOCK).orderBy(POS))
    return framed.filter(F.col(BLOCK) == own)


class Scan(NamedTuple):
    """An unbounded frame.

    ``direct``: the result from the running and the whole frame of a series. For
    long series: ``summary`` are aggregates of one block, ``prepare`` columns the
    summary table needs first, ``carry`` expressions over earlier blocks or all
    blocks of it, ``value`` the result from the running frame inside the block and
    the carried columns.
    """

    direct: Callable[[WindowSpec, WindowSpec], Column]
    summary: dict[str, Column]
    carry: Callable[[WindowSpec, WindowSpec], dict[str, Column]]
    value: Callable[[WindowSpec], Column]
    prepare: Callable[[WindowSpec], dict[str, Column]] = lambda whole: {}


def scan(df: DataFrame, scans: dict[str, Callable[[str], Scan]], keys: Sequence[str] = KEYS) -> DataFrame:
    """Add columns whose frames start at the first row of the series."""
    made = {name: make(f"_{i}") for i, (name, make) in enumerate(scans.items())}
    kept = [c for c in df.columns if c not in made]
    start, end = Window.unboundedPreceding, Window.unboundedFollowing
    if not is_blocked(df):
        running = Window.partitionBy(*keys).orderBy(POS).rowsBetween(start, 0)
        whole = Window.partitionBy(*keys).orderBy(POS).rowsBetween(start, end)
        return df.select(*kept, *[s.direct(running, whole).alias(n) for n, s in made.items()])
    at = [*keys, BLOCK]
    blocks = settle(df)
    by_block = Window.partitionBy(*keys).orderBy(BLOCK)
    prior, whole = by_block.rowsBetween(start, -1), by_block.rowsBetween(start, end)
    summary = blocks.groupBy(*at).agg(*[c.alias(n) for s in made.values() for n, c in s.summary.items()])
    ready = {n: c for s in made.values() for n, c in s.prepare(whole).items()}
    summary = summary.select("*", *[c.alias(n) for n, c in ready.items()])
    carried = {n: c for s in made.values() for n, c in s.carry(prior, whole).items()}
    carry = summary.select(*at, *[c.alias(n) for n, c in carried.items()])
    running = Window.partitionBy(*at).orderBy(POS).rowsBetween(start, 0)
    return blocks.join(carry, at).select(*kept, *[s.value(running).alias(n) for n, s in made.items()])


def _foldable(agg: Callable[..., Column], x: Column, join: Callable[[Column, Column], Column], zero: Column | None):
    """Scan whose block results combine like its values do."""

    def make(tag: str) -> Scan:
        total, start = f"{tag}_block", f"{tag}_start"

        def carry(prior: WindowSpec, whole: WindowSpec) -> dict[str, Column]:
            earlier = agg(F.col(total)).over(prior)
            return {start: earlier if zero is None else F.coalesce(earlier, zero)}

        return Scan(
            lambda running, whole: agg(x).over(running),
            {total: agg(x)},
            carry,
            lambda running: join(agg(x).over(running), F.col(start)),
        )

    return make


def running_product(x: Column) -> Callable[[str], Scan]:
    return _foldable(F.product, x, lambda a, b: a * b, F.lit(1.0))


def running_sum(x: Column) -> Callable[[str], Scan]:
    return _foldable(F.sum, x, lambda a, b: a + b, F.lit(0.0))


def running_max(x: Column) -> Callable[[str], Scan]:
    return _foldable(F.max, x, F.greatest, None)


def last_known(x: Column, lead_in: bool = False) -> Callable[[str], Scan]:
    """Forward fill; ``lead_in`` also fills leading gaps with the first value."""

    def make(tag: str) -> Scan:
        last, first = f"{tag}_last", f"{tag}_first"
        held, opening = f"{tag}_held", f"{tag}_opening"
        at = F.when(x.isNotNull(), F.col(POS))
        summary = {last: F.max_by(x, at)}
        if lead_in:
            summary[first] = F.min_by(x, at)

        def direct(running: WindowSpec, whole: WindowSpec) -> Column:
            filled = F.last(x, ignorenulls=True).over(running)
            return F.coalesce(filled, F.first(x, ignorenulls=True).over(whole)) if lead_in else filled

        def carry(prior: WindowSpec, whole: WindowSpec) -> dict[str, Column]:
            out = {held: F.last(last, ignorenulls=True).over(prior)}
            if lead_in:
                out[opening] = F.first(first, ignorenulls=True).over(whole)
            return out

        def value(running: WindowSpec) -> Column:
            parts = [F.last(x, ignorenulls=True).over(running), F.col(held)]
            return F.coalesce(*parts, *([F.col(opening)] if lead_in else []))

        return Scan(direct, summary, carry, value)

    return make


def expanding_std(x: Column) -> Callable[[str], Scan]:
    """Sample deviation of all rows so far.

    Blocks are merged by count, mean and squared deviation, centred on the mean
    of the first block, so that neither a large common level nor a constant
    stretch costs precision.
    """

    def make(tag: str) -> Scan:
        n, mean, m2, base = f"{tag}_n", f"{tag}_mean", f"{tag}_m2", f"{tag}_base"
        rows, shift, square = f"{tag}_rows", f"{tag}_shift", f"{tag}_square"
        off = F.coalesce(F.col(mean) - F.col(base), F.lit(0.0))

        def value(running: WindowSpec) -> Column:
            here, before = F.count(x).over(running), F.col(rows)
            own = F.coalesce(F.var_pop(x).over(running), F.lit(0.0)) * here
            earlier = F.greatest(F.col(square) - F.col(shift) * F.col(shift) / before, F.lit(0.0))
            gap = F.avg(x).over(running) - (F.col(base) + F.col(shift) / before)
            both = (before > 0) & (here > 0)
            across = F.when(both, gap * gap * before * here / (before + here)).otherwise(F.lit(0.0))
            total = own + F.when(before > 0, earlier).otherwise(F.lit(0.0)) + across
            return F.when(before + here > 1, F.sqrt(total / (before + here - 1)))

        return Scan(
            lambda running, whole: F.stddev_samp(x).over(running),
            {n: F.count(x), mean: F.avg(x), m2: F.coalesce(F.var_pop(x), F.lit(0.0)) * F.count(x)},
            lambda prior, whole: {
                base: F.col(base),
                rows: F.coalesce(F.sum(n).over(prior), F.lit(0)),
                shift: F.coalesce(F.sum(F.col(n) * off).over(prior), F.lit(0.0)),
                square: F.coalesce(F.sum(F.col(m2) + F.col(n) * off * off).over(prior), F.lit(0.0)),
            },
            value,
            lambda whole: {base: F.first(mean, ignorenulls=True).over(whole)},
        )

    return make


def whole_series(agg: Column, merge: Callable[[Column], Column], keys: Sequence[str] | None = None) -> Callable[[str], Scan]:
    """An aggregate of the whole series on every row; ``merge`` joins block results.

    With ``keys`` the rows of a series are left in any order, which saves the sort by position.
    """

    def make(tag: str) -> Scan:
        part, full = f"{tag}_part", f"{tag}_full"
        return Scan(
            lambda running, whole: agg.over(whole if keys is None else Window.partitionBy(*keys)),
            {part: agg},
            lambda prior, whole: {full: merge(F.col(part)).over(whole)},
            lambda running: F.col(full),
        )

    return make
