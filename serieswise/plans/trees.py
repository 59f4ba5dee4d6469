"""Trees over binned columns: boosted classifiers from the counts of cells, and forests from histograms that Spark sums.

A tree tells the bins of a column apart, not its values. Rows of equal bins are one cell, and those of a cell
and label share their error in every round of boosting, so the rounds need the counts of rows only. What a round
draws of the rows of a cell and label is a binomial number. The method is that of Spark ML's ``GBTClassifier``: logistic
loss, a first tree of the labels themselves, best splits by variance, columns drawn at each node.

A forest draws its rows by Poisson numbers, tree by tree. Each level of all trees is one job: a task sums the drawn rows
and targets of its rows by tree, node, column and bin, and the sums of a tree meet in one group. The numbers come from the
tree and the place of the rows, so no count is kept by row; one is exact to a part in 65,536.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieswise import config as C

#: Ranges of a column that a tree tells apart, Spark ML's ``maxBins``.
BINS = 32


@dataclass
class Tree:
    """Nodes of a tree: column, last bin to the left, left child (the right one follows) and value. A leaf is its own left child."""

    column: np.ndarray
    last: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int

    def predict(self, bins: np.ndarray) -> np.ndarray:
        """Value of each row of ``bins``."""
        flat, start, at = bins.ravel(), np.arange(len(bins)) * bins.shape[1], np.zeros(len(bins), np.int64)
        for _ in range(self.depth):
            at = self.left.take(at) + (flat.take(start + self.column.take(at)) > self.last.take(at))
        return self.value.take(at)


def trees_json(trees: Sequence[Tree]) -> str:
    return json.dumps([[t.column.tolist(), t.last.tolist(), t.left.tolist(), t.value.tolist(), t.depth] for t in trees])


def trees_of(text: str) -> list[Tree]:
    return [Tree(*map(np.array, nodes[:4]), depth=nodes[4]) for nodes in json.loads(text)]


def best_splits(
    counts: np.ndarray, sums: np.ndarray, least: float, allowed: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether each node splits, its column and last bin to the left, and the means to the left and right.

    ``counts`` and ``sums`` hold the rows and targets by node, column and bin; both sides keep ``least`` rows. The first
    of equal gains counts.
    """
    left_n, left_s = np.cumsum(counts, axis=2), np.cumsum(sums, axis=2)
    total_n, total_s = left_n[:, :1, -1:], left_s[:, :1, -1:]
    left_n, left_s = left_n[:, :, :-1], left_s[:, :, :-1]
    right_n, right_s = total_n - left_n, total_s - left_s
    fits = (left_n >= max(least, 1)) & (right_n >= max(least, 1)) & allowed[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = left_s * left_s / left_n + right_s * right_s / right_n
        gain = apart - total_s * total_s / total_n
    # what rounding alone leaves is no gain
    gain = np.where(fits & (gain > 1e-12 * apart), gain, 0.0).reshape(len(counts), -1)
    best, at = gain.argmax(axis=1), np.arange(len(counts))
    splits, width = gain[at, best] > 0, left_n.shape[2]
    column, last = best // width, best % width
    with np.errstate(divide="ignore", invalid="ignore"):
        means = left_s[at, column, last] / left_n[at, column, last], right_s[at, column, last] / right_n[at, column, last]
    return splits, column, last, *means


def drawn_columns(rng: np.random.Generator, nodes: int, width: int, share: float) -> np.ndarray:
    """The columns that each node may split by: a share of all, rounded up."""
    if share >= 1:
        return np.ones((nodes, width), bool)
    return rng.random((nodes, width)).argsort(axis=1) < math.ceil(share * width)


def grown_tree(
    bins: np.ndarray, counts: np.ndarray, sums: np.ndarray, depth: int, least: float, share: float, rng: np.random.Generator
) -> tuple[Tree, np.ndarray]:
    """A regression tree of cells, and its value for each; those without rows only learn their value."""
    n, width = bins.shape
    total = counts.sum()
    root = sums.sum() / total if total else 0.0
    column, last, left, value = [np.zeros(1, np.int64)], [np.array([BINS])], [np.zeros(1, np.int64)], [np.array([root])]
    said, first = np.full(n, root), 0  # ``first``: number of the level's first node
    rows, node, w, s = np.arange(n), np.zeros(n, np.int64), counts, sums
    columns = [bins[:, j].astype(np.int64) for j in range(width)]
    for _ in range(depth):
        nodes = len(column[-1])
        size, base = nodes * BINS, node * BINS
        at = [base + c for c in columns]
        each = lambda v: np.stack([np.bincount(a, v, size).reshape(nodes, BINS) for a in at], axis=1)
        splits, by, until, low, high = best_splits(each(w), each(s), least, drawn_columns(rng, nodes, width, share))
        if not splits.any():
            break
        place = np.cumsum(splits) - 1
        column[-1], last[-1] = np.where(splits, by, 0), np.where(splits, until, BINS)
        left[-1] = np.where(splits, first + nodes + 2 * place, left[-1])
        first += nodes
        if not splits.all():
            stay = splits[node]
            rows, node, w, s = rows[stay], node[stay], w[stay], s[stay]
            columns = [c[stay] for c in columns]
        node = 2 * place[node] + (bins[rows, by[node]] > until[node])
        values = np.column_stack([low[splits], high[splits]]).ravel()
        said[rows] = values[node]
        column.append(np.zeros(len(values), np.int64))
        last.append(np.full(len(values), BINS))
        left.append(first + np.arange(len(values)))
        value.append(values)
    return Tree(*(np.concatenate(part) for part in (column, last, left, value)), depth=len(column) - 1), said


def boosted_trees(
    bins: np.ndarray, up: np.ndarray, down: np.ndarray, rounds: int, depth: int = 5, rate: float = 0.1, least: int = 1,
    draw: float = 1.0, share: float = 1.0, seed: Sequence[int] = (C.SEED,),
) -> tuple[list[Tree], np.ndarray]:
    """Trees of a boosted classifier from the rows of both labels in each cell, and the probability of an up label in each.

    A cell may be without rows. The trees after the first weigh ``rate``; a round draws a share ``draw`` of the rows,
    and a node a share ``share`` of the columns.
    """
    rng = np.random.default_rng(list(seed))
    margin, trees = np.zeros(len(bins)), []
    of_up, of_down = up.astype(np.int64), down.astype(np.int64)
    for i in range(rounds):
        a, b = (rng.binomial(of_up, draw), rng.binomial(of_down, draw)) if draw < 1 else (of_up, of_down)
        if i:
            with np.errstate(over="ignore"):
                errors = a * (4 / (1 + np.exp(2 * margin))) - b * (4 / (1 + np.exp(-2 * margin)))
        else:
            errors = (a - b).astype(float)
        tree, said = grown_tree(bins, (a + b).astype(float), errors, depth, least, share, rng)
        margin += said * (rate if i else 1.0)
        trees.append(tree)
    return trees, probability(margin)


def boosting(params: dict[str, float]) -> dict[str, float]:
    """Arguments of ``boosted_trees`` from the names of the search."""
    given = {"max_depth": "depth", "learning_rate": "rate", "min_child": "least", "subsample": "draw", "colsample": "share"}
    return {given[name]: value for name, value in params.items()}


def merged_cells(bins: pa.Table, parts: Sequence[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct cells in order, and the sum of ``rows`` of each for every mask of ``parts``."""
    cells, at = np.unique(np.column_stack([c.to_numpy() for c in bins.columns]).astype(np.uint8), axis=0, return_inverse=True)
    return cells, [np.bincount(at.ravel()[mask], rows[mask], len(cells)) for mask in parts]


def probability(margin: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-2 * margin))


def counted_auc(score: np.ndarray, up: np.ndarray, down: np.ndarray) -> float | None:
    """Area under the ROC curve of ``up`` and ``down`` rows of each score, from average ranks."""
    values, at = np.unique(score, return_inverse=True)
    up, down = np.bincount(at, up, len(values)), np.bincount(at, down, len(values))
    n, p = (up + down).sum(), up.sum()
    if not p * (n - p):
        return None
    ranks = np.cumsum(up + down) - (up + down) + (up + down + 1) / 2
    return float(((up * ranks).sum() - p * (p + 1) / 2) / (p * (n - p)))


# rows whose bins a task compares to find equal ones, and rows of unlike bins that it sums at a time
CHUNK, PART = 1 << 19, 1 << 16
#: Bins of one long.
PACKED = 12


def packed(into: Sequence[str]) -> list[Column]:
    """The bins of up to ``PACKED`` columns as a long each."""
    groups = [into[i : i + PACKED] for i in range(0, len(into), PACKED)]
    return [reduce(Column.__add__, [F.col(b).cast("long") * F.lit(BINS**j) for j, b in enumerate(g)]).alias(f"_x_code{i}") for i, g in enumerate(groups)]


def unpacked(codes: Sequence[np.ndarray], width: int) -> np.ndarray:
    """Bins by column and row."""
    return np.stack([(codes[j // PACKED] >> (5 * (j % PACKED)) & (BINS - 1)).astype(np.uint8) for j in range(width)])


def poisson_table() -> np.ndarray:
    """Poisson numbers of mean 1 for the 65,536 values of two random bytes."""
    share = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(share, (np.arange(65_536) + 0.5) / 65_536).astype(float)


def histogram_bytes(trees: int, depth: int, width: int) -> int:
    """Bytes of the sums of all trees on their last level."""
    return trees * 2 ** max(depth - 1, 0) * width * BINS * 16


def _level_sums(
    batches: Iterator[pa.RecordBatch], width: int, level: int, splits: list[tuple[np.ndarray, np.ndarray]], seed: int, table: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Drawn rows and targets of a task's rows by tree, node of the level, column and bin; a row a tree."""
    first, nodes = 2**level - 1, 2**level
    sums = np.zeros((len(splits), 2, width, nodes * BINS))
    place, found = TaskContext.get().partitionId(), 0

    def add(tree: int, bins: np.ndarray, w: np.ndarray, s: np.ndarray) -> None:
        column, last = splits[tree]
        node, at, flat = np.zeros(len(w), np.int64), np.arange(len(w)), bins.ravel()
        for _ in range(level):
            by = column.take(node)
            inner = by >= 0
            if not inner.all():
                node, at, by = node[inner], at[inner], by[inner]
            node = 2 * node + 1 + (flat.take(by * bins.shape[1] + at) > last.take(node))
        if len(at) < len(w):
            w, s = w[at], s[at]
        base = (node - first) * BINS
        for j in range(width):
            cell = base + (bins[j] if len(at) == bins.shape[1] else bins[j][at])
            sums[tree, 0, j] += np.bincount(cell, w, nodes * BINS)
            sums[tree, 1, j] += np.bincount(cell, s, nodes * BINS)

    def draw(tree: int, part: int, n: int) -> np.ndarray:
        rng = np.random.Generator(np.random.SFC64([seed, tree, place, found, part]))
        return table[rng.integers(0, 65_536, n, np.uint16)]

    def chunk(held: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(held)
        codes, y = [rows.column(i).to_numpy() for i in range(rows.num_columns - 1)], rows.column(rows.num_columns - 1).to_numpy()
        if len(codes) == 1:
            order = np.argsort(codes[0], kind="stable")
            code = codes[0][order]
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            if len(starts) < len(y) / 2:  # rows of equal bins go the same way: their drawn sums first
                bins, own = unpacked([code[starts]], width), y[order]
                for tree in range(len(splits)):
                    w = draw(tree, 0, len(y))
                    add(tree, bins, np.add.reduceat(w, starts), np.add.reduceat(w * own, starts))
                return
        for part, begin in enumerate(range(0, len(y), PART)):
            bins, own = unpacked([c[begin : begin + PART] for c in codes], width), y[begin : begin + PART]
            for tree in range(len(splits)):
                w = draw(tree, part, len(own))
                drawn = np.flatnonzero(w)
                w = w.take(drawn)
                add(tree, bins.take(drawn, axis=1), w, w * own.take(drawn))

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            chunk(held)
            held, size, found = [], 0, found + 1
    if size:
        chunk(held)
    elif not found:
        return
    for tree in range(len(splits)):
        yield pa.record_batch({"tree": pa.array([tree], pa.int32()), "sums": pa.array([sums[tree].tobytes()], pa.binary())})


def grown_forest(
    rows: DataFrame, width: int, trees: int, depth: int = 5, least: int = 1, share: float = 1.0, seed: int = C.SEED,
    table: np.ndarray | None = None,
) -> list[Tree]:
    """Trees of a regression forest over ``rows`` of packed bins and, last, the target. A level of all trees is one job.

    ``rows`` are written, as their places seed the draws; ``table`` holds how often a row is drawn by two random bytes.
    """
    table = poisson_table() if table is None else table
    size = 2 ** (depth + 1) - 1
    column, last, value = np.full((trees, size), -1), np.full((trees, size), BINS), np.zeros((trees, size))
    for level in range(depth):
        splits = [(column[t], last[t]) for t in range(trees)]
        at = slice(2**level - 1, 2 ** (level + 1) - 1)
        below = slice(2 ** (level + 1) - 1, 2 ** (level + 2) - 1)

        def best(table: pa.Table) -> pa.Table:
            tree = table.column("tree")[0].as_py()
            parts = (np.frombuffer(v.as_py()) for v in table.column("sums"))
            counts, sums = reduce(np.add, parts).reshape(2, width, 2**level, BINS).swapaxes(1, 2)
            rng = np.random.default_rng([seed, tree, level])
            found = best_splits(counts, sums, least, drawn_columns(rng, 2**level, width, share))
            root = sums[0, 0].sum() / max(counts[0, 0].sum(), 1.0)
            kinds = [pa.list_(t) for t in (pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            arrays = {n: pa.array([v.tolist()], k) for n, v, k in zip(("splits", "by", "until", "low", "high"), found, kinds)}
            return pa.table({"tree": pa.array([tree], pa.int32()), "root": pa.array([root], pa.float64()), **arrays})

        # a row a tree and task, of the sums of a level
        summed = rows.mapInArrow(partial(_level_sums, width=width, level=level, splits=splits, seed=seed, table=table), "tree int, sums binary")
        fields = "tree int, root double, splits array<boolean>, by array<long>, until array<long>, low array<double>, high array<double>"
        for r in summed.groupBy("tree").applyInArrow(best, fields).collect():
            t, split = r["tree"], np.array(r["splits"])
            if not level:
                value[t, 0] = r["root"]
            column[t, at], last[t, at] = np.where(split, r["by"], -1), np.where(split, r["until"], BINS)
            value[t, below] = np.where(np.repeat(split, 2), np.column_stack([r["low"], r["high"]]).ravel(), 0.0)
        if not (column[:, at] >= 0).any():
            break
    own = np.arange(size)
    return [Tree(np.maximum(c, 0), n, np.where(c >= 0, 2 * own + 1, own), v, depth) for c, n, v in zip(column, last, value)]


class BinnedTrees(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Prediction from columns of bins: the mean of all trees or, of boosted ones, the probabilities of both labels as a vector."""

    trees = Param(Params._dummy(), "trees", "nodes of all trees, as JSON", TypeConverters.toString)
    rate = Param(Params._dummy(), "rate", "weight of boosted trees after the first", TypeConverters.toFloat)

    def __init__(self, cols: Sequence[str] = (), output: str = "prediction", trees: str = "[]", rate: float | None = None) -> None:
        super().__init__()
        self._set(trees=trees, inputCols=list(cols), outputCol=output, **({} if rate is None else {"rate": rate}))

    def _transform(self, df: DataFrame) -> DataFrame:
        cols, trees = self.getInputCols(), trees_of(self.getOrDefault(self.trees))
        rate = self.getOrDefault(self.rate) if self.isSet(self.rate) else None

        def values(bins: np.ndarray) -> np.ndarray:
            total = np.zeros(len(bins))
            for i, tree in enumerate(trees):
                total += tree.predict(bins) * (rate if rate is not None and i else 1.0)
            return total / len(trees) if rate is None else probability(total)

        def said(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            # what the trees say of the cells met so far, where all that can be fit
            known = np.full(BINS ** len(cols), np.nan) if BINS ** len(cols) <= 1 << 20 else None
            for columns in batches:
                bins = np.column_stack([c.to_numpy() for c in columns]).astype(np.uint8)
                if known is None:
                    yield pd.Series(values(bins))
                    continue
                code = bins.astype(np.int64) @ BINS ** np.arange(len(cols))
                new = np.unique(code[np.isnan(known[code])])
                known[new] = values(unpacked([new], len(cols)).T.copy())
                yield pd.Series(known[code])

        out = F.pandas_udf(said, "double")(*[F.col(c) for c in cols])
        if rate is not None:
            return df.withColumn("_x_up", out).withColumn(self.getOutputCol(), array_to_vector(F.array(1 - F.col("_x_up"), F.col("_x_up")))).drop("_x_up")
        return df.withColumn(self.getOutputCol(), out)
