"""Merkle manifest of a dataset with a proof for every row, by butterfly exchange.

A row's leaf is the sha256 of its columns, each written as `-` if null and else as its length in
bytes, a colon and the value. Within a group, rows are ordered by a key; every FANOUT consecutive
nodes (the last run may be shorter, even one) become the sha256 of their digests until one node,
the group's subroot, is left, and the subroots in the order of the groups likewise give the root.
A proof is, for each level, the digests left and right of a row's branch.

1. Leaves, without their texts, are range-partitioned by (group, key) and written once; a row's
   number is its place in its part plus the rows of the group in the parts before.
2. Blocks of FANOUT ** LOCAL consecutive leaves build their subtree in one row, and the lower
   part of the proofs with it.
3. Butterfly: in round r the blocks whose numbers differ only in digit r, to the base FANOUT, swap
   the roots of their aligned groups of FANOUT ** r blocks. Every block hashes their parent itself,
   all blocks of a group the same one, so it holds both its ancestor and the siblings beside it:
   after the last round it has the subroot and all of its upper proof, and nothing is passed down
   the tree. A last, ragged group has fewer members than partners; its members answer for the missing
   numbers too, at most one extra row a block.
4. The groups' subroots are numbered and take the same rounds.

One shuffle a round moves a block's number, digest and proof so far; no task ever holds more than
FANOUT rows of one key, and a group with a third of all rows is as many blocks as it needs.

A null key or group comes first, and rows with equal keys are ordered by their leaf; rows equal in all
columns are told apart by their place. Null and empty texts differ in the leaf. A single row is its
group's subroot, a single subroot the root. An empty table has no manifest rows. Only the named columns
are read; names of other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serieswise.llm.common import ceil_div, stage

FANOUT = 8
#: Levels that one block builds: 512 leaves.
LOCAL = 3
#: Leaves that one part of the order holds.
PART_ROWS = 200_000
LEAST_PARTS = 8


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


def _hash(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def _beside(nodes: Column, at: Column, fanout: int) -> Column:
    """(left, right): the digests beside node `at` in its run, each side joined."""
    run = F.floor(at / fanout).cast("int") * fanout
    side = lambda start, length: F.array_join(F.slice(nodes, start + 1, length), "")
    return F.struct(side(run, at - run).alias("left"), side(at + 1, run + F.lit(fanout - 1) - at).alias("right"))


def fold(digest: Column, path: Column) -> Column:
    """The ancestor that a digest and the siblings of its path give."""
    return F.aggregate(path, digest, lambda held, s: F.sha2(F.concat(s["left"], held, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def numbered(rows: DataFrame, group: str, order: Sequence[str], purpose: str) -> DataFrame:
    """Rows with `place`, dense from 0 within the group (nulls first), and `total`, the group's rows.

    Rows that tie in `order` are told apart by where they were. The result reads a written table.
    """
    n = rows.count()
    marked = rows.withColumn("_at", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in (group, *order, "_at")]
    parts = marked.repartitionByRange(ceil_div(n, PART_ROWS, LEAST_PARTS), *by).sortWithinPartitions(*by)
    # the id holds the part and the place in it, fixed by writing
    written = stage(parts.withColumn("_at", F.monotonically_increasing_id()), purpose).withColumn("_part", F.shiftright("_at", 33))
    counts = written.groupBy(group, "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    of = Window.partitionBy(group)
    before = of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(group).alias("_group"), F.col("_part").alias("_own"), (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(of).alias("total"),
    )
    same = written[group].eqNullSafe(starts["_group"]) & (written["_part"] == starts["_own"])
    kept = [c for c in written.columns if c not in ("_at", "_part")]
    return written.join(starts, same).select(*kept, (F.col("_at") + F.col("_shift")).alias("place"), "total")


def butterfly(blocks: DataFrame, group: str, fanout: int) -> DataFrame:
    """(group, block, count, digest) with the digest of each group's last ancestor and the path to it.

    `block` is dense from 0 in its group and `count` the group's blocks. Every round is one shuffle
    by (group, aligned group of the next level, number inside the group of this level).
    """
    most = blocks.agg(F.max("count")).first()[0] or 0
    rows = blocks.withColumn("path", F.array().cast("array<struct<left:string,right:string>>"))
    size = 1  # blocks in a full aligned group of this round
    while size < most:
        at, count = F.col("block"), F.col("count")
        mine, inside = F.floor(at / size).cast("long"), (at % size).cast("long")
        active = count > size
        # a last group with fewer members answers for the numbers it lacks
        members = F.least(F.lit(size), count - mine * size)
        partner = F.when(active, F.sequence(inside, F.lit(size - 1).cast("long"), members.cast("long"))).otherwise(F.array(inside))
        sent = rows.withColumn("_inside", F.explode(partner)).withColumn("_over", F.floor(at / (size * fanout)).cast("long"))
        swap = Window.partitionBy(group, "_over", "_inside")
        heard = sent.withColumn("_heard", F.transform(F.array_sort(F.collect_list(F.struct(mine.alias("at"), F.col("digest").alias("digest"))).over(swap)), lambda x: x["digest"]))
        own = heard.where(F.col("_inside") == inside)
        siblings = F.array(_beside(F.col("_heard"), (mine % fanout).cast("int"), fanout))
        rows = own.select(
            group, "block", "count",
            F.when(active, _hash(F.col("_heard"))).otherwise(F.col("digest")).alias("digest"),
            F.when(active, F.concat("path", siblings)).otherwise(F.col("path")).alias("path"),
        )
        size *= fanout
    return rows


def _with_levels(blocks: DataFrame, fanout: int, local: int) -> DataFrame:
    """Add level0 (the leaves) to the last local level; a group of one block ends where one node is left."""
    rows = blocks.withColumn("level0", F.transform("entries", lambda e: e["leaf"]))
    for level in range(local):
        below = F.col(f"level{level}")
        runs = F.sequence(F.lit(0), F.ceil(F.size(below) / fanout).cast("int") - 1)
        up = F.transform(runs, _run_hash(below, fanout))
        rows = rows.withColumn(f"level{level + 1}", F.when(F.col("total") > fanout**level, up).otherwise(below))
    return rows


def _run_hash(nodes: Column, fanout: int):
    return lambda i: _hash(F.slice(nodes, i * fanout + 1, fanout))


def manifest(
    df: DataFrame, columns: Sequence[str], order: str, group: str, claimed: dict[str, Column] | None = None, fanout: int = FANOUT, local: int = LOCAL
) -> DataFrame:
    """One row for each of `df`: order and group, leaf, claimed_leaf, subroot, root and path.

    `path` holds the siblings from the leaf to the root. `claimed` gives other values of columns, whose leaf is
    `claimed_leaf` (else equal to the leaf): what a holder of the row says it is.
    """
    values = [F.col(c) for c in columns]
    other = [(claimed or {}).get(c, F.col(c)) for c in columns]
    leaves = df.select(F.col(order).alias("key"), F.col(group).alias("group"), leaf(values).alias("leaf"), leaf(other).alias("claimed_leaf"))
    size = fanout**local
    # written before the order samples them, so that the rows are hashed once
    placed = numbered(stage(leaves, "hashed"), "group", ["key", "leaf", "claimed_leaf"], "leaves")
    entry = F.struct("place", "key", "leaf", "claimed_leaf")
    grouped = placed.groupBy("group", F.floor(F.col("place") / size).cast("long").alias("block"), "total").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    held = stage(_with_levels(grouped, fanout, local).drop("level0"), "subtrees")
    leaves_of = F.transform("entries", lambda e: e["leaf"])
    last = F.col(f"level{local}") if local else leaves_of
    blocks = held.select("group", "block", F.ceil(F.col("total") / size).cast("long").alias("count"), last[0].alias("digest"))
    # used for the groups' subroots and for the paths
    upper = stage(butterfly(blocks, "group", fanout), "upper")

    subroots = numbered(upper.where("block = 0").select("group", "digest", F.lit(0).alias("_all")), "_all", ["group"], "subroots")
    tops = butterfly(subroots.select("_all", "group", "digest", F.col("place").alias("block"), F.col("total").alias("count")).drop("group"), "_all", fanout)
    tops = tops.select(F.col("block").alias("_place"), F.col("digest").alias("root"), F.col("path").alias("_top"))
    named = subroots.select(F.col("group").alias("_of"), F.col("digest").alias("subroot"), F.col("place").alias("_at")).join(tops, F.col("_at") == F.col("_place"))

    above = upper.select(F.col("group").alias("_group"), F.col("block").alias("_block"), F.col("path").alias("_upper"))
    whole = held.join(above, held["group"].eqNullSafe(above["_group"]) & (held["block"] == above["_block"]))
    whole = whole.join(named, whole["group"].eqNullSafe(named["_of"]))

    whole = whole.withColumn("level0", leaves_of)

    def of_entry(entry: Column, i: Column) -> Column:
        lower = F.array(*[
            F.when(F.col("total") > fanout**level, _beside(F.col(f"level{level}"), F.floor(i / fanout**level).cast("int"), fanout))
            for level in range(local)
        ])
        path = F.concat(F.array_compact(lower), F.col("_upper"), F.col("_top")) if local else F.concat("_upper", "_top")
        return F.struct(entry["key"].alias("key"), entry["leaf"].alias("leaf"), entry["claimed_leaf"].alias("claimed_leaf"), path.alias("path"))

    rows = whole.select("group", "subroot", "root", F.explode(F.transform("entries", of_entry)).alias("_row"))
    return rows.select(
        F.col("_row.key").alias(order), F.col("group").alias(group), "_row.leaf", "_row.claimed_leaf", "subroot", "root", "_row.path"
    )
