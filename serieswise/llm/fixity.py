"""Merkle fixity audit of WARC archives.

A replica is a table of records with the file they are in and their bytes. Records are hashed, and
each replica's offsets are those of its own bytes: running sums of the lengths in a file's order,
or the `position` that the table gives. Records of one file that are alike in id and bytes are one
row with the number of its `copies`. The digests of a fixed range of offsets, in order, make a
leaf; sixteen neighbours make a node of the next level, up to a root for each file, and sixteen
files of neighbouring numbers make a node, up to one root for the replica. Two replicas are
compared from their roots down: equal replicas end there, and else only children of nodes that
differ are looked at, so that matching branches are never joined.

A lost or a surplus record shifts the offsets behind it, so that all later ranges of its file
differ. Inside differing ranges records are therefore matched by file, id and digest, wherever they
lie: those that only moved are not reported. Equal ranges hold the same records on both sides, so
leaving them out changes no balance. Of the records left over, one expected and one actual content
of the same id, in equal numbers, are one altered record; others are missing or extra.

Null bytes count as empty, a null file as file -1 and a null position as 0. Records without an id
cannot be told to be altered: they are missing and extra. A file's order is by id, then by digest.
An empty replica has no nodes; against it every record is missing. Equal replicas give no rows.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serieswise.llm.common import stage

RANGE_BYTES = 65_536
FANOUT_BITS = 4
#: Hex digits of a digest that cut the records of one id into parts, to be numbered apart.
PART_DIGITS = 3


def warc_records(pages: DataFrame, per_file: int = 1000) -> DataFrame:
    """(file, record_id, bytes): one response record a page, `per_file` ids to a file."""
    body = F.coalesce("html", F.lit(""))
    size = F.octet_length(body).cast("string")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    record = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), page, F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce("url", F.lit("")), F.lit("\r\nContent-Length: "), size, F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )
    return pages.select(
        F.coalesce(F.floor(F.col("page_id") / per_file), F.lit(-1)).cast("long").alias("file"),
        F.col("page_id").cast("long").alias("record_id"), record.alias("bytes"),
    )


def _laid_out(runs: DataFrame) -> DataFrame:
    """The runs with the offset of their first record.

    Lengths are summed for each part of an id before a file is put in order, so that a file's window has
    at most 16 ** PART_DIGITS rows an id, and an id that a large share of the records has is numbered part by part.
    """
    part, size = F.substring("digest", 1, PART_DIGITS), F.col("length") * F.col("copies")
    runs = runs.withColumn("part", part)
    before = Window.partitionBy("file").orderBy("record_id", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = runs.groupBy("file", "record_id", "part").agg(F.sum(size).alias("size"))
    starts = parts.select(
        F.col("file").alias("f"), F.col("record_id").alias("r"), F.col("part").alias("p"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start")
    )
    own = Window.partitionBy("file", "record_id", "part").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    inside = runs.withColumn("inside", F.coalesce(F.sum(size).over(own), F.lit(0)))
    same = (F.col("file") == F.col("f")) & F.col("record_id").eqNullSafe(F.col("r")) & (F.col("part") == F.col("p"))
    return inside.join(starts, same).withColumn("position", (F.col("start") + F.col("inside")).cast("long"))


def digests(records: DataFrame) -> DataFrame:
    """(file, position, record_id, length, digest, copies), written once to the shared folder.

    Records that do not come with a `position` are laid out in their file's order. Their bytes are read once.
    """
    body = F.coalesce("bytes", F.lit(""))
    keys = [
        F.coalesce("file", F.lit(-1)).cast("long").alias("file"), F.col("record_id").cast("long").alias("record_id"),
        F.octet_length(body).cast("long").alias("length"), F.sha2(body, 256).alias("digest"),
    ]
    names = ["file", "record_id", "length", "digest"]
    if "position" in records.columns:
        keys, names = [*keys, F.coalesce("position", F.lit(0)).cast("long").alias("position")], [*names, "position"]
    runs = records.select(*keys).groupBy(*names).agg(F.count(F.lit(1)).alias("copies"))
    if "position" not in records.columns:
        runs = _laid_out(stage(runs, "records"))
    return stage(runs.select("file", "position", "record_id", "length", "digest", "copies"), "digests")


def _leaf(range_bytes: int) -> list[Column]:
    """The nonnegative number of a file (0, -1, 1, -2 ... in order), and of a range of its offsets."""
    code = F.shiftleft("file", 1).bitwiseXOR(F.shiftright("file", 63))
    return [code.alias("file"), F.floor(F.col("position") / range_bytes).cast("long").alias("node")]


def _above(level: int, range_levels: int) -> list[Column]:
    """The parent of a node of a level: within its file below the files' roots, over the files from there on."""
    if level < range_levels:
        return [F.col("file"), F.shiftright("node", FANOUT_BITS).alias("node")]
    return [F.shiftrightunsigned("file", FANOUT_BITS).alias("file"), F.col("node")]


def shape(replicas: list[DataFrame], range_bytes: int = RANGE_BYTES) -> tuple[int, int]:
    """Levels above the leaves up to the files' roots, and from there to the replica's, enough for all replicas."""
    longest, widest = 0, 0
    for rows in replicas:
        file, node = _leaf(range_bytes)
        top = rows.select(file, node).agg(F.max("node"), F.max(F.shiftrightunsigned("file", 1))).first()
        longest, widest = max(longest, top[0] or 0), max(widest, 2 * (top[1] or 0) + 1)
    levels = lambda n: -(-n.bit_length() // FANOUT_BITS)
    return levels(longest), levels(widest)


def tree(rows: DataFrame, levels: tuple[int, int], range_bytes: int = RANGE_BYTES) -> list[DataFrame]:
    """Levels (file, node, digest) from the ranges to the files' roots, and on to the one root of the replica."""

    def joined(*order: str) -> Column:
        listed = F.array_sort(F.collect_list(F.struct(*order, "digest")))
        return F.sha2(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", *[F.coalesce(x[c].cast("string"), F.lit("-")) for c in (*order, "digest")])), "\n"), 256)

    # a range holds a bounded number of bytes, so a bounded number of records
    leaves = rows.select(*_leaf(range_bytes), "position", "record_id", "copies", "digest").groupBy("file", "node")
    out = [stage(leaves.agg(joined("position", "record_id", "copies").alias("digest")), "tree")]
    for i in range(sum(levels)):
        # a node has at most sixteen children
        child = out[-1].select(*[c.alias(n) for c, n in zip(_above(i, levels[0]), ("file", "node"))], F.col("file").alias("of"), F.col("node").alias("at"), "digest")
        out.append(stage(child.groupBy("file", "node").agg(joined("of", "at").alias("digest")), "tree"))
    return out


def root(levels: list[DataFrame]) -> str | None:
    """The root of a replica; None of an empty one."""
    row = levels[-1].first()  # at most one row
    return row["digest"] if row else None


def differing(a: list[DataFrame], b: list[DataFrame], range_levels: int) -> DataFrame:
    """Ranges (file, node) whose branches differ, found from the roots down to the first level without any."""
    suspects = None
    for i in range(len(a) - 1, -1, -1):
        sides = []
        for rows in (a[i], b[i]):
            if suspects is not None:
                file, node = _above(i, range_levels)
                up = rows.withColumns({"f": file, "n": node})
                rows = up.join(suspects.select(F.col("file").alias("f"), F.col("node").alias("n")), ["f", "n"], "left_semi").drop("f", "n")
            sides.append(rows)
        left, right = sides[0].withColumnRenamed("digest", "da"), sides[1].withColumnRenamed("digest", "db")
        both = left.join(right, ["file", "node"], "full").where(~F.col("da").eqNullSafe(F.col("db")))
        suspects = stage(both.select("file", "node"), "suspects")
        if suspects.isEmpty():
            break
    return suspects


def audit(expected: DataFrame, actual: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of the expected replica that the actual one lacks or holds otherwise, and those it has in excess.

    Both inputs come from `digests`. Result: file, position (the expected replica's, of extra records the
    actual one's), record_id, length, status (altered, missing, extra), expected_digest, actual_digest, copies.
    """
    levels = shape([expected, actual], range_bytes)
    ranges = differing(tree(expected, levels, range_bytes), tree(actual, levels, range_bytes), levels[0])
    file, node = _leaf(range_bytes)
    suspect = ranges.select(F.col("file").alias("f"), F.col("node").alias("n"))
    sides = []
    for rows, sign in ((expected, 1), (actual, -1)):
        inside = rows.withColumns({"f": file, "n": node}).join(suspect, ["f", "n"], "left_semi")
        place = [F.when(F.lit(sign == s), F.col("position")).alias(name) for s, name in ((1, "here"), (-1, "there"))]
        sides.append(inside.select("file", "record_id", "length", "digest", (F.col("copies") * sign).alias("balance"), *place))
    records = sides[0].unionByName(sides[1]).groupBy("file", "record_id", "length", "digest")
    left = records.agg(F.sum("balance").alias("balance"), F.min("here").alias("here"), F.min("there").alias("there")).where("balance <> 0")
    left = stage(left, "surplus")
    of = lambda c: F.max_by(c, "balance")
    pairs = left.where("record_id is not null").groupBy("file", "record_id").agg(
        of("here").alias("position"), of("length").alias("length"), of("digest").alias("expected_digest"), F.min_by("digest", "balance").alias("actual_digest"),
        F.max("balance").alias("copies"), F.count(F.lit(1)).alias("contents"), F.sum("balance").alias("total"),
    ).where("contents = 2 and total = 0").withColumn("status", F.lit("altered"))
    lone = left.join(pairs.select("file", "record_id"), ["file", "record_id"], "left_anti")
    lost = F.col("balance") > 0
    lone = lone.select(
        "file", F.when(lost, F.col("here")).otherwise(F.col("there")).alias("position"), "record_id", "length",
        F.when(lost, "missing").otherwise("extra").alias("status"), F.when(lost, F.col("digest")).alias("expected_digest"),
        F.when(~lost, F.col("digest")).alias("actual_digest"), F.abs("balance").alias("copies"),
    )
    return pairs.select(*lone.columns).unionByName(lone)
