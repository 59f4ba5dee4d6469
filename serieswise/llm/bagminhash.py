"""Near-duplicate classes by BagMinHash signatures of weighted word shingles.

A text is the multiset of its shingles of five words; a shingle's count is its weight. The
weight axis is cut hierarchically into [0,1), [1,2), [2,4), [4,8) and so on. Each (shingle,
interval) drives its own Poisson process: points come in time order, and each has a signature
component and a place on the weight axis; points at or above the shingle's weight are
discarded. The earliest point of a component is its signature, so two texts agree in a
component with exactly the probability of their weighted Jaccard similarity. Generation of a
text's points stops at the time by which all components are expected to be filled, and goes
on for the texts where some is not.

Equal texts form one class first. Signatures are banded; in every bucket each text is paired
with the bucket's smallest, pairs whose signatures agree too little are dropped, the others
are verified on the exact multisets. Texts of a bucket that are still in different connected
components are then paired across components, so no link between buckets' members is lost
while a tight group of n texts costs n - 1 verified pairs. Components come from label
propagation with pointer jumping, in tables.

Texts of one to four words have one shingle. Null and empty texts have none and are each a
class of their own. Equal rows are in one class; the row that stays is the one
of smallest doc_id (null ids last), then the earliest. An empty table gives an empty result.
Columns other than doc_id and text are carried through `with_rows` and not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieswise.llm.common import identified, stage
from serieswise.llm.textnum import Words, mix, slices, uniform

SHINGLE = 5
SIMILARITY = 0.8
COMPONENTS, BANDS, BAND_ROWS = 192, 32, 6
#: Members of a bucket that one task compares with as many others.
BUCKET_BLOCK = 1_000
#: Elements of the multisets of such a block.
BLOCK_ELEMENTS = 2_000_000
#: Characters whose shingles a worker holds at a time.
SLICE = 1_000_000
#: Signature agreement below which no text pair of similarity 0.8 is expected: four standard deviations.
LEAST_AGREEMENT = SIMILARITY - 4 * (SIMILARITY * (1 - SIMILARITY) / COMPONENTS) ** 0.5


def shingles(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count) of the texts' multisets, sorted by document and hash."""
    words = Words(texts)
    n = len(words.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(words.count)[:-1]])
    keep = np.maximum(words.count - size + 1, np.minimum(words.count, 1))
    document = np.repeat(np.arange(len(texts)), keep)
    at = np.arange(int(keep.sum())) - np.repeat(np.cumsum(keep) - keep, keep) + begin[document]
    last = begin[document] + words.count[document]
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        inside = at + j < last
        part = words.hash[np.minimum(at + j, n - 1)] * np.uint64(2 * j + 3)
        out = mix(out + np.where(inside, part, np.uint64(0)))
    order = np.lexsort((out, document))
    document, out = document[order], out[order]
    new = np.flatnonzero(np.concatenate([[True], (document[1:] != document[:-1]) | (out[1:] != out[:-1])]))
    return document[new], out[new], np.diff(np.append(new, len(out)))


def _step(k: int, by: int) -> np.uint64:
    return np.uint64(k * by % (1 << 64))


def signatures(document: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, components: int = COMPONENTS) -> np.ndarray:
    """One row of `components` 32-bit values for each text; texts without shingles have zeros."""
    total = np.bincount(document, weights=weight, minlength=texts)
    sign = np.zeros(texts * components, np.uint32)
    best = np.full(texts * components, np.inf)
    wanted = np.flatnonzero(total > 0)
    reach = components * (np.log(components) + 4)
    while len(wanted):
        stop = np.zeros(texts)
        stop[wanted] = reach / total[wanted]
        mine = np.flatnonzero(stop[document] > 0)
        doc, elem, w = document[mine], element[mine], weight[mine].astype(np.float64)
        low, width, level = 0.0, 1.0, 0
        while len(doc):
            seed = mix(elem + _step(level, 0x9E3779B97F4A7C15))
            key, when, ident = [], [], []
            live = np.arange(len(doc))
            t = np.zeros(len(doc))
            r = 0
            while len(live):
                x = mix(seed[live] + _step(3 * r + 1, 0xD1342543DE82EF95))
                now = t[live] - np.log(uniform(x)) / width
                ok = now <= stop[doc[live]]
                live, now = live[ok], now[ok]
                t[live] = now
                y = mix(seed[live] + _step(3 * r + 2, 0xD1342543DE82EF95))
                z = mix(y)
                inside = low + width * uniform(z) <= w[live]
                slot = (y % np.uint64(components)).astype(np.int64)
                key.append((doc[live] * components + slot)[inside])
                when.append(now[inside])
                ident.append((z >> np.uint64(32)).astype(np.uint32)[inside])
                r += 1
            key, when, ident = np.concatenate(key), np.concatenate(when), np.concatenate(ident)
            order = np.argsort(-when)
            key, when, ident = key[order], when[order], ident[order]
            # the last write of a place is its earliest point
            earliest = np.full(texts * components, -1, np.int64)
            earliest[key] = np.arange(len(key))
            at = np.flatnonzero(earliest >= 0)
            at = at[when[earliest[at]] < best[at]]
            best[at], sign[at] = when[earliest[at]], ident[earliest[at]]
            low, width, level = low + width, width if level == 0 else 2 * width, level + 1
            more = w > low
            doc, elem, w = doc[more], elem[more], w[more]
        open_ = ~np.isfinite(best).reshape(texts, components).all(1)
        wanted = np.flatnonzero(open_ & (total > 0))
        reach *= 2
    return sign.reshape(texts, components)


def with_rows(docs: DataFrame) -> DataFrame:
    """The documents with a row id; rows of files are told by their place, others are written once to the shared folder."""
    return identified(docs, "_rid", "near-rows")


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, text id, number of shingles, band keys, and the signature's lowest byte by component.

    A byte tells most differing components apart and is enough for the estimate; bands use all bits.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)).reshape(BANDS, BAND_ROWS)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in slices(texts, SLICE):
                document, element, weight = shingles(texts[a:b])
                total = np.bincount(document, weights=weight, minlength=b - a).astype(np.int64)
                sig = signatures(document, element, weight, b - a)
                parts = sig[:, : BANDS * BAND_ROWS].reshape(b - a, BANDS, BAND_ROWS).astype(np.uint64)
                keys = mix(mix((parts + np.uint64(1)) * powers).sum(2) + np.arange(BANDS, dtype=np.uint64))
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * n), pa.array(flat))
                    for n, flat in ((BANDS, keys.ravel().view(np.int64)), (COMPONENTS, (sig & 255).astype(np.uint8).view(np.int8).ravel()))
                ]
                own = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(total), *lists], ["rid", "doc_id", "text_id", "n", "bands", "sig"])

    text = F.coalesce("text", F.lit(""))
    rid = F.col("_rid") if "_rid" in docs.columns else F.monotonically_increasing_id()
    read = docs.select(rid.alias("rid"), F.col("doc_id").cast("long"), F.md5(text).alias("text_id"), text.alias("text"))
    return read.mapInArrow(sign, "rid long, doc_id long, text_id string, n long, bands array<long>, sig array<tinyint>")


def _pack(text: pd.Series) -> pd.Series:
    return text.map(lambda t: pa.compress(t.encode("utf-8", "surrogatepass"), codec="zstd", asbytes=True))


def _multisets(docs: DataFrame, named: DataFrame) -> DataFrame:
    """Elements of the named texts (rid, text_id); the k-th occurrence of a shingle is an element of its own, so sets say it all."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, size = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            texts = [pa.decompress(p, decompressed_size=n, codec="zstd", asbytes=True).decode("utf-8", "surrogatepass") for p, n in zip(packed, size)]
            for a, b in slices(texts, SLICE):
                document, element, count = shingles(texts[a:b])
                nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                flat = mix(np.repeat(element, count) + nth.astype(np.uint64)).view(np.int64)
                number = np.bincount(document, weights=count, minlength=b - a).astype(np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(number)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["rid", "elements"]
                )

    text = F.coalesce("text", F.lit(""))
    packed = docs.where(F.length(text) > 0).select(F.md5(text).alias("text_id"), F.octet_length(text).alias("size"), F.pandas_udf(_pack, "binary")(text).alias("packed"))
    # equal texts: one of them is enough, and any
    found = packed.join(named.hint("merge"), "text_id").groupBy("rid").agg(F.first(F.struct("packed", "size")).alias("x"))
    return found.select("rid", "x.packed", "x.size").mapInArrow(listed, "rid long, elements array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(rid, label): the smallest rid of each connected component of the edges (a, b)."""
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "rid"), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("rid")).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, F.col("rid") == F.col("a")).select("rid", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("rid").alias("to"), F.col("label").alias("beyond"))
        moved = hooked.join(jump, F.col("next") == F.col("to"), "left").select(
            "rid", F.least("next", F.coalesce("beyond", "next")).alias("label"), F.col("label").alias("was")
        )
        moved = stage(moved, "labels")
        labels = moved.select("rid", "label")
        if moved.where("label <> was").isEmpty():
            return labels


def _agreement() -> Column:
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, x: a + x)
    return same / COMPONENTS


def _close(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and signatures allow the similarity."""
    a = named.select(F.col("rid").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na"))
    b = named.select(F.col("rid").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb"))
    size = F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb")
    joined = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b")
    return joined.where(size & (_agreement() >= LEAST_AGREEMENT)).select("a", "b")


def _verified(close: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose multisets have the similarity."""
    common = F.size(F.array_intersect("ea", "eb"))
    both = F.size("ea") + F.size("eb")
    a = sets.select(F.col("rid").alias("a"), F.col("elements").alias("ea"))
    b = sets.select(F.col("rid").alias("b"), F.col("elements").alias("eb"))
    judged = close.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(common >= SIMILARITY * (both - common))
    return stage(judged.select("a", "b"), "links")


def _across(left: DataFrame, named: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between different components of one bucket.

    Members of a bucket are dealt to blocks of bounded rows and elements, and each pair of blocks is compared in
    one task: by size and signature first, then by the multisets. Components that a link has joined there are
    not compared again, so a task returns fewer links than it has members, however many pairs are alike.
    """

    def compared(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid", ignore_index=True)
        places = [np.flatnonzero(pdf["own"].to_numpy() == k) for k in key[1:3]]
        sig, n = np.stack(pdf["sig"].to_numpy()).astype(np.int8), pdf["n"].to_numpy()
        elements = [np.sort(e) for e in pdf["elements"]]
        _, label = np.unique(pdf["label"].to_numpy(), return_inverse=True)
        above = np.arange(label.max() + 1)

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        def alike(x: int, y: int) -> bool:
            at = np.searchsorted(elements[x], elements[y])
            common = int((elements[x][np.minimum(at, len(elements[x]) - 1)] == elements[y]).sum())
            return common >= SIMILARITY * (len(elements[x]) + len(elements[y]) - common)

        found: list[tuple[int, int]] = []
        for begin in range(0, len(places[0]), 64):
            one, two = places[0][begin : begin + 64], places[1]
            small, large = np.minimum(n[one][:, None], n[two]), np.maximum(n[one][:, None], n[two])
            x, y = np.nonzero((label[one][:, None] != label[two]) & (small >= SIMILARITY * large))
            for j in range(0, len(x), 50_000):
                u, v = one[x[j : j + 50_000]], two[y[j : j + 50_000]]
                near = (sig[u] == sig[v]).mean(1) >= LEAST_AGREEMENT
                for p, q in zip(u[near].tolist(), v[near].tolist()):
                    a, b = top(label[p]), top(label[q])
                    if a != b and alike(p, q):
                        above[max(a, b)] = min(a, b)
                        found.append((p, q))
        rid = pdf["rid"].to_numpy()
        ends = rid[np.array(found, np.int64).reshape(-1, 2)]
        return pd.DataFrame({"a": ends.min(1), "b": ends.max(1)})

    known = left.join(named.select("rid", "n", "sig").hint("merge"), "rid")
    rows, size = F.ceil(F.count("*") / BUCKET_BLOCK), F.ceil(F.sum("n") / BLOCK_ELEMENTS)
    blocks = known.groupBy("band").agg(F.greatest(rows, size).cast("int").alias("k"))
    dealt = known.join(blocks, "band").withColumn("own", F.pmod(F.xxhash64("rid"), F.col("k")).cast("int"))
    sent = dealt.join(sets.hint("merge"), "rid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    sent = sent.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rid", "label", "n", "sig", "elements")
    return stage(sent.groupBy("band", "i", "j").applyInPandas(compared, "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """rid, doc_id, class_id (smallest doc_id of the class), class_size and kept.

    Documents from `with_rows` keep their row id; otherwise it is made here.
    """
    signed = stage(_signed(docs), "signatures")
    firsts = signed.where("n > 0").groupBy("text_id").agg(F.min("rid").alias("rep"))
    reps = signed.select("rid", "bands").join(firsts.select(F.col("rep").alias("rid")).hint("merge"), "rid", "left_semi")
    banded = reps.select("rid", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("rid").alias("pivot"), F.count("*").alias("m")).where("m > 1")
    members = stage(banded.join(buckets.hint("merge"), "band").select("band", "rid", "pivot"), "buckets")
    # what the pairs need to know of texts that share a bucket with another
    named = signed.select("rid", "text_id", "n", "sig").join(members.select("rid").distinct().hint("merge"), "rid", "left_semi")
    named = stage(named, "named")
    sets = stage(_multisets(docs, named.select("rid", "text_id")), "multisets")
    stars = members.where("rid <> pivot").select(F.col("pivot").alias("a"), F.col("rid").alias("b")).distinct()
    links = _verified(_close(stars, named), sets)
    labels = components(links)
    # what is left: members of one bucket in different components
    own = members.join(labels, "rid", "left").select("band", "rid", F.coalesce("label", "rid").alias("label"))
    mixed = own.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band")
    left = stage(own.join(mixed, "band", "left_semi"), "unsettled")
    if not left.isEmpty():
        more = _across(left, named, sets)
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)
    joined = signed.select("rid", "doc_id", "text_id", "n").join(firsts, "text_id", "left")
    rep = F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("rid"))
    grouped = joined.select("rid", "doc_id", rep.alias("rep")).join(
        labels.select(F.col("rid").alias("rep"), "label"), "rep", "left"
    ).select("rid", "doc_id", F.coalesce("label", "rep").alias("label"))
    grouped = stage(grouped, "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("rid").alias("first")))
    classes = grouped.groupBy("label").agg(first.alias("first"), F.count("*").alias("class_size"))
    return grouped.join(classes, "label").select(
        "rid", "doc_id", F.col("first.id").alias("class_id"), "class_size", (F.col("first.first") == F.col("rid")).alias("kept")
    )
