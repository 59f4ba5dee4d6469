"""Quality by perplexity under an interpolated modified Kneser-Ney model of character n-grams.

The model is trained on trusted text: documents labelled good. Characters keep their case, runs
of white space count as one space, a document is padded in front and closed by an end. Counts
of the highest order, continuation counts of the lower ones, context totals and the discounts
of each language are shuffled tables. Documents are dealt to blocks of bounded size; a block
asks for its distinct n-grams, their probabilities are made by joins with the count tables
order by order, and go back to the block, so no task holds the model and texts are exchanged
once. A document is kept if its perplexity is at most a quantile of its language's trusted
documents, with a slack for short texts.

The classifier is fitted on all trusted documents. They are dealt to FOLDS
folds, and each is scored by the counts without its own fold, so that the thresholds, which come
from all trusted documents, are those of text the counts have not seen. Every document is scored
as a whole. Null and empty texts consist of the end alone. A null language is the language "und".
A language without trusted text, or with a single trusted document, which nothing else in its
language can judge, has no threshold and keeps its documents. Repeated rows are scored alike. An empty table gives an empty result. Columns
other than doc_id, lang and text are not read by the scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serieswise.llm.common import ceil_div, sheltered, stage
from serieswise.llm.textnum import slices

ORDER = 4
BITS = 15
FOLDS = 5
#: Trusted documents of a language that one task may number; more are dealt to the folds by their hash.
SMALL_LANGUAGE = 10_000
#: Trusted documents (two numbers each) that every task may hold; more meet the documents in a shuffled join.
FEW_TRUSTED = 2_000_000
BLOCK_BYTES = 16_000_000
QUANTILE = 0.99
#: The allowed log perplexity grows by this over the square root of the length.
SLACK = 2.0
#: Characters that a worker turns into n-grams at a time.
SLICE = 1_000_000
START, STOP = "\x01", "\x02"
#: Between a language and the fold that its counts leave out.
WITHOUT = "\x03"


def codes(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """n-gram of every character and end, and characters of each document with its end."""
    pad = START * (order - 1)
    padded = [pad + " ".join(t.replace(START, " ").replace(STOP, " ").split()) + STOP for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = np.where(points < 24576, points, 24576 + points % 8192).astype(np.int64)
    gram = np.zeros(len(ids), np.int64)
    for j in range(order):
        gram[order - 1 :] |= ids[order - 1 - j : len(ids) - j] << (BITS * j)
    return gram[ids != 1], np.array([len(t) - order + 1 for t in padded], np.int64)


def _by_language(langs: list[str], texts: list[str]) -> Iterator[tuple[str, np.ndarray, list[str]]]:
    """Places and texts of each language, in slices of bounded size."""
    langs = np.array(langs, object)
    for name in sorted(set(langs)):
        places = np.flatnonzero(langs == name)
        mine = [texts[i] or "" for i in places]
        for a, b in slices(mine, SLICE):
            yield name, places[a:b], mine[a:b]


def _pack(text: pd.Series) -> pd.Series:
    return text.map(lambda t: pa.compress(t.encode("utf-8"), codec="zstd", asbytes=True))


def _unpack(packed: pa.Array, sizes: pa.Array) -> list[str]:
    return [
        pa.decompress(p, decompressed_size=n, codec="zstd", asbytes=True).decode("utf-8") if n else ""
        for p, n in zip(packed.to_pylist(), sizes.to_pylist())
    ]


def good_documents(labels: DataFrame) -> DataFrame:
    """doc_id of the documents labelled good, each once."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    return good.select(F.col("doc_id").cast("long").alias("doc_id"))


def _level(sizes: list[int], bound: int) -> int:
    """The bound of a language with which all languages together have at most `bound` documents, and each one at least."""
    rest, level = bound, bound
    for i, n in enumerate(sorted(sizes)):
        level = rest // (len(sizes) - i)
        if n > level:
            break
        rest -= n
        level = bound
    return max(1, level)


def _trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang and hash of the trusted documents, each once."""
    lang = F.min(F.coalesce("lang", F.lit("und"))).alias("lang")
    known = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(lang).join(good_documents(labels), "doc_id")
    return known.withColumn("hash", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))


def fitting(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(_id, _fold) of all trusted documents.

    Folds are dealt by the hash, in small languages in its order, so that two documents of a language never
    share one before each has some; the only one of a language is in none (-1).
    """
    known = stage(_trusted(docs, labels), "trusted")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language
    small = F.col("lang").isin([k for k, n in sizes.items() if n <= SMALL_LANGUAGE])
    of = Window.partitionBy("lang")
    place = F.row_number().over(of.orderBy("hash", "doc_id")) - 1
    few = known.where(small).select("doc_id", F.when(F.count(F.lit(1)).over(of) > 1, place % FOLDS).otherwise(-1).alias("fold"))
    many = known.where(~small).select("doc_id", F.pmod("hash", F.lit(FOLDS)).alias("fold"))
    return stage(few.unionByName(many).select(F.col("doc_id").alias("_id"), F.col("fold").cast("int").alias("_fold")), "folds")


def trusted_ids(docs: DataFrame, labels: DataFrame, bound: int) -> np.ndarray:
    """At most `bound` trusted documents for a trial: small languages whole, of the others the smallest by hash.

    The classifier does not use it.
    """
    known = _trusted(docs, labels)
    level = _level([r["count"] for r in known.groupBy("lang").count().collect()], bound)  # a row a language
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))
    rows = known.select("doc_id", place.alias("place")).where(F.col("place") <= level)
    return np.sort(rows.select("doc_id").toPandas()["doc_id"].to_numpy(np.int64))


def _beside(docs: DataFrame, trusted: DataFrame, how: str) -> DataFrame:
    """The documents with the columns of their id in `trusted` (_id and others)."""
    few = trusted.count() <= FEW_TRUSTED
    return docs.join(F.broadcast(trusted) if few else trusted, F.col("doc_id").cast("long") == F.col("_id"), how)


def count_grams(docs: DataFrame, trusted: DataFrame | np.ndarray, order: int = ORDER) -> DataFrame:
    """(lang, gram, a0) over the trusted documents (_id); with their folds (_fold) also a1 to a5, the counts without each fold."""
    if not isinstance(trusted, DataFrame):
        trusted = docs.sparkSession.createDataFrame([(int(i),) for i in trusted], "_id long")
    folded = "_fold" in trusted.columns

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []

        def merged() -> pd.DataFrame:
            return pd.concat(held).groupby(["lang", "fold", "gram"], sort=False, as_index=False)["a"].sum()

        for batch in batches:
            fold = batch.column(2).to_numpy()
            for f in np.unique(fold):
                part = batch.filter(pa.array(fold == f))
                for lang, _, texts in _by_language(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    place, unique = pd.factorize(codes(texts, order)[0])
                    held.append(pd.DataFrame({"lang": lang, "fold": np.int32(f), "gram": unique, "a": np.bincount(place)}))
            if sum(map(len, held)) > 1_000_000:
                held[:] = [merged()]
                if len(held[0]) > 500_000:
                    yield pa.RecordBatch.from_pandas(held.pop(), preserve_index=False)
        if held:
            yield pa.RecordBatch.from_pandas(merged(), preserve_index=False)
        pa.default_memory_pool().release_unused()  # an idle worker keeps nothing

    read = _beside(docs.select("doc_id", "lang", "text"), trusted, "inner")
    read = read.select("lang", "text", F.col("_fold") if folded else F.lit(-1).alias("_fold"))
    parts = read.mapInArrow(counted, "lang string, fold int, gram long, a long")
    if not folded:
        return parts.groupBy("lang", "gram").agg(F.sum("a").alias("a0"))
    without = [F.sum(F.when(F.col("fold") == f, 0).otherwise(F.col("a"))).alias(f"a{f + 1}") for f in range(FOLDS)]
    return parts.groupBy("lang", "gram").agg(F.sum("a").alias("a0"), *without)


def variant_name(lang: str, variant: int) -> str:
    """The language as its documents name it, or, of variant 1 on, with the fold that its counts leave out."""
    return f"{lang}{WITHOUT}{variant - 1}" if variant else lang


def _mask(gram: Column, order: int) -> Column:
    return gram.bitwiseAND((1 << (BITS * order)) - 1)


class Model:
    """Count and context tables by order, and per language and order the discounts (a row each).

    A row of a table holds the counts of all documents (variant 0) and those without each fold
    (variants 1 to FOLDS), so that an n-gram is stored and exchanged once, whatever the folds.
    """

    def __init__(self, top: DataFrame, order: int = ORDER) -> None:
        self.order, self.variants = order, len(top.columns) - 2
        span = range(self.variants)
        self.grams, self.contexts = {order: stage(top, f"grams{order}")}, {}
        for k in range(order - 1, 0, -1):
            # left neighbours that are there without the fold
            kinds = [F.sum(F.when(F.col(f"a{v}") > 0, 1).otherwise(0)).alias(f"a{v}") for v in span]
            left = self.grams[k + 1].groupBy("lang", _mask(F.col("gram"), k).alias("gram")).agg(*kinds)
            self.grams[k] = stage(left, f"grams{k}")
        some = None
        for k, grams in self.grams.items():
            of = [F.sum(F.when(F.col(f"a{v}") == i, 1).otherwise(0)).alias(f"t{i}_{v}") for v in span for i in (1, 2, 3, 4)]
            types = [F.sum(F.when(F.col(f"a{v}") > 0, 1).otherwise(0)).alias(f"types_{v}") for v in span]
            rows = grams.groupBy("lang").agg(*of, *types).select(F.lit(k).alias("k"), "*")
            some = rows if some is None else some.unionByName(rows)
        self.discounts = {}
        for r in some.collect():  # a row per language and order
            for v in span:
                if r[f"types_{v}"]:
                    own = {**{f"t{i}": r[f"t{i}_{v}"] for i in (1, 2, 3, 4)}, "types": r[f"types_{v}"]}
                    self.discounts[r["k"], variant_name(r["lang"], v)] = self._discount(own)
        for k, grams in self.grams.items():
            sums = []
            for v in span:
                a = F.col(f"a{v}")
                sums.append(F.sum(a).alias(f"total{v}"))
                sums += [F.sum(F.when(c, 1).otherwise(0)).alias(f"n{i}_{v}") for i, c in enumerate((a == 1, a == 2, a >= 3), 1)]
            held = grams.groupBy("lang", F.shiftright("gram", BITS).alias("context")).agg(*sums)
            backs = []
            for v in span:
                d = self._discount_columns(k, F.concat("lang", F.lit(variant_name("", v))))
                mass = sum(F.col(f"n{i}_{v}") * d[i - 1] for i in (1, 2, 3))
                backs.append(F.when(F.col(f"total{v}") > 0, mass / F.col(f"total{v}")).alias(f"back{v}"))
            # written, so that the plan of the scores, which is read twice, does not hold their making
            self.contexts[k] = stage(held.select("lang", "context", *[f"total{v}" for v in span], *backs), f"contexts{k}")

    @staticmethod
    def _discount(r) -> tuple[float, float, float, float]:
        t1, t2, t3, t4 = (float(r[f"t{i}"]) for i in (1, 2, 3, 4))
        y = t1 / (t1 + 2 * t2) if t1 else 0.5
        d1 = 1 - 2 * y * t2 / t1 if t1 else 0.5
        d2 = 2 - 3 * y * t3 / t2 if t2 else 1.0
        d3 = 3 - 4 * y * t4 / t3 if t3 else 1.5
        return min(max(d1, 0.05), 1.0), min(max(d2, 0.05), 2.0), min(max(d3, 0.05), 3.0), float(r["types"])

    def _discount_columns(self, k: int, lang: Column) -> list[Column]:
        """D1, D2, D3+ and the number of types of order k, chosen by language (and the fold it leaves out)."""
        out = []
        for i, default in enumerate((0.5, 1.0, 1.5, 0.0)):
            pairs = [(lang, d[i]) for (order, lang), d in self.discounts.items() if order == k]
            values = F.create_map(*[F.lit(x) for p in pairs for x in p]) if pairs else None
            out.append(F.coalesce(F.try_element_at(values, lang), F.lit(default)) if pairs else F.lit(default))
        return out

    def probabilities(self, wanted: DataFrame) -> DataFrame:
        """(lang, gram, p) of the distinct n-grams (lang, gram), from the lowest order up."""
        lang, span = F.col("lang"), range(self.variants)
        ending = f"{WITHOUT}([0-9])$"
        folded = lang.rlike(ending) if self.variants > 1 else F.lit(False)
        rows = wanted.withColumns({
            "base": F.when(folded, F.regexp_replace(lang, ending, "")).otherwise(lang),
            "v": F.when(folded, F.regexp_extract(lang, ending, 1).cast("int") + 1).otherwise(0),
            "p": 1 / (self._discount_columns(1, lang)[3] + 1),
        })
        chosen = lambda name: F.get(F.array(*[F.col(f"{name}{v}") for v in span]), F.col("v"))
        for k in range(1, self.order + 1):
            d = self._discount_columns(k, lang)
            part = _mask(F.col("gram"), k)
            seen = self.grams[k].withColumnsRenamed({"lang": "l", "gram": "g"})
            rows = rows.join(seen, (F.col("base") == F.col("l")) & (part == F.col("g")), "left").withColumn("a", chosen("a"))
            rows = rows.select("lang", "base", "v", "gram", "p", "a")
            context = self.contexts[k].withColumnRenamed("lang", "l")
            rows = rows.join(context, (F.col("base") == F.col("l")) & (F.shiftright(part, BITS) == F.col("context")), "left")
            a, total, back = F.coalesce("a", F.lit(0)), chosen("total"), chosen("back")
            cut = F.when(a == 0, 0.0).when(a == 1, d[0]).when(a == 2, d[1]).otherwise(d[2])
            p = F.when(F.coalesce(total, F.lit(0)) == 0, F.col("p")).otherwise((a - cut) / total + back * F.col("p"))
            rows = rows.select("lang", "base", "v", "gram", p.alias("p"))
        return rows.select("lang", "gram", "p")


def perplexities(docs: DataFrame, model: Model, folds: DataFrame | None = None) -> DataFrame:
    """The documents with n_tokens (characters and the end) and log10 perplexity.

    With the folds (_id, _fold) of the documents in the counts, each is scored by the counts
    without its fold, and _unseen says whether the counts that scored a document are of its
    language and do not hold it. Documents in the counts have blocks of their own, fold by fold,
    so that few blocks ask for the n-grams of more than one count table of a language. Texts are compressed for their one exchange. Both branches below, the questions of a block
    and its scoring, read it.
    """
    order = model.order
    own = [c for c in docs.columns if c not in ("n_tokens", "log10_perplexity")]
    text, lang = F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("und"))
    if folds is None:
        docs = docs.withColumn("_fold", F.lit(None).cast("int"))
    else:
        docs = _beside(docs, folds, "left")
        known = [name for k, name in model.discounts if k == order]
        without = F.concat(lang, F.lit(WITHOUT), F.col("_fold").cast("string"))
        unseen = F.when(F.col("_fold").isNull(), lang.isin(known)).otherwise(without.isin(known))
        lang = F.when(without.isin(known), without).otherwise(lang)
        docs, own = docs.withColumn("_unseen", unseen), [*own, "_unseen"]
    counted = F.col("_fold").isNotNull()
    sizes = {r[0]: r[1] for r in docs.groupBy(counted).agg(F.sum(F.octet_length("text"))).collect()}
    rest = ceil_div(sizes.get(False), BLOCK_BYTES)
    more = ceil_div(sizes.get(True), BLOCK_BYTES, 0)
    blocks = rest + more
    spread = F.xxhash64(F.monotonically_increasing_id())
    turn = (F.greatest("_fold", F.lit(0)) + F.pmod(spread, F.lit(1 << 20)) / (1 << 20)) / FOLDS
    block = F.when(counted, rest + F.floor(turn * more)).otherwise(F.pmod(spread, F.lit(rest))).cast("int")
    dealt = docs.select(
        block.alias("_block"), lang.alias("_lang"), F.octet_length(text).alias("_size"), F.pandas_udf(_pack, "binary")(text).alias("_packed"),
        F.col("text").isNull().alias("_none"), *[c for c in own if c != "text"],
    ).repartition(blocks, "_block")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], np.ndarray] = {}
        for batch in batches:
            block = batch.column("_block").to_numpy()
            for b in np.unique(block):
                some = batch.select(["_lang", "_size", "_packed"]).filter(pa.array(block == b))
                for lang, _, texts in _by_language(some.column(0).to_pylist(), _unpack(some.column(2), some.column(1))):
                    new = pd.unique(codes(texts, order)[0])
                    old = held.get((int(b), lang))
                    held[int(b), lang] = new if old is None else pd.unique(np.concatenate([old, new]))
        for (b, lang), grams in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(grams), b, np.int32)), pa.array([lang] * len(grams), pa.string()), pa.array(grams)], ["_block", "lang", "gram"]
            )
        pa.default_memory_pool().release_unused()

    # all columns go in, or the two branches would prune their exchanges differently and make two of them
    wanted = dealt.mapInArrow(asked, "_block int, lang string, gram long")
    # one exchange by n-gram serves both the distinct n-grams and the way back to the blocks that asked: the count
    # of blocks keeps the one column that would be pruned from the first and make it another exchange
    wanted = wanted.repartition("lang", "gram")
    distinct = wanted.groupBy("lang", "gram").agg(F.count("_block").alias("_n")).where("_n > 0")
    known = model.probabilities(distinct.select("lang", "gram"))
    answered = wanted.join(known, ["lang", "gram"]).select("_block", "lang", "gram", "p")

    def scored(rows: pa.Table, table: pa.Table) -> pa.Table:
        texts, langs = _unpack(rows.column("_packed"), rows.column("_size")), rows.column("_lang").to_pylist()
        n, logs = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        answers = table.select(["lang", "gram", "p"]).to_pandas()
        sorted_ = {k: v.sort_values("gram") for k, v in answers.groupby("lang")}
        for lang, places, some in _by_language(langs, texts):
            grams, p = sorted_[lang]["gram"].to_numpy(), np.log10(sorted_[lang]["p"].to_numpy())
            gram, size = codes(some, order)
            place, unique = pd.factorize(gram)
            values = p[np.searchsorted(grams, unique)][place]
            n[places], logs[places] = size, np.add.reduceat(values, np.cumsum(size) - size)
        none = rows.column("_none").to_pylist()
        given = {"text": pa.array([None if x else t for x, t in zip(none, texts)], pa.string())}
        columns = [given.get(c) if c == "text" else rows.column(c) for c in own]
        pa.default_memory_pool().release_unused()
        return pa.Table.from_arrays([*columns, pa.array(n), pa.array(-logs / np.maximum(n, 1))], names=[*own, "n_tokens", "log10_perplexity"])

    schema = docs.select(*own).schema.add("n_tokens", "long").add("log10_perplexity", "double")
    return dealt.groupBy("_block").cogroup(answered.groupBy("_block")).applyInArrow(scored, schema)


def limits(scores: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """(_of, _height): of each language the quantile over all its trusted documents, none scored by counts that hold it."""
    # a short text's mean varies more: compare what is above the slack of its length
    height = F.col("log10_perplexity") - F.lit(slack) / F.sqrt("n_tokens")
    # heights of five decimals, rounded up, are counted first: a language's distinct ones are few whatever its documents
    rows = scores.where("_unseen").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("und")).alias("_of"), (F.ceil(height * 1e5) / 1e5).alias("h"))
    counted = rows.join(good_documents(labels), "doc_id", "left_semi").groupBy("_of", "h").agg(F.count("*").alias("n"))
    return counted.groupBy("_of").agg(F.percentile("h", F.lit(quantile), F.col("n")).alias("_height"))


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """The documents with n_tokens, perplexity, threshold and kept.

    The scores are read twice, for the limits and for the result; their exchanges are made once.
    """
    results = ("n_tokens", "perplexity", "threshold", "kept")
    return sheltered(docs, ("doc_id", "lang", "text"), results, lambda d: _classify(d, labels, order, quantile, slack))


def _classify(docs: DataFrame, labels: DataFrame, order: int, quantile: float, slack: float) -> DataFrame:
    own = docs.columns
    fitted = fitting(docs, labels)
    known = docs.withColumn("lang", F.coalesce("lang", F.lit("und")))
    model = Model(count_grams(known, fitted, order), order)
    scores = perplexities(docs.select(*own), model, fitted)
    known = scores.join(F.broadcast(limits(scores, labels, quantile, slack)), F.coalesce("lang", F.lit("und")) == F.col("_of"), "left")
    limit = F.col("_height") + F.lit(slack) / F.sqrt("n_tokens")
    return known.select(
        *own, "n_tokens", F.pow(F.lit(10.0), "log10_perplexity").alias("perplexity"), F.pow(F.lit(10.0), limit).alias("threshold"),
        F.coalesce(F.col("log10_perplexity") <= limit, F.lit(True)).alias("kept"),
    )
