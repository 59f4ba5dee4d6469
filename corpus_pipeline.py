"""From raw documents to packed training sequences, stage by stage.

Each stage reads all that the one before kept and returns the columns of `documents`, whatever else they
are named like; the last returns the packed pieces. Null and empty texts and repeated rows are judged by
the operators as their docstrings say; an empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from serieswise.llm import bagminhash, kneser_ney, mixing, packing, weak_rules
from serieswise.llm.common import sheltered, stage, table
from serieswise.llm.queries import vocabulary
from serieswise.session import ship_package

#: No source is read over this many times as often as another.
MAX_REPEATS = 2.0


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted rules keep."""
    ship_package(spark)
    return sheltered(docs, ("text",), (), lambda d: weak_rules.quality_rules(weak_rules.with_measures(d)).where("kept"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the threshold of their language."""
    ship_package(spark)
    labels = table(spark, sf_dir, "labels")
    return sheltered(docs, ("doc_id", "lang", "text"), (), lambda d: kneser_ney.classify(d, labels).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    ship_package(spark)

    def firsts(d: DataFrame) -> DataFrame:
        rows = bagminhash.with_rows(d)
        dropped = bagminhash.near_duplicates(rows).where("not kept").select("rid")
        return rows.join(dropped, rows["_rid"] == dropped["rid"], "left_anti")

    return sheltered(docs, ("doc_id", "text"), (), firsts)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source at least once, the smaller ones repeated up to their target weight."""
    ship_package(spark)
    return sheltered(docs, ("source", "text"), (), lambda d: mixing.mix(d, max_repeats=MAX_REPEATS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 4096 tokens."""
    ship_package(spark)
    return packing.pack(packing.tokenized(docs, vocabulary()))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near-duplicates", near_duplicates),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: The classifier, the signatures and the tokenizer have no SQL form; the tests compare each operator with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name.replace(" ", "-"))
    return docs
