from __future__ import annotations

import re
from collections import Counter

import pytest

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def shingle_counts(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
ODD = [
    # doc_id, text, lang, source; clashing columns are added below
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \n\t ", None, None),
    (4, LONG, "de", "b"),
    (5, "one two", "xx", "a"),
    (6, "the same text over and over in two rows of it", "en", "a"),
    (6, "the same text over and over in two rows of it", "en", "a"),
    (None, "a row without an id but with a text of some words", "en", None),
    (None, None, None, None),
    (9, "Ünïcode wörds 你好 世界 \U0001f600 \x01\x02 end", "fr", "b"),
]
CLASHING = ["shard", "slot", "kept", "rid", "label", "block", "n_tokens", "copy", "weight", "place", "_at", "a", "b", "n_words", "posterior", "perplexity", "_full", "_blocks", "_rest", "_source", "_words", "_lines", "_hashes", "_fold", "_votes", "_q", "_rid", "_key", "_own0", "_of"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, columns named like internal ones."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("mine") for c in CLASHING})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
