"""Neighbours, fixity, perplexity, toxicity, the language model and the pipeline."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from check import connect, differences
from pyspark.sql import functions as F

from serieswise.llm import ann, fixity, gru_lm, kneser_ney, queries, toxicity
from serieswise.llm.oracles import ORACLES
from serieswise.llm.textnum import Words

from .conftest import ODD, words

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"
BIG = "/root/testdata/sf0.1"
#: Trusted documents of a rare language, outside the first half of a seeded order.
RARE = (0, 2, 3)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SMALL).toPandas(), connect(SMALL).execute(ORACLES[name]).df()) == []


def test_recall_of_neighbours(spark):
    table = spark.read.parquet(f"{MIDDLE}/embeddings.parquet")
    v = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    got = defaultdict(list)
    for r in queries.QUERIES["op1_multiprobe_neighbours"](spark, MIDDLE).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(f[2] - v[q] @ v[f[1]]) < 1e-12 for f in found)
        assert q not in [f[1] for f in found]
        best = sorted((i for i in v if i != q), key=lambda i: (-(v[q] @ v[i]), i))[:20]
        hits += len(set(best) & {f[1] for f in found})
    assert set(got) == {i for i in v if i % 20 == 0} and hits >= 0.9 * 20 * len(got)


def test_neighbour_tasks_grow_with_the_table(spark, monkeypatch):
    """Copies of queries follow the number of tasks, which is bounded until they are large; the neighbours do not depend on it."""
    assert [ann.task_rows(n) for n in (100, 96_000, 480_000, 10_000_000)] == [4_000, 4_000, 20_000, 32_000]
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((600, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = lambda: sorted(tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0, k=5).collect())
    one = found()
    monkeypatch.setattr(ann, "TASK_ROWS", 10)
    monkeypatch.setattr(ann, "TASKS", 7)
    assert ann.task_rows(600) == 85 and found() == one and len(one) == 150


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.standard_normal(4)]) for i in range(60)]
    rows += [(60, None), (61, [0.0] * 4), (62, [1.0, None, 0.0, 0.0]), (63, [float("nan")] * 4), (64, [float("inf"), 0.0, 0.0, 1.0]), (65, [1.0, 2.0])]
    rows += [(None, [1.0, 1.0, 1.0, 1.0]), (80, []), *[(100 + i, [9.0, 0.0, 0.0, 0.0]) for i in range(30)]]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("mine"))
    got = defaultdict(list)
    for r in sorted(ann.search(df, F.col("vec_id") % 20 == 0, recall=0.9999).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
    v = {i: np.array(x) for i, x in rows if i is not None and i < 60 or i and i >= 100}
    assert set(got) == {0, 20, 40, 100, 120}
    for q, found in got.items():
        assert not {60, 61, 62, 63, 64, 65, 80} & set(found) and len(found) == 20
        if q >= 100:  # all copies tie: smaller ids first
            assert found == [i for i in range(100, 130) if i != q][:20]
    assert np.mean([len(set(found) & set(sorted((i for i in v if i != q), key=lambda i: (-(v[q] @ v[i]), i))[:20])) for q, found in got.items()]) >= 18
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).isEmpty()
    assert ann.search(df.where("vec_id = 20"), F.col("vec_id") % 20 == 0).isEmpty()


def test_hot_buckets_are_split_and_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(ann, "BUCKET_ROWS", 10)
    monkeypatch.setattr(ann, "TASK_ROWS", 50)
    rng = np.random.default_rng(5)
    near = [(i, [float(x) for x in np.array([3.0, 1, 0, 0]) + 0.001 * rng.standard_normal(4)]) for i in range(200)]
    df = spark.createDataFrame(near, "vec_id long, embedding array<double>")
    v = np.array([x for _, x in near])
    for r in ann.search(df, F.col("vec_id") == 0, k=200, recall=0.9999).groupBy("query_id").agg(F.collect_set("vec_id").alias("ids")).collect():
        assert len(r.ids) >= 190 and len(v) == 200


def fixity_pages(spark):
    pages = [(i, f"http://h/{i}", "x" * (i * 37 % 3000)) for i in range(300)] + [(None, None, None), (5, "http://h/5", "again")]
    return spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("file", F.lit("mine")), len(pages)


def test_fixity_finds_altered_missing_and_extra(spark, monkeypatch):
    df, n = fixity_pages(spark)
    records = fixity.warc_records(df, per_file=100)
    held = fixity.digests(records)
    assert fixity.audit(held, held).isEmpty()
    changed = records.where("coalesce(record_id, 0) <> 17").withColumn(
        "bytes", F.when(F.col("record_id") == 250, F.lit("other")).otherwise(F.col("bytes"))
    )
    replica = fixity.digests(changed.unionByName(records.where("record_id = 40")))
    # offsets behind the lost record are those of the replica's own bytes
    place = lambda rows, i: rows.where(F.col("record_id") == i).first()["position"]
    lost = held.where("record_id = 17").first()["length"]
    assert place(replica, 30) == place(held, 30) - lost and place(replica, 16) == place(held, 16)
    got = {(r.record_id, r.status, r.copies) for r in fixity.audit(held, replica, range_bytes=2000).collect()}
    assert got == {(17, "missing", 1), (250, "altered", 1), (40, "extra", 1)}
    assert fixity.audit(held, fixity.digests(records.limit(0))).where("status = 'missing'").agg(F.sum("copies")).first()[0] == n
    empty = fixity.digests(records.limit(0))
    assert fixity.audit(empty, empty).isEmpty()
    rows = [(r.file, r.position, r.record_id) for r in held.collect()]
    sizes = {(r.file, r.position): r.length * r.copies for r in held.collect()}
    for file in {r[0] for r in rows}:  # gapless from 0, in order of the ids
        at = 0
        for _, position, _ in sorted((r for r in rows if r[0] == file), key=lambda r: r[1]):
            assert position == at
            at += sizes[file, position]
        ids = [r[2] for r in sorted((r for r in rows if r[0] == file), key=lambda r: r[1])]
        assert ids == sorted(ids, key=lambda i: -1 if i is None else i)


def test_fixity_equal_replicas_end_at_their_roots(spark, monkeypatch):
    df, _ = fixity_pages(spark)
    records = fixity.warc_records(df, per_file=10)
    a, b = fixity.digests(records), fixity.digests(records.repartition(3))
    levels = fixity.shape([a, b], 2000)
    assert levels[0] >= 1 and levels[1] >= 2
    trees = [fixity.tree(rows, levels, 2000) for rows in (a, b)]
    assert [t[-1].count() for t in trees] == [1, 1] and fixity.root(trees[0]) == fixity.root(trees[1])
    compared = []
    kept = fixity.stage
    monkeypatch.setattr(fixity, "stage", lambda rows, purpose: compared.append(purpose) or kept(rows, purpose))
    assert fixity.differing(*trees, levels[0]).isEmpty() and compared == ["suspects"]
    other = fixity.digests(records.where("coalesce(record_id, 0) <> 123"))
    assert fixity.root(fixity.tree(other, fixity.shape([other, a], 2000), 2000)) != fixity.root(trees[0])
    assert [(r.record_id, r.status, r.file) for r in fixity.audit(a, other, 2000).collect()] == [(123, "missing", 12)]
    assert fixity.root(fixity.tree(a.limit(0), levels, 2000)) is None


def test_fixity_of_repeated_and_odd_records(spark):
    rows = [(0, 1, "same")] * 500 + [(0, 1, f"text {i}") for i in range(50)] + [(None, None, None)] * 40 + [(-7, 3, ""), (-7, 4, "four")]
    schema = "file long, record_id long, bytes string"
    held = fixity.digests(spark.createDataFrame(rows, schema))
    assert held.agg(F.sum("copies")).first()[0] == len(rows)
    other = [(0, 1, "same")] * 497 + [(0, 1, f"text {i}") for i in range(1, 50)] + [(None, None, None)] * 41 + [(-7, 3, "x"), (-7, 4, "four"), (-7, 4, "four")]
    got = {(r.file, r.record_id, r.status, r.copies) for r in fixity.audit(held, fixity.digests(spark.createDataFrame(other, schema)), 100).collect()}
    assert got == {(0, 1, "missing", 3), (0, 1, "missing", 1), (-1, None, "extra", 1), (-7, 3, "altered", 1), (-7, 4, "extra", 1)}
    placed = fixity.digests(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", position long"))
    assert placed.count() == len(rows) and fixity.audit(placed, placed).isEmpty()


def brute_kneser_ney(training, text, order):
    """Interpolated modified Kneser-Ney from its definition, on the same padded characters."""

    def grams(t):
        s = ["^"] * (order - 1) + list(" ".join(t.split())) + ["$"]
        return [tuple(s[i - order + 1 : i + 1]) for i in range(order - 1, len(s))]

    a = {order: Counter(g for t in training for g in grams(t))}
    for k in range(order - 1, 0, -1):
        a[k] = Counter(g[1:] for g in a[k + 1])
    d = {}
    for k in a:
        t = [sum(1 for c in a[k].values() if c == i) for i in (1, 2, 3, 4)]
        d[k] = kneser_ney.Model._discount({**{f"t{i + 1}": t[i] for i in range(4)}, "types": len(a[k])})
    context = {k: defaultdict(Counter) for k in a}
    for k in a:
        for g, c in a[k].items():
            context[k][g[:-1]][g] = c

    def p(g):
        if not g:
            return 1 / (len(a[1]) + 1)
        k, seen = len(g), context[len(g)].get(g[:-1])
        if not seen:
            return p(g[1:])
        cut = lambda c: 0 if not c else d[k][min(c, 3) - 1]
        c = seen.get(g, 0)
        return (c - cut(c)) / sum(seen.values()) + sum(map(cut, seen.values())) / sum(seen.values()) * p(g[1:])

    logs = [math.log10(p(g)) for g in grams(text)]
    return -sum(logs) / len(logs)


def test_perplexity_equals_its_definition(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang = 'en' and length(text) < 3000").limit(14).cache()
    rows = {r.doc_id: r.text for r in docs.collect()}
    trusted = np.array(sorted(rows)[:8])
    model = kneser_ney.Model(kneser_ney.count_grams(docs, trusted, 3), 3)
    got = {r.doc_id: r.log10_perplexity for r in kneser_ney.perplexities(docs, model).collect()}
    training = [rows[i] for i in trusted.tolist()]
    assert set(got) == set(rows)
    for i, text in rows.items():
        assert abs(got[i] - brute_kneser_ney(training, text, 3)) < 1e-9
    docs.unpersist()


def test_perplexity_keeps_good_documents_and_odd_rows(spark, odd, none):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    rows = queries.QUERIES["op3_kneser_ney_quality"](spark, MIDDLE).collect()
    quality = {r.doc_id: r.quality for r in labels.collect()}
    good, bad = ([r.kept for r in rows if quality.get(r.doc_id) == q] for q in (1, 0))
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.2
    mine = spark.createDataFrame([(6, 1), (4, 1), (None, 1), (9, 0)], "doc_id long, quality int")
    got = kneser_ney.classify(odd, mine)
    kept = got.collect()
    assert len(kept) == len(ODD) and set(odd.columns) <= set(got.columns)
    assert Counter((r.doc_id, r.text, r.lang) for r in kept) == Counter(r[:3] for r in ODD)
    assert all(r.kept for r in kept if r.lang in ("xx", "fr"))
    assert all(r.n_tokens == 1 for r in kept if not words(r.text))
    assert kneser_ney.classify(none, mine).isEmpty() and kneser_ney.classify(odd, mine.limit(0)).where("kept").count() == len(ODD)


def test_rare_language_has_a_limit_among_many_trusted_documents(spark):
    """Of 40,000 trusted documents three are of a rare language, whose junk has to go as on a small table."""
    rare = [(i, "bb", f"the quick brown fox jumps over the lazy dog again and again {i % 7} times") for i in RARE]
    rows = [(i, "aa", f"a note of {i % 101} words") for i in range(40_000) if i not in RARE] + rare + [(50_000, "bb", "zq#xv~ kjw$ " * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = kneser_ney.classify(docs, docs.where("doc_id < 50000").select("doc_id", F.lit(1).alias("quality")))
    bb = {r.doc_id: r for r in got.where("lang = 'bb'").collect()}
    assert bb[50_000].threshold is not None and not bb[50_000].kept


@pytest.mark.parametrize("each", [12, 60])
def test_unseen_good_documents_are_kept(spark, each):
    """Trusted are the first few good documents of each language; the other good ones have no label."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang", "text")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    by_lang = defaultdict(list)
    for i, lang in sorted((r.doc_id, r.lang) for r in docs.select("doc_id", "lang").collect()):
        if quality.get(i) == 1:
            by_lang[lang].append(i)
    trusted = {i for ids in by_lang.values() for i in ids[:each]}
    judged = docs.where(F.col("doc_id").isin([i for i in quality if i in trusted or i % 3 == 0]))
    labels = spark.createDataFrame([(i, 1) for i in sorted(trusted)], "doc_id long, quality int")
    rows = kneser_ney.classify(judged, labels).drop("text").collect()
    unseen = [r.kept for r in rows if quality[r.doc_id] == 1 and r.doc_id not in trusted]
    bad = [r.kept for r in rows if quality[r.doc_id] == 0]
    assert len(unseen) >= 100 and np.mean(unseen) >= (0.9 if each < 50 else 0.95) and np.mean(bad) <= 0.2, (len(unseen), np.mean(unseen), len(bad), np.mean(bad))


def test_fitting_takes_small_languages_whole(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 7, "bb").otherwise("aa").alias("lang"), F.lit("x").alias("text"))
    ids = kneser_ney.trusted_ids(docs, docs.select("doc_id", F.lit(1).alias("quality")), 60)
    assert len(ids) == 60 and set(range(7, 1000, 100)) <= set(ids.tolist())
    assert [kneser_ney._level(n, 10) for n in ([3, 4], [1, 20], [9, 9, 9], [1] * 30)] == [10, 9, 3, 1]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = [("moron", False), ("trash", False), ("ape", False), ("vequ", True)]
    step, classes, found = toxicity.build_automaton(terms)
    lexicon = toxicity.Lexicon(terms, np.ones((4, 2)), step, classes, found)
    letters = "aehmnoprstquvx"
    rng = np.random.default_rng(1)
    cases = ["".join(rng.choice(list(letters), rng.integers(1, 7))) for _ in range(300)]
    cases += ["".join(t) for w, _ in terms for t in itertools.product(*[[c] for c in w])]
    for w, _ in terms:
        for i in range(len(w)):
            cases += [w[:i] + w[i + 1 :], w[:i] + "x" + w[i + 1 :], w[:i] + "7" + w[i:], w[:i] + w[i] + w[i:]]
        cases += [w + "s", w + "ance", "x" + w]
    for case in [c for c in cases if c]:
        got = [(lexicon.terms[t][0], d) for _, t, d, _ in toxicity.matches(lexicon, [case])]
        want = []
        for w, stem in terms:
            if stem:
                want += [(0, w)] if case.startswith(w) else []
            elif case == w:
                want.append((0, w))
            elif len(w) >= toxicity.FUZZY_LENGTH and case[0] == w[0] and distance(case, w) == 1:
                want.append((1, w))
        assert (min(want)[0] if want else None) == (got[0][1] if got else None), (case, want, got)


def test_edits_of_the_first_letter():
    terms = [("vequ", True), ("vequance", False), ("moron", False), ("trash", False), ("ape", False)]
    lexicon = toxicity.Lexicon(terms, np.ones((5, 2)), *toxicity.build_automaton(terms, first=True))
    rng = np.random.default_rng(2)
    cases = ["".join(rng.choice(list("aehmnorstqu"), rng.integers(1, 8))) for _ in range(300)]
    for w, _ in terms:
        for i in range(len(w) + 1):
            cases += [w[:i] + w[i + 1 :], w[:i] + "x" + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + w[i : i + 1] + w[i:]]
    for case in [c for c in cases if c]:
        want = [(0, k) for k, (w, stem) in enumerate(terms) if (case.startswith(w) if stem else case == w)]
        want += [(1, k) for k, (w, stem) in enumerate(terms) if not stem and len(w) >= toxicity.FUZZY_LENGTH and distance(case, w) == 1]
        assert [(d, t) for _, t, d, _ in toxicity.matches(lexicon, [case])] == sorted(want)[:1], case


def test_words_of_a_stem_keep_their_misspellings(spark):
    forms = ["vequance", "vequish", "vequoid", "vequster"]
    rows = [(i, f"you are such a {forms[i % 4]} and so on {i}", 1) for i in range(80)] + [(100 + i, f"you are such a friend and so on {i}", 0) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.learn(docs, docs.select("doc_id", "toxic"))
    assert ("vequ", True) in lexicon.terms
    assert all(toxicity.evidence(lexicon, [f"a {w} here"])[0] > 0 for w in [*forms, "xequance", "vxquance", "veqquish", "equster", "vequiness"])


def test_lexicon_has_no_share_or_count_cap(spark):
    """450 insults in 12 of 5,400 toxic documents each: under 1 %, and more than 400 of them."""
    rng = np.random.default_rng(4)
    insults = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(450)]
    rows = [(i, f"you {insults[i % 450]} there", 1) for i in range(5_400)] + [(10_000 + i, "you friend there", 0) for i in range(5_400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    # no document is held out
    lexicon = toxicity.learn(docs, docs.select("doc_id", "toxic"), folds=1, held_out=1)
    assert set(insults) <= {t for t, _ in lexicon.terms}
    assert (toxicity.evidence(lexicon, [f"a {w} here" for w in insults]) > 0).all() and toxicity.evidence(lexicon, ["you friend there"])[0] == 0


def test_quotation_counts_less_than_abuse():
    terms = [("moron", False)]
    lexicon = toxicity.Lexicon(terms, np.full((1, 2), 4.0), *toxicity.build_automaton(terms))
    score = lambda t: toxicity.evidence(lexicon, [t])[0]
    assert score("you are a Moron, really") == 4.0 == score("what a mor0n!") and score("all is well") == 0.0
    assert 0 < score('he never used "moron" in his letters') < 4.0 and 0 < score("somebody said moron once") < 4.0
    assert list(toxicity.evidence(lexicon, ["", "a moron", " ", "moron moron"])) == [0.0, 4.0, 0.0, 4.0]


def test_toxicity_on_held_out_labels_and_odd_rows(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op5_levenshtein_toxicity"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(label[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in label]
    assert np.mean([p for t, p in held if t == 1]) >= 0.85 and np.mean([p for t, p in held if t == 0]) <= 0.01
    labels = spark.createDataFrame([(6, 1), (4, 0), (None, 1), (1, None)], "doc_id long, toxic int")
    for given in (labels, labels.limit(0)):
        lexicon = toxicity.learn(odd, given)
        assert toxicity.score(odd, lexicon).count() == len(ODD) and toxicity.score(none, lexicon).isEmpty()


def test_words_are_hashed_as_they_are_split():
    texts = ["Ab ab\tAB", "", "x" * 200 + "\n" + "x" * 200 + "y", " é\x0bé "]
    got = Words(texts, lower=True)
    hashes = dict(zip([w for t in texts for w in words(re.sub("[A-Z]", lambda m: m[0].lower(), t))], got.hash))
    assert got.count.tolist() == [3, 0, 2, 2] and len(set(hashes.values())) == len(hashes) == 4
    assert got.document.tolist() == [0, 0, 0, 2, 2, 3, 3]


def test_gradient_of_the_recurrent_network():
    """Backpropagation against finite differences, through one window."""
    classes = gru_lm.Classes([1, 2], [(1, 0, 1)], np.ones(gru_lm.CLASSES), np.ones(gru_lm.CLASSES), np.array([5.0]))
    start = gru_lm.start_parameters(classes)
    rng = np.random.default_rng(0)
    symbols = rng.choice([1, 8, 16], (13, 3)).astype(np.int64)
    start["E"] *= np.float32(0.5)

    def loss(p):
        return gru_lm.Trainer({k: v.astype(np.float64) for k, v in p.items()}, 0.0)._window(symbols[:-1], symbols[1:], np.zeros((3, gru_lm.HIDDEN)))[0]

    trainer = gru_lm.Trainer({k: v.astype(np.float64) for k, v in start.items()}, 0.0)
    trainer._window(symbols[:-1], symbols[1:], np.zeros((3, gru_lm.HIDDEN)))
    for name in ("Wh", "Wx", "E", "Wc", "Ws", "b"):
        gradient = trainer.m[name] / 0.1 * 3
        at = np.unravel_index(np.argmax(np.abs(np.where(np.abs(gradient) < 2.5, gradient, 0))), gradient.shape)
        moved = []
        for sign in (1, -1):
            p = {k: v.astype(np.float64) for k, v in start.items()}
            p[name][at] += sign * 1e-4
            moved.append(loss(p))
        assert abs((moved[0] - moved[1]) / 2e-4 - gradient[at]) < 2e-3 * max(1, abs(gradient[at])), name


def test_language_model_counts_and_sums_to_one(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    tokens = {i: [*words(re.sub("[A-Z]", lambda m: m[0].lower(), t)), None] for i, t in docs.items()}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1]
    count = Counter(w for i in train for w in tokens[i])
    n, v = sum(count.values()), len(count)
    rows = {r.doc_id: r for r in queries.QUERIES["op8_gru_log_likelihood"](spark, SMALL).collect()}
    assert set(rows) == set(docs)
    for i, r in rows.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens[i]), sum(count[w] > 0 for w in tokens[i]), n)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert abs(r.base_score - sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[i])) < 1e-6
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_class_factored_probabilities_sum_to_one():
    classes = gru_lm.Classes([1, 2], [(1, 0, 1), (77, 1, 1)], np.array([0, 6.0, 2.0, *[0.0] * 61]), np.array([0, 3.0, 1.0, *[0.0] * 61]), np.array([4.0, 5.0]))
    p = gru_lm.start_parameters(classes)
    every = np.arange(gru_lm.CLASSES * gru_lm.SLOTS)
    # one document of one token: the first token's distribution over classes and slots
    total = sum(math.exp(gru_lm.log_probabilities(p, np.array([s]), np.array([1]))[0]) for s in every)
    assert abs(total - 1) < 1e-4
    # the rest of class 1: its three words with counts 1, 2, 3 and the unknown one
    assert abs(sum((c + 0.5) / (6 + 0.5 * 4) for c in (1, 2, 3, 0)) - 1) < 1e-12


def test_state_is_carried_over_windows():
    classes = gru_lm.Classes([1], [(1, 0, 1)], np.ones(gru_lm.CLASSES), np.ones(gru_lm.CLASSES), np.array([3.0]))
    p = gru_lm.start_parameters(classes)
    rng = np.random.default_rng(4)
    docs = [rng.choice([8, 16, 24], n) for n in (100, 3, 57)]
    alone = [gru_lm.log_probabilities(p, d, np.array([len(d)])) for d in docs]
    together = gru_lm.log_probabilities(p, np.concatenate(docs), np.array([100, 3, 57]))
    assert np.allclose(np.concatenate(alone), together, atol=1e-5)


def test_language_model_of_odd_rows(odd, none):
    got = gru_lm.score(odd).collect()
    assert len(got) == len(ODD) and Counter(r.doc_id for r in got) == Counter(r[0] for r in ODD)
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert gru_lm.score(none).isEmpty()


def test_pipeline_stages_work_on_what_is_kept(spark, texts):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, set(texts)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "near-duplicates", "source mixing", "best-fit packing"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    for i, (name, apply) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.stage(apply(spark, docs, SMALL), "test")
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(ids) <= kept
        if i < 3:
            assert docs.columns == columns and len(ids) == len(set(ids)) < len(kept)
        if i == 3:
            assert docs.columns == columns and set(ids) == kept and len(ids) > len(kept)
        if i == 1:
            assert not [d for d in ids if labels.get(d) == 0]
        kept = set(ids)
    assert "sequence_id" in docs.columns


@pytest.mark.parametrize("n,long", [(14, 1), (3000, 10), (3000, 1000)])
def test_every_query_has_all_its_results(spark, n, long):
    """Small tables, and one vector that makes all others look alike, at the default settings."""
    v = np.random.default_rng(n + long).standard_normal((n, 16))
    v[n // 2] *= long
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = min(20, n - 1)
    assert set(got) == set(range(0, n, 20)) and all([r for r, _ in g] == list(range(1, want + 1)) for g in got.values())
    found = 0
    for q, hits in got.items():
        order = sorted((i for i in range(n) if i != q), key=lambda i: (-float(v[q] @ v[i]), i))[:want]
        found += len(set(order) & {i for _, i in hits})
    assert found >= 0.9 * want * len(got)


def test_letters_beyond_the_low_planes_are_read():
    terms = [("漢字仮名交", False), ("\U00020000\U00020001\U00020002abc", False), ("plainly", False)]
    lexicon = toxicity.Lexicon(terms, np.ones((3, 2)), *toxicity.build_automaton(terms))
    texts = ["a 漢字仮名交 b", "漢字仮名", "\U00020000\U00020001\U00020002abc", "plainly \u2fff\u3000 \uffff", "漢漢漢漢漢"]
    got = [{lexicon.terms[t][0] for _, t, d, _ in toxicity.matches(lexicon, [x]) if d == 0} for x in texts]
    assert got == [{terms[0][0]}, set(), {terms[1][0]}, {terms[2][0]}, set()]


def test_all_trusted_documents_are_counted_in_folds_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "SMALL_LANGUAGE", 100)
    docs = spark.createDataFrame([(i, "de" if i < 1000 else "fi" if i < 1004 else "la", f"wort {i % 7}") for i in range(1005)], "doc_id long, lang string, text string")
    folds = kneser_ney.fitting(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    dealt = {r._id: r._fold for r in folds.collect()}
    assert sorted(dealt) == list(range(1005)) and dealt[1004] == -1
    assert {dealt[i] for i in range(1000)} == set(range(5)) and len({dealt[i] for i in range(1000, 1004)}) == 4
    counted = kneser_ney.count_grams(docs, folds, 2).where("lang = 'de'").agg(F.sum("a0").alias("n")).first().n
    assert counted == 1000 * (len("wort 1") + 1)
