"""Sharding, mixing, rules, packing, duplicates: brute force on small tables, odd rows, empty tables."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from serieswise.llm import bagminhash, mixing, packing, queries, sharding, weak_rules

from .conftest import ODD, shingle_counts, words


def test_shards_differ_by_one_and_slots_have_no_gap(documents, odd, none):
    rows = sharding.shuffle_into_shards(documents, 24).select("doc_id", "shard", "slot").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents.select("doc_id").collect())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 24
    got = sharding.shuffle_into_shards(odd, 3)
    assert got.count() == len(ODD) and set(got.columns) == {*odd.columns, "shard", "slot"}
    assert {r["shard"]: r["count"] for r in got.groupBy("shard").count().collect()} == {0: 4, 1: 3, 2: 3}
    assert sharding.shuffle_into_shards(none, 3).isEmpty()


def test_communication_matrix_has_its_margins_and_mean():
    rows, shards = np.array([5, 0, 40, 15]), np.array([20, 20, 20])
    drawn = np.stack([sharding.communication_matrix(rows, shards, seed) for seed in range(400)])
    assert (drawn.sum(2) == rows).all() and (drawn.sum(1) == shards).all()
    assert np.abs(drawn.mean(0) - np.outer(rows, shards) / 60).max() < 0.5
    # variance of one cell of a hypergeometric draw
    assert abs(drawn[:, 2, 0].var() / (40 * (1 / 3) * (2 / 3) * (20 / 59)) - 1) < 0.3


def test_exponent_meets_entropy_and_repetition():
    shares = np.array([0.6, 0.2, 0.15, 0.05, 0.0])
    target = 1.3
    a = mixing.solve_exponent(shares, target_entropy=target)
    assert abs(mixing.entropy(mixing.tempered(shares, a)) - target) < 1e-9
    a = mixing.solve_exponent(shares, max_repeats=3.0)
    w = mixing.tempered(shares, a)[:4] / shares[:4]
    assert abs(w.max() / w.min() - 3.0) < 1e-6
    assert mixing.solve_exponent(np.zeros(3)) == 0.0 and mixing.solve_exponent(shares, max_repeats=1.0) == pytest.approx(1.0)


def test_exponents_beyond_one_and_targets_without_an_answer():
    shares = np.array([0.6, 0.2, 0.15, 0.05])
    for target in (1.0, 0.5, 0.01):  # below the entropy of the shares
        a = mixing.solve_exponent(shares, target_entropy=target)
        assert a > 1 and abs(mixing.entropy(mixing.tempered(shares, a)) - target) < 1e-9
    for targets in ({"target_entropy": 0.5, "max_repeats": 2.0}, {"max_repeats": 0.5}):
        with pytest.raises(ValueError):
            mixing.solve_exponent(shares, **targets)
    with pytest.raises(ValueError, match="no exponent brings"):
        mixing.solve_exponent(np.array([0.5, 0.5]), target_entropy=0.1)


def test_rows_of_files_keep_their_id_in_every_job(spark, documents, tmp_path):
    from serieswise.llm.common import identified

    documents.repartition(3).write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    for df in (read, read.where("doc_id % 3 > 0").select("doc_id"), read.select("doc_id").union(read.select("doc_id"))):
        rows = identified(df, "_id", "ids")
        once, again = ({r._id: r.doc_id for r in rows.repartition(n).select("_id", "doc_id").collect()} for n in (2, 5))
        assert once == again and len(once) == df.count() and rows.columns == [*df.columns, "_id"]
    assert identified(read.limit(0), "_id", "ids").isEmpty() and identified(read.where("doc_id < -9"), "_id", "ids").isEmpty()
    # a row given twice is no row of a file
    assert identified(read.select(F.explode(F.array("doc_id", "doc_id")).alias("doc_id")), "_id", "ids").select("_id").distinct().count() == 2 * read.count()


def test_mixture_gives_every_source_its_budget(documents, odd, none):
    docs = {r.doc_id: (r.source, len(words(r.text))) for r in documents.select("doc_id", "source", "text").collect()}
    rows = mixing.mix(documents, max_repeats=2.0).collect()
    given, total = Counter(), Counter()
    for r in rows:
        given[r.source] += r.n_tokens
        assert (r.source, r.n_tokens) == docs[r.doc_id]
    for source, n in docs.values():
        total[source] += n
    weight = {r.source: r.weight for r in rows}
    assert abs(sum(weight.values()) - 1) < 1e-9 and {r.doc_id for r in rows} == set(docs)
    rate = {s: weight[s] / total[s] for s in total}
    budget = 1 / min(rate.values())
    longest = max(n for _, n in docs.values())
    for s in total:  # never over the budget, and short of it by less than a document
        assert budget * weight[s] - longest <= given[s] <= budget * weight[s] + 1
    copies = Counter((r.doc_id, r.copy) for r in rows)
    assert max(copies.values()) == 1 and max(r.copy for r in rows) <= 2
    got = mixing.mix(odd, max_repeats=2.0)
    assert {r.doc_id for r in got.collect()} == {r[0] for r in ODD} and got.count() >= len(ODD)
    assert mixing.mix(none, max_repeats=2.0).isEmpty()


def test_rules_count_and_judge_odd_rows(odd, none):
    got = weak_rules.quality_rules(weak_rules.with_measures(odd))
    rows = got.collect()
    assert len(rows) == len(ODD) and set(odd.columns) <= set(got.columns)
    for r in rows:
        assert r.n_words == len(words(r.text)) and r.word_chars == sum(map(len, words(r.text)))
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert 0 <= r.posterior <= 1 and not (r.base_failed and r.kept)
    assert weak_rules.quality_rules(weak_rules.with_measures(none)).isEmpty()


def test_repeated_windows_are_counted_once(spark):
    unit = [f"w{i}" for i in range(9)]
    cases = [unit * 2, unit[:8] * 3, ["x"] * 30, unit + ["y"] + unit, ["x"] * 7, [f"z{i}" for i in range(40)]]
    df = spark.createDataFrame([(i, " ".join(c)) for i, c in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in weak_rules.with_measures(df).collect()}
    for i, c in enumerate(cases):
        windows = Counter(tuple(c[j : j + 8]) for j in range(len(c) - 7))
        covered = {j + k for j in range(len(c) - 7) if windows[tuple(c[j : j + 8])] > 1 for k in range(8)}
        assert got[i] == len(covered)


def test_rules_find_junk_and_leave_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op9_weak_supervision_rules"](spark, sf).collect()
    bad = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    good = [r.posterior >= 0.5 for r in rows if labels.get(r.doc_id) == 1]
    assert sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.97 * len(good)


def test_best_fit_decreasing_and_bounds():
    rng = np.random.default_rng(2)
    for n in (1, 7, 200):
        sizes = rng.integers(1, 4097, n)
        bins = packing.best_fit_decreasing(sizes)
        fill = np.bincount(bins, weights=sizes)
        assert fill.max() <= 4096 and packing.lower_bound(sizes) <= len(fill)
        # plain best fit decreasing
        rooms = []
        for s in sorted(sizes.tolist(), reverse=True):
            fits = [r for r in rooms if r >= s]
            if fits:
                best = min(fits)
                rooms.remove(best)
                rooms.append(best - s)
            else:
                rooms.append(4096 - s)
        assert len(rooms) == len(fill)
    # three of over a third each never share a bin of two: the volume bound alone would say 2
    assert packing.lower_bound(np.array([2049, 2049, 2049])) == 3
    assert packing.lower_bound(np.array([1400, 1400, 1400])) == 2
    assert packing.lower_bound(np.zeros(0, np.int64)) == 0


@pytest.mark.parametrize("per_task", [40, 100_000])
def test_packing_places_every_token_once(spark, documents, odd, per_task):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary())
    for docs in (documents, odd):
        pieces = packing.tokenized(docs, queries.vocabulary())
        rows = packing.pack(pieces, per_task=per_task).collect()
        wanted = Counter()
        for r in docs.select("doc_id", "text").collect():
            ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
            for k in range(0, len(ids), 4096):
                raw = np.array(ids[k : k + 4096], "<u4").tobytes()
                wanted[r.doc_id, k // 4096, k, len(raw) // 4, zlib.crc32(raw)] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
        assert len(bins) <= math.ceil(sum(r.length for r in rows) / 4096) * 1.02 + 1
    assert packing.pack(packing.tokenized(documents.limit(0), queries.vocabulary())).isEmpty()


def brute_classes(texts):
    sets = {i: shingle_counts(t) for i, t in texts.items()}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(a, b) for v in by.values() for a in v for b in v if a < b}:
        common = sum((sets[a] & sets[b]).values())
        if common >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - common):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in texts}


def test_duplicate_classes_equal_brute_force(spark, documents, texts):
    rng = np.random.default_rng(1)
    extra, base = dict(texts), " ".join(f"b{i}" for i in range(200)).split()
    for i in range(60):  # a loose group: neighbours are close, the ends are not
        copy = list(base)
        for j in rng.choice(200, 2, replace=False):
            copy[j] = f"c{i}-{j}"
        extra[10_000 + i] = " ".join(copy)
    df = spark.createDataFrame(list(extra.items()), "doc_id long, text string").repartition(6)
    rows = bagminhash.near_duplicates(df).collect()
    want = brute_classes(extra)
    assert {r.doc_id: r.class_id for r in rows} == want
    assert sum(r.kept for r in rows) == len(set(want.values()))
    size = Counter(want.values())
    assert all(r.class_size == size[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in rows)


def test_duplicates_of_odd_rows(odd, none):
    rows = bagminhash.near_duplicates(bagminhash.with_rows(odd)).collect()
    assert len(rows) == len(ODD)
    assert Counter(r.class_size for r in rows) == {1: len(ODD) - 2, 2: 2}
    assert sum(r.kept for r in rows) == len(ODD) - 1
    assert bagminhash.near_duplicates(none).isEmpty()


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    a = {int(k): int(v) for k, v in zip(rng.integers(0, 1 << 60, 120), rng.integers(1, 9, 120))}
    b = {k: max(1, v + int(rng.integers(-3, 4))) for k, v in a.items() if rng.random() < 0.8}
    want = sum(min(v, b.get(k, 0)) for k, v in a.items()) / (sum(a.values()) + sum(max(0, v - a.get(k, 0)) for k, v in b.items()))
    document = np.repeat([0, 1], [len(a), len(b)])
    element = np.array([*a, *b], np.uint64)
    weight = np.array([*a.values(), *b.values()])
    sig = bagminhash.signatures(document, element, weight, 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / 4096)


@pytest.mark.parametrize("block,elements", [(5, 10**9), (1000, 300), (1000, 10**9)])
def test_links_across_components_are_whole_and_few(spark, monkeypatch, block, elements):
    """Buckets of sets that drift apart: every class is found, with fewer links than members in each pair of blocks."""
    monkeypatch.setattr(bagminhash, "BUCKET_BLOCK", block)
    monkeypatch.setattr(bagminhash, "BLOCK_ELEMENTS", elements)
    rng = np.random.default_rng(9)
    sets, n = [], 90
    for i in range(n):
        base = set(rng.choice(10**6, 40, replace=False).tolist()) if i % 15 == 0 else set(sets[-1])
        if i % 15:
            for x in rng.choice(sorted(base), 2, replace=False).tolist():
                base.remove(x)
                base.add(int(rng.integers(10**6)))
        sets.append(sorted(base))
    left = spark.createDataFrame([(i % 2, i, i // 3 * 3) for i in range(n)] + [(7, i, i // 3 * 3) for i in range(n)], "band long, rid long, label long")
    named = spark.createDataFrame([(i, len(e), [1, 2, 3]) for i, e in enumerate(sets)], "rid long, n long, sig array<tinyint>")
    rows = spark.createDataFrame([(i, e) for i, e in enumerate(sets)], "rid long, elements array<long>")
    links = [(r.a, r.b) for r in bagminhash._across(left, named, rows).collect()]
    alike = lambda a, b: len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})
    assert all(alike(a, b) and a // 3 != b // 3 for a, b in links)

    def classes(pairs):
        top = list(range(n))
        for a, b in [(i, i // 3 * 3) for i in range(n)] + pairs:
            x, y = top[a], top[b]
            top = [min(x, y) if t in (x, y) else t for t in top]
        return top

    assert classes(links) == classes([(a, b) for a in range(n) for b in range(a) if alike(a, b)])
    if block == 1000 and elements == 10**9:
        assert len(links) < 3 * n


def test_word_caches_are_bounded_keep_words_in_use_and_are_given_up(texts, monkeypatch):
    import time

    monkeypatch.setattr(packing, "RECENT", 50)
    monkeypatch.setattr(packing, "IDLE_SECONDS", 0.2)
    encode, some = packing._Encoder(queries.vocabulary()), [t or "" for t in list(texts.values())[:30]]
    most = max(len(set(t.encode().split())) for t in some)
    with encode.in_use():
        for text in some:
            ids = np.frombuffer(b"".join(encode.texts([text])), "<u4").tolist()
            assert ids == encode.tokenizer.encode(text, add_special_tokens=False).ids
            assert len(encode.words.young) <= 50 + most and len(encode.words.old) <= 50 + most
        time.sleep(0.5)
        assert encode.words.young  # not while a task runs
    time.sleep(1)
    assert not (encode.words.young or encode.words.old or encode.runs.young or encode.runs.old)
    cache = packing._Recent()
    for i in range(500):
        assert cache.missing({"often"}) == ([] if i else ["often"])
        cache.young["often"] = 1
        cache.young.update({key: 0 for key in cache.missing({f"word{i}"})})


def test_runs_of_letters_have_the_tokenizers_ids():
    letters = [chr(x) for x in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)] if x not in (0xD7, 0xF7)]
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(letters, n)) + end for n in (1, 2, 3, 7, 40) for end in ("", ".", "'s", "...)") for _ in range(40)]
    words += [*letters, "\u212a", "x\u0301", "\u0130", "<|endoftext|>", "a1b", "naïve\u2019s", "日本", "\x1c", "\u00a0y"]
    plain, direct = packing._Encoder(queries.vocabulary()), packing._Encoder(queries.vocabulary())
    plain.whole_runs = False
    assert direct.whole_runs
    ids = [direct.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    for encode in (plain, direct):
        got = [np.frombuffer(raw, "<u4").tolist() for raw in encode.texts(words)]
        assert got == ids
        assert np.frombuffer(b"".join(encode.texts([" \n".join(words)])), "<u4").tolist() == [i for part in ids for i in part]
