"""Fill-in-middle, chat formatting and the dataset manifest against plain Python."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from serieswise.llm import fim, queries

from .conftest import CLASHING, ODD


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- fill in the middle


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 400), max_size=600), st.sampled_from([1, 3, 31, 200]))
def test_index_finds_every_offset_within_its_error(gaps, error):
    offsets = np.cumsum([0, *gaps]).astype(np.int64)
    index = fim.fit_index(offsets, error)
    ranks = np.arange(len(offsets))
    assert (index.lookup(ranks) == offsets).all()
    assert np.abs(index.predict(ranks) - offsets).max() <= error
    assert (np.diff(index.first) > 0).all() and index.first[0] == 0


def test_segments_are_few_where_the_text_is_even():
    ascii_ = fim.fit_index(np.arange(1_000_000, dtype=np.int64))
    assert len(ascii_.first) == 1 and not ascii_.residual.any()
    rng = np.random.default_rng(1)
    mixed = fim.fit_index(np.cumsum(rng.choice([1, 2], 400_000, p=[0.95, 0.05])).astype(np.int64))
    assert len(mixed.first) < 400 and mixed.residual.dtype == np.int8
    assert len(fim.fit_index(np.empty(0, np.int64)).first) == 0


@pytest.mark.parametrize("error", [1, 8, 31])
def test_segments_end_where_the_cone_closes(error):
    """Point by point instead of in blocks."""
    offsets = np.cumsum(np.random.default_rng(error).choice([1, 2, 3, 4], 5_000)).astype(np.int64)
    starts, at = [], 0
    while at < len(offsets):
        starts.append(at)
        low, high, end = -np.inf, np.inf, at + 1
        while end < len(offsets):
            rise, run = offsets[end] - offsets[at], end - at
            low, high = max(low, (rise - error + 0.5) / run), min(high, (rise + error - 0.5) / run)
            if low > high:
                break
            end += 1
        at = end
    assert fim.fit_index(offsets, error).first.tolist() == starts


def plain_fim(key, text, seed="1"):
    text = text or ""
    h = [int(sha(f"{seed}:{key}")[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fim_of_odd_rows(spark, odd, none):
    got = fim.fill_in_middle(odd)
    assert set(got.columns) == {*odd.columns, *fim.RESULT.names}
    rows = got.withColumn("back", fim.restored("output", "form")).collect()
    want = sorted(((i, *plain_fim("" if i is None else i, t)) for i, t, _, _ in ODD), key=str)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in rows), key=str) == want
    assert sorted(r.back for r in rows) == sorted(t or "" for _, t, _, _ in ODD)
    assert all(r[c] == "mine" for r in rows for c in CLASHING if c in odd.columns)
    assert fim.fill_in_middle(none).isEmpty()


def test_fim_replaces_columns_named_like_results_and_keeps_markers_plain(spark):
    texts = ["a<P>b" * 9, "<", "<<<<SS>P>", "x<S", "\U0001f600é<M", "<M>"] + ["P><S<>" * i for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    clash = df.withColumns({c: F.lit(1) for c in ("n", "form", "output", "_0", "_1", "_2", "r0", "r6")})
    rows = fim.fill_in_middle(clash, plain=0, spm=50).withColumn("back", fim.restored("output", "form")).collect()
    assert {r.doc_id: r.back for r in rows} == dict(enumerate(texts))
    assert {"psm", "spm", "plain"} == {r.form for r in rows} and all(r._0 == r.r6 == 1 for r in rows)
    assert all((r.form == "plain") == any(m in r.text for m in ("<P>", "<S>", "<M>")) for r in rows if r.text)


def test_fim_at_word_boundaries(spark, documents):
    rows = fim.fill_in_middle(documents, units="words", plain=0).withColumn("back", fim.restored("output", "form")).collect()
    for r in rows:
        assert r.back == r.text and r.n == len(fim.WORD_END.findall(r.text.encode()))
        if r.form != "plain":
            raw = r.text.encode()
            for cut, units in ((r.prefix_bytes, r.prefix_units), (r.prefix_bytes + r.middle_bytes, r.prefix_units + r.middle_units)):
                if units < r.n:  # behind a word, unless behind the last one, which takes the rest
                    assert len(fim.WORD_END.findall(raw[:cut])) == units
    with pytest.raises(ValueError, match="lines"):
        fim.fill_in_middle(documents, units="lines")


@pytest.mark.parametrize("chunk", [1, 5_000])
def test_fim_does_not_depend_on_chunks(documents, monkeypatch, chunk):
    texts = [r.text for r in documents.orderBy("doc_id").collect()]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([0, *[len(t.encode()) for t in texts]])
    monkeypatch.setattr(fim, "CHUNK_BYTES", chunk)
    out = []
    for low, high in fim._chunks(np.diff(ends)):
        out += fim._transform(list(range(low, high)), data[ends[low] : ends[high]], ends[low : high + 1] - ends[low], "1", 10, 20, "chars")
    assert [(n, form, p, m, o.decode()) for n, form, p, m, _, _, o in out] == [plain_fim(i, t) for i, t in enumerate(texts)]


# ---- the manifest


def plain_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(digests, fanout):
    """Levels from the leaves to one node, and the siblings of every leaf, level by level."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    paths = []
    for i in range(len(digests)):
        path = []
        for level in levels[:-1]:
            run = i // fanout * fanout
            path.append(("".join(level[run:i]), "".join(level[i + 1 : run + fanout])))
            i //= fanout
        paths.append(path)
    return levels[-1][0], paths


def plain_manifest(rows, fanout):
    """(key, group, leaf) rows with subroot, root and path."""
    groups = {}
    for key, group, digest in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(group, []).append((key, digest))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([d for _, d in groups[g]], fanout) for g in order}
    root, tops = plain_tree([trees[g][0] for g in order], fanout)
    return sorted(
        ((key, g, digest, trees[g][0], root, tuple(path + top)) for g, top in zip(order, tops) for (key, digest), path in zip(groups[g], trees[g][1])), key=str
    )


def got_manifest(df):
    return sorted(((r.key, r.grp, r.leaf, r.subroot, r.root, tuple(map(tuple, r.path))) for r in df.collect()), key=str)


@pytest.mark.parametrize("fanout,local", [(2, 0), (2, 1), (3, 1), (3, 2), (8, 1), (8, 3)])
def test_manifest_equals_plain_trees(spark, monkeypatch, fanout, local):
    """Ragged groups of many sizes, across parts of the order."""
    from serieswise.llm import manifest

    monkeypatch.setattr(manifest, "PART_ROWS", 40)
    sizes = {"a": 1, "b": 2, "c": 8, "d": 9, "é": 64, "E": 65, None: 73, "": 130, "f": 27, "g": 28}
    rows = [(int(i * 7919 % 1009), g, f"t{i}") for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "key long, grp string, text string").repartition(5)
    want = plain_manifest([(k, g, plain_leaf((k, g, t))) for k, g, t in rows], fanout)
    got = manifest.manifest(df, ["key", "grp", "text"], "key", "grp", fanout=fanout, local=local)
    assert got_manifest(got) == want
    folded = got.select((manifest.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"))
    assert folded.where("not ok").isEmpty()


def test_manifest_of_odd_rows(spark, odd, none):
    from serieswise.llm import manifest

    names = ["doc_id", "source", "lang", "text"]
    got = manifest.manifest(odd.withColumns({c: F.lit(1) for c in ("key", "leaf", "group", "total", "block", "_at")}), names, "doc_id", "lang")
    got = got.select(F.col("doc_id").alias("key"), F.col("lang").alias("grp"), "leaf", "claimed_leaf", "subroot", "root", "path")
    want = plain_manifest([(i, lang, plain_leaf((i, source, lang, t))) for i, t, lang, source in ODD], 8)
    assert got_manifest(got) == want and got.where("leaf <> claimed_leaf").isEmpty()
    assert manifest.manifest(none, names, "doc_id", "lang").isEmpty()
    one = manifest.manifest(odd.where("doc_id = 4"), names, "doc_id", "lang").first()
    assert one.leaf == one.subroot == one.root and one.path == []


def test_tampered_rows_are_told(spark):
    rows = queries.QUERIES["op13_butterfly_manifest"](spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = plain_manifest([(r.doc_id, r.lang, plain_leaf((r.doc_id, r.source, r.lang, r.n_chars, r.text))) for r in docs.values()], 8)
    want = {key: (digest, subroot, root, path) for key, _, digest, subroot, root, path in want}
    assert len(rows) == len(docs)
    for r in rows:
        d, (digest, subroot, root, path) = docs[r.doc_id], want[r.doc_id]
        assert (r.leaf, r.subroot, r.root) == (digest, subroot, root)
        assert r.proof_sha256 == sha("".join(a + b for a, b in path))
        text = d.text
        if zlib.crc32(str(r.doc_id).encode()) % 3 == 0:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        folded = plain_leaf((d.doc_id, d.source, d.lang, d.n_chars, text))
        for a, b in path:
            folded = sha(a + folded + b)
        assert r.folded_root == folded and r.verified == (text == d.text)
    assert 0 < sum(not r.verified for r in rows) < len(rows)


# ---- chat formatting

SCHEMA = """id int, record struct<messages:array<struct<role:string,content:string,name:string>>, conversations:array<struct<from:string,value:string>>,
 system:string, prompt:string, response:string, completion:string, instruction:string, input:string, output:string,
 pair:struct<question:string,answer:string>, dialogue:array<struct<speaker:string,text:array<string>>>, extra:bigint>"""
RECORDS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "tool", "content": None, "name": "x"}]}, "messages", [("user", "a"), ("tool", "")]),
    ({"messages": [{"role": None, "content": "b"}, None], "extra": 3}, "messages", [("", "b"), ("", "")]),
    ({"messages": [], "prompt": "unused copy"}, "messages", []),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}, {"from": "odd one>\n%", "value": ""}]}, "shared",
     [("user", "q"), ("assistant", "r"), ("odd one>\n%", "")]),
    ({"prompt": "p", "response": "r", "system": "s"}, "prompt", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"prompt": "p"}, "prompt", [("user", "p")]),
    ({"prompt": "", "completion": ""}, "completion", [("user", ""), ("assistant", "")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "output": "o", "extra": 1}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"pair": {"question": "q", "answer": None}}, "pair", [("user", "q")]),
    ({"pair": {"question": "q", "answer": "a"}}, "pair", [("user", "q"), ("assistant", "a")]),
    ({"prompt": "p", "response": "r", "instruction": "two layouts"}, None, None),
    ({"response": "an answer to nothing"}, None, None),
    ({"dialogue": [{"speaker": "bot", "text": ["parts", "of text"]}]}, None, None),
    ({"extra": 5}, None, None),
    ({}, None, None),
    (None, None, None),
]


def test_layouts_are_told_by_their_paths(spark):
    from serieswise.llm import chat

    df = spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(RECORDS)], SCHEMA)
    df = df.withColumns({c: F.lit("old") for c in ("layout", "turns", "held", "_kind", "prompt")})
    got = chat.format_chats(df)
    assert set(got.columns) == {*df.columns, *chat.RESULT}
    rows = got.select("*", chat.parsed("formatted").alias("back"), chat.loss_text("formatted", "loss_mask").alias("loss")).orderBy("id").collect()
    for r, (_, layout, turns) in zip(rows, RECORDS):
        assert r.layout == layout and r._kind == r.prompt == "old"
        if turns is None:
            assert r.turns is r.formatted is r.loss_mask is None
            continue
        assert [tuple(t) for t in r.turns] == [tuple(t) for t in r.back] == turns
        assert r.loss == "".join(t for role, t in turns if role == "assistant")
        assert sum(m.chars for m in r.loss_mask) == len(r.formatted)
    assert rows[-1].fingerprint is None and len({r.fingerprint for r in rows[:-1]}) == 15
    assert chat.format_chats(df.limit(0)).isEmpty()
    assert chat.format_chats(spark.createDataFrame([(1, (2,))], "id int, record struct<other:int>")).first().layout is None
    with pytest.raises(ValueError, match="id"):
        chat.format_chats(df, "id")


PARTS = ["<turn", "</turn>", "</turn>\n", "<turn user>\n", "\\", "<", "/turn", "turn", ">", "\n", "a", "é", "\U0001f600", "$1", "<\\turn", "<\\\\/turn"]


def test_texts_cannot_open_or_end_turns(spark):
    from serieswise.llm import chat

    rng = np.random.default_rng(4)
    texts = ["", *PARTS, *["".join(rng.choice(PARTS, rng.integers(1, 9))) for _ in range(400)]]
    records = [(i, {"messages": [{"role": "user", "content": t}, {"role": "assistant", "content": texts[-i]}]}) for i, t in enumerate(texts)]
    done = chat.format_chats(spark.createDataFrame(records, SCHEMA)).select("*", chat.parsed("formatted").alias("back"), chat.loss_text("formatted", "loss_mask").alias("loss"))
    for r in done.collect():
        assert [t.text for t in r.back] == [texts[r.id], texts[-r.id]] and r.loss == texts[-r.id]
        assert r.formatted.count("</turn>") == r.formatted.count("<turn ") == 2


def test_conversations_of_odd_rows(spark):
    from serieswise.llm import chat

    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (None, 0, "user", "x"),
            (None, None, None, None), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "w " * 300_000), (4, 0, "assistant", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("held", F.lit(1))
    done = chat.format_chats(chat.records_of_turns(df))
    got = {r.conv_id: (r.layout, [tuple(t) for t in r.back], r.loss) for r in done.select("*", chat.parsed("formatted").alias("back"), chat.loss_text("formatted", "loss_mask").alias("loss")).collect()}
    assert got == {
        1: ("shared", [("user", ""), ("assistant", "")], ""),
        2: ("messages", [("user", "a"), ("user", "a"), ("assistant", "b")], "b"),
        3: ("instruction", [("system", "s"), ("user", "u"), ("assistant", "w " * 300_000)], "w " * 300_000),
        4: ("messages", [("assistant", "only")], "only"),
        None: ("messages", [("", ""), ("user", "x")], ""),
    }
    assert chat.records_of_turns(df.limit(0)).isEmpty()


def test_chat_query_equals_the_table(spark):
    rows = queries.QUERIES["op12_schema_chat_format"](spark, "/root/testdata/sf0.001").collect()
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    turns = {-7: [("user", queries.HOSTILE), ("assistant", queries.HOSTILE)]}
    for r in sorted(table, key=lambda r: r.turn):
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert len(rows) == len(turns) and len({r.layout for r in rows}) >= 4
    for r in rows:
        own = turns[r.conv_id]
        loss = "".join(t for role, t in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{role}\n{t}\n" for role, t in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
