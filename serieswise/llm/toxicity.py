"""Toxicity by Levenshtein automata intersected with a lexicon trie.

The lexicon is learned from labelled documents: words, and word beginnings ("stems"), that
toxic training documents hold far more often than others: a term is admitted by its smoothed log
odds and LEAST_DOCS, however small its share and however many terms there are, so a term keeps
its place when more documents use it at the same rate. The trie of the lexicon and the
Levenshtein automaton of distance 1 are walked together once, on the driver, into one
deterministic automaton: its states are sets of (trie node, edits used). Reading a word in it
finds the terms within the distance, misspellings of any letter included, and all words of a
batch are read side by side in numpy. A stem matches as it is written; the learned words that
begin with it stay terms beside it, for their misspellings. Words of fewer than FUZZY_LENGTH
letters match only as they are, since most words of that length are one edit from another.

What a misspelling of a term is worth is learned for each term from the sample, drawn towards half
the worth of the term, as an edit often gives an innocent word.

A match counts by its term, by its distance and by its context: a window of characters around
it tells a quotation (quotation marks before and after, or a word that reports speech) from
abuse, and a quoted match counts less. Logistic regression on the same labelled documents
turns a document's evidence into a score.

The training sample is bounded by `max_training` documents of each label, the smallest by a
hash of their id; scoring reads whole texts of all documents. Null and empty texts have no
match and get the score of no evidence. Repeated rows are scored alike. Empty tables of
documents give an empty result; without toxic training documents the lexicon is empty and
every document gets the smoothed base rate. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieswise.llm.common import bounded_sample, remainder

MAX_TRAINING = 10_000
STEM = (4, 7)
#: A term occurs in as many toxic training documents at least.
LEAST_DOCS = 4
LEAST_LOG_ODDS = 3.0
#: Words shorter than this match only without an edit.
FUZZY_LENGTH = 5
CONTEXT = 40
QUOTED = 0.35
MARKS = "\"'“”„«»‘’"
REPORTING = ("said", "says", "quote", "quoted", "called", "wrote", "word")

#: Up to the last plane that holds punctuation and symbols; code points beyond are letters.
_EDGE = np.array([not chr(i).isalnum() for i in range(0x20000)], bool)
#: The last space is U+3000; the entry after it stands for all code points beyond.
_SPACE = np.array([chr(i).isspace() for i in range(0x3002)], bool)


@dataclass
class Lexicon:
    """Terms with weights, and their automaton: `step[state, character class]`, state 0 is dead."""

    terms: list[tuple[str, bool]] = field(default_factory=list)  # (text, is a stem)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))  # by term and distance
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 1), np.int32))
    classes: dict[int, int] = field(default_factory=dict)
    found: np.ndarray = field(default_factory=lambda: np.full((2, 2), -1, np.int32))  # by state: term and distance, -1 none
    bias: float = 0.0
    slope: float = 1.0


def build_automaton(terms: list[tuple[str, bool]], first: bool = False) -> tuple[np.ndarray, dict[int, int], np.ndarray]:
    """Subset construction over (trie node, edits). Reading a stem to its end accepts any rest of the word.

    With `first` the first letter may be edited too.
    """
    trie: list[dict[str, int]] = [{}]
    end: dict[int, list[int]] = {}
    limit: list[int] = [0]
    for k, (text, _) in enumerate(terms):
        node = 0
        for c in text:
            if c not in trie[node]:
                trie[node][c] = len(trie)
                trie.append({})
                limit.append(0)
            node = trie[node][c]
        end.setdefault(node, []).append(k)
    # edits are allowed below a node if any term there is long enough; stems match without edits only
    fuzzy = [False] * len(trie)
    for k, (text, stem) in enumerate(terms):
        if not stem and len(text) >= FUZZY_LENGTH:
            node = 0
            fuzzy[0] = True
            for c in text:
                node = trie[node][c]
                fuzzy[node] = True
    letters = sorted({c for node in trie for c in node})
    classes = {ord(c): i + 1 for i, c in enumerate(letters)}  # class 0: any other character

    def closed(items: set[tuple]) -> frozenset:
        """With deletions: a letter of the term that the word lacks."""
        out = set(items)
        for node, edits in items:
            if (node > 0 or first and node == 0) and edits == 0:
                out |= {(n, 1) for n in trie[node].values() if fuzzy[n]}
        # a node reached without an edit finds all that it finds with one
        return frozenset((node, edits) for node, edits in out if not edits or (node, 0) not in out)

    def advance(state: frozenset, c: str | None) -> frozenset:
        out: set[tuple] = set()
        for node, edits in state:
            if node < 0:  # -1 - k: a stem k that has been read
                out.add((node, edits))
                continue
            if c in trie[node]:
                out.add((trie[node][c], edits))
            if edits == 0:
                if fuzzy[node] and (node or first):
                    out.add((node, 1))
                    out |= {(n, 1) for n in trie[node].values() if fuzzy[n]}
        for node, edits in list(out):
            if node >= 0 and edits == 0:
                out |= {(-1 - k, 0) for k in end.get(node, ()) if terms[k][1]}
        return closed(out)

    def accepts(state: frozenset) -> tuple[int, int]:
        hits = [(0, -1 - node) for node, _ in state if node < 0]
        for node, edits in state:
            if node >= 0:
                hits += [(edits, k) for k in end.get(node, ()) if not terms[k][1] and (not edits or len(terms[k][0]) >= FUZZY_LENGTH)]
        return min(hits)[::-1] if hits else (-1, 0)

    start = closed({(0, 0)})
    number, queue, rows = {frozenset(): 0, start: 1}, [start], {0: [0] * (len(letters) + 1)}
    for state in queue:
        row: list[int] = []
        # letters that no node of the state continues with lead where any other character does
        for c in [None, *sorted({c for node, _ in state if node >= 0 for c in trie[node]})]:
            target = advance(state, c)
            if target not in number:
                number[target] = len(number)
                queue.append(target)
            if c is None:
                row = [number[target]] * (len(letters) + 1)
            else:
                row[classes[ord(c)]] = number[target]
        rows[number[state]] = row
    step = np.array([rows.pop(i) for i in range(len(number))], np.int32)
    found = np.array([accepts(s) for s in sorted(number, key=number.get)], np.int32).reshape(-1, 2)
    return step, classes, found


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case code points of all texts, word starts and ends without edge punctuation, document of each word."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) + 1 for t in low], np.int64)
    space = _SPACE[np.minimum(points, len(_SPACE) - 1)]
    bounds = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, stop = bounds[0::2].copy(), bounds[1::2].copy()
    edge = _EDGE[np.minimum(points, len(_EDGE) - 1)] & (points < len(_EDGE))
    for at, move, shift in ((start, 1, 0), (stop, -1, -1)):
        live = np.arange(len(at))
        while len(live):
            live = live[(start[live] < stop[live])]
            live = live[edge[at[live] + shift]]
            at[live] += move
    document = np.searchsorted(np.cumsum(lengths), start, side="right")
    return points, start, stop, document


def _read(lexicon: Lexicon, points: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Final automaton state of each word."""
    letters = np.array(sorted(lexicon.classes), np.uint32)
    kinds = np.array([lexicon.classes[c] for c in sorted(lexicon.classes)], np.int32)
    low = np.zeros(0x3000, np.int32)  # most letters by a lookup, the others by a search
    near = letters < len(low)
    low[letters[near]] = kinds[near]

    def kind_of(c: np.ndarray) -> np.ndarray:
        out = low[np.minimum(c, len(low) - 1)]
        far = np.flatnonzero(c >= len(low) - 1)
        if len(far):
            at = np.minimum(np.searchsorted(letters, c[far]), max(0, len(letters) - 1))
            out[far] = np.where(letters[at] == c[far], kinds[at], 0) if len(letters) else 0
        return out

    state = np.ones(len(start), np.int32)
    state[start >= stop] = 0
    live, at = np.flatnonzero(state), start.copy()
    while len(live):
        c = points[at[live]]
        state[live] = lexicon.step[state[live], kind_of(c)]
        at[live] += 1
        live = live[(state[live] != 0) & (at[live] < stop[live])]
    return state


def _quoted(text: str, start: int, stop: int) -> bool:
    before, after = text[max(0, start - CONTEXT) : start], text[stop : stop + CONTEXT]
    marks = any(m in before for m in MARKS) and any(m in after for m in MARKS)
    # an apostrophe inside a word is no quotation mark: one must touch a word's edge
    opened = any(m in MARKS and (i == 0 or before[i - 1].isspace()) for i, m in enumerate(before))
    return (marks and opened) or any(w in REPORTING for w in before.lower().split()[-3:])


def matches(lexicon: Lexicon, texts: list[str]) -> Iterator[tuple[int, int, int, bool]]:
    """(place of the text, term, distance, quoted) of every match."""
    points, start, stop, document = _words(texts)
    found = lexicon.found[_read(lexicon, points, start, stop)]
    low = [t.lower() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
    for i in np.flatnonzero(found[:, 0] >= 0):
        d = int(document[i])
        a, b = int(start[i] - offsets[d]), int(stop[i] - offsets[d])
        yield d, int(found[i, 0]), int(found[i, 1]), _quoted(low[d], a, b)


def evidence(lexicon: Lexicon, texts: list[str]) -> np.ndarray:
    """Summed weights of a document's matches; each further match of a term adds less."""
    out = np.zeros(len(texts))
    best: dict[tuple[int, int], float] = {}
    for d, term, distance, quoted in matches(lexicon, texts):
        w = lexicon.weights[term, distance] * (QUOTED if quoted else 1.0)
        best[d, term] = max(best.get((d, term), 0.0), w)
    for (d, _), w in best.items():
        out[d] += w
    return out


def _candidates(text: str) -> set[str]:
    points, start, stop, _ = _words([text])
    low = text.lower()
    words = {low[a:b] for a, b in zip(start.tolist(), stop.tolist()) if b > a}
    stems = {w[:n] + "*" for w in words for n in range(STEM[0], min(STEM[1], len(w) - 1) + 1)}
    return words | stems


def training_sample(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, bound: int = MAX_TRAINING) -> DataFrame:
    """Labelled documents outside the held-out fold, at most `bound` of each label."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != held_out))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for label in (0, 1):
        part = bounded_sample(known.where(F.col("toxic") == label), bound, "doc_id")
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * bound rows of two numbers
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")


def learn(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, bound: int = MAX_TRAINING) -> Lexicon:
    """Lexicon, weights and calibration from the bounded sample."""
    sample = training_sample(docs, labels, folds, held_out, bound)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        sizes = [0, 0]
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                sizes[label] += 1
                for w in _candidates(text):
                    seen.setdefault(w, [0, 0])[label] += 1
        seen[""] = sizes
        # a term's toxic share is judged in the whole sample; what no toxic document of the task holds still counts against it
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())],
            ["term", "clean", "toxic"],
        )

    counted = sample.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    counted = counted.where((F.col("term") == "") | ((F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") > F.col("clean")))).persist()
    size = counted.where(F.col("term") == "").collect()
    clean, toxic = (size[0]["clean"], size[0]["toxic"]) if size else (0, 0)
    lexicon = Lexicon()
    if toxic:
        odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
        good = counted.where((F.col("term") != "") & (odds >= LEAST_LOG_ODDS))
        # the sample bounds them: terms of LEAST_DOCS or more of at most `bound` toxic documents
        rows = good.select("term", "toxic", odds.alias("odds")).orderBy(F.desc("toxic"), F.length("term"), "term").collect()
        counts, weight = {r["term"]: r["toxic"] for r in rows}, {r["term"]: float(r["odds"]) for r in rows}
        words = sorted(t for t in counts if not t.endswith("*"))
        stems: set[str] = set()

        def covered(t: str) -> bool:
            return any(t[:n] + "*" in stems for n in range(STEM[0], min(STEM[1], len(t)) + 1))

        for t in counts:  # shorter ones of equal count come first
            if t.endswith("*") and not covered(t[:-1]):
                begun = words[bisect_left(words, t[:-1]) : bisect_left(words, t[:-1] + "\U0010ffff")]
                # what one word explains is no stem
                if max((counts[w] for w in begun), default=0) < 0.8 * counts[t]:
                    stems.add(t)
        # a stem finds the words that begin with it, but not their misspellings
        chosen = {t: weight[t] for t in stems} | {w: weight[w] for w in words if len(w) >= FUZZY_LENGTH or not covered(w)}
        # of equal distances the first term counts: the stem, for all its words
        kept = sorted(chosen, key=lambda t: (not t.endswith("*"), -counts[t], t))
        lexicon.terms = [(t.rstrip("*"), t.endswith("*")) for t in kept]
        lexicon.weights = np.array([[chosen[t], 0.0] for t in kept]).reshape(-1, 2)
        lexicon.step, lexicon.classes, lexicon.found = build_automaton(lexicon.terms, first=True)
    counted.unpersist()
    return calibrate(sample, lexicon)


def calibrate(sample: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Weights of distance 1 from what such matches say in the sample, then bias and slope by logistic regression."""

    def per_document(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hits: list[set[tuple[int, int, bool]]] = [set() for _ in range(len(pdf))]
            for d, term, distance, quoted in matches(lexicon, pdf["text"].tolist()):
                hits[d].add((term, distance, quoted))
            yield pd.DataFrame({"toxic": pdf["toxic"], "hits": [[4 * t + 2 * d + q for t, d, q in sorted(h)] for h in hits]})

    # at most 2 * bound rows, each of a number and its document's distinct matches
    rows = sample.select("text", "toxic").mapInPandas(per_document, "toxic int, hits array<long>").toPandas()
    y = rows["toxic"].to_numpy(float)
    hits = [[(int(h) >> 2, int(h) >> 1 & 1, int(h) & 1) for h in found] for found in rows["hits"]]
    if lexicon.terms and len(y):
        # of documents without an exact match, those with a misspelling of each term, clean and toxic
        near = np.zeros((len(lexicon.terms), 2))
        for label, found in zip(y.astype(int), hits):
            if found and all(distance for _, distance, _ in found):
                near[list({t for t, _, _ in found}), label] += 1
        # without such documents a misspelling counts half as much as the term, which one document is set against
        rate = math.log((y.sum() + 1) / ((1 - y).sum() + 1))
        half = 1 / (1 + np.exp(-(lexicon.weights[:, 0] / 2 + rate)))
        lexicon.weights[:, 1] = np.clip(np.log((near[:, 1] + half) / (near[:, 0] + 1 - half)) - rate, 0.0, lexicon.weights[:, 0])
    x = np.zeros(len(y))
    for i, found in enumerate(hits):
        best: dict[int, float] = {}
        for t, distance, quoted in found:
            best[t] = max(best.get(t, 0.0), lexicon.weights[t, distance] * (QUOTED if quoted else 1.0))
        x[i] = sum(best.values())
    # Newton's method with a small ridge; the labels' own share is the prior of a document without evidence
    w = np.array([math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0.0, 1.0])
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - 0.01 * w
        curvature = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        move = np.linalg.solve(curvature, gradient)
        w = w + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    lexicon.bias, lexicon.slope = float(w[0]), float(max(w[1], 0.1))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every document; the automaton goes with the task, its size is bounded by the lexicon."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out = np.zeros(len(texts))
            begin = 0
            while begin < len(texts):  # slices of about four million characters
                stop, size = begin, 0
                while stop < len(texts) and (stop == begin or size + len(texts[stop]) < 4_000_000):
                    size += len(texts[stop])
                    stop += 1
                out[begin:stop] = evidence(lexicon, texts[begin:stop])
                begin = stop
            p = 1 / (1 + np.exp(-np.clip(lexicon.bias + lexicon.slope * out, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= threshold).astype("int32")), pa.array(out)], ["doc_id", "score", "predicted", "evidence"]
            )

    read = docs.select(F.col("doc_id").cast("long"), "text")
    return read.mapInArrow(scored, "doc_id long, score double, predicted int, evidence double")


__all__ = ["Lexicon", "build_automaton", "calibrate", "evidence", "learn", "matches", "score", "training_sample"]
