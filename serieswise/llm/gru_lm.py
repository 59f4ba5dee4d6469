"""Log-likelihood of whole documents under a gated recurrent network with a class-factored softmax.

Tokens are words in lower case (A-Z) and an end. Every word has a class: the end its own, the
most frequent endings (last two bytes) one each, all other endings share one. The most frequent
words of a class have a slot of their own, the rest of the class shares slot 0. The network
reads class and slot of each token and gives p(class) and p(slot | class); within slot 0 a
word has its smoothed share of the class's counts, with one unknown type a class, so the
probabilities of all words sum to 1.

Word counts cover all training documents and grow with them: they are counted and joined in
shuffled tables. Documents are dealt to blocks of bounded size; a block asks for the counts
of its distinct words and gets them by the same key, so texts are exchanged once.

The network is trained in numpy by truncated backpropagation through time. A pilot on a bounded
sample sets a common start, then every task trains on all training tokens it reads, in many
parallel streams whose state is carried from window to window, and the tasks' parameters are
averaged, weighted by tokens. Scoring carries the state through each whole document.

Null and empty texts are one end token. Repeated rows are scored alike. An empty table gives an
empty result; without training documents all counts are 0 and the network keeps its start.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieswise.llm.common import bounded_sample, ceil_div, remainder, stage
from serieswise.llm.textnum import Words, slices

END = np.uint64(1)  # hash of the end token
CLASSES, SLOTS, WIDTH, HIDDEN = 64, 8, 16, 16
STREAMS, WINDOW = 512, 24
RATE, PILOT_RATE = 0.002, 0.01
PILOT_DOCS, PILOT_EPOCHS = 300, 4
#: Tokens trained on in one go; the next go starts its streams anew.
CHUNK = 1_000_000
BLOCK_BYTES = 12_000_000
#: Tokens whose softmax is taken at once in scoring.
SIDE = 16_384
#: A word with less than this share of all tokens has no slot, which bounds the words considered.
LEAST_SHARE = 1e-5


class Classes:
    """Class and slot of words; everything in it is bounded by the number of classes and slots."""

    def __init__(self, endings: list[int], words: list[tuple[int, int, int]], mass: np.ndarray, types: np.ndarray, counts: np.ndarray) -> None:
        self.by_ending = np.full(65536, CLASSES - 1, np.int16)
        self.by_ending[endings] = np.arange(1, len(endings) + 1)
        order = np.argsort(np.array([w[0] for w in words], np.uint64))
        self.top = np.array([words[i][0] for i in order], np.uint64)
        self.top_symbol = np.array([words[i][1] * SLOTS + words[i][2] for i in order], np.int16)
        self.top_count = counts[order] if len(order) else np.zeros(0)
        self.mass, self.types = mass, types  # of slot 0 by class

    def symbols(self, words: np.ndarray, ending: np.ndarray) -> np.ndarray:
        out = self.by_ending[ending] * np.int16(SLOTS)
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, words), len(self.top) - 1)
            hit = self.top[at] == words
            out[hit] = self.top_symbol[at[hit]]
        return out


def endings(words: Words) -> np.ndarray:
    """The last two bytes of each word, as one number."""
    last = words.data[words.stop - 1].astype(np.int32)
    before = np.where(words.stop - words.start > 1, words.data[np.maximum(words.stop - 2, 0)], 0)
    return last + 256 * before.astype(np.int32)


def _with_ends(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and endings in reading order with an end after each document, and tokens of each document."""
    tokens = words.count + 1
    stop = np.cumsum(tokens) - 1
    hashes, ending = np.full(int(tokens.sum()), END), np.zeros(int(tokens.sum()), np.int32)
    inside = np.ones(len(hashes), bool)
    inside[stop] = False
    hashes[inside], ending[inside] = words.hash, endings(words) if len(words.hash) else 0
    return hashes, ending, tokens


def count_words(docs: DataFrame) -> DataFrame:
    """(word, ending, n): counts of all tokens of the documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []

        def batch_of(frames: list[pd.DataFrame]) -> pd.DataFrame:
            return pd.concat(frames).groupby("word", sort=False, as_index=False).agg({"ending": "first", "n": "sum"})

        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in slices(texts):
                hashes, ending, _ = _with_ends(Words(texts[a:b], lower=True), b - a)
                codes, unique = pd.factorize(hashes)
                first = np.empty(len(unique), np.int32)
                first[codes[::-1]] = ending[::-1]
                held.append(pd.DataFrame({"word": unique.view(np.int64), "ending": first, "n": np.bincount(codes)}))
                if sum(map(len, held)) > 1_500_000:
                    held = [batch_of(held)]
                    if len(held[0]) > 750_000:
                        yield pa.RecordBatch.from_pandas(held.pop(), preserve_index=False)
        if held:
            yield pa.RecordBatch.from_pandas(batch_of(held), preserve_index=False)

    parts = docs.select("text").mapInArrow(counted, "word long, ending int, n long")
    return parts.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def classify(counts: DataFrame) -> tuple[Classes, int, int]:
    """Classes from the staged counts, all tokens, and distinct tokens."""
    # at most 65536 endings
    by_ending = counts.where(F.col("word") != 1).groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()
    ends = counts.where(F.col("word") == 1).agg(F.sum("n")).collect()[0][0] or 0
    total = ends + sum(r["n"] for r in by_ending)
    distinct = sum(r["types"] for r in by_ending) + (1 if ends else 0)
    chosen = [r["ending"] for r in sorted(by_ending, key=lambda r: (-r["n"], r["ending"]))[: CLASSES - 2]]
    place = {e: i + 1 for i, e in enumerate(chosen)}
    mass, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_ending:
        c = place.get(r["ending"], CLASSES - 1)
        mass[c] += r["n"]
        types[c] += r["types"]
    # at most 1 / LEAST_SHARE words have so large a share
    often = counts.where((F.col("n") >= max(2.0, LEAST_SHARE * total)) & (F.col("word") != 1)).collect()
    words, number, filled = [(int(END), 0, 1)], [float(ends)], np.ones(CLASSES, int)
    for r in sorted(often, key=lambda r: (-r["n"], r["word"])):
        c = place.get(r["ending"], CLASSES - 1)
        if filled[c] < SLOTS:
            words.append((r["word"] % (1 << 64), c, int(filled[c])))
            number.append(float(r["n"]))
            mass[c] -= r["n"]
            types[c] -= 1
            filled[c] += 1
    return Classes(chosen, words, mass, types, np.array(number)), int(total), int(distinct)


def start_parameters(classes: Classes, seed: int = 3) -> dict[str, np.ndarray]:
    """Small random weights; the biases give the shares of classes and slots."""
    rng = np.random.default_rng(seed)
    share = np.zeros((CLASSES, SLOTS))
    share[:, 0] = classes.mass
    np.add.at(share, (classes.top_symbol // SLOTS, classes.top_symbol % SLOTS), classes.top_count)
    share += 0.5 * (share.sum(1, keepdims=True) > 0) + 0.01
    small = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
    return {
        "E": small(CLASSES * SLOTS, WIDTH) * 4, "Wx": small(WIDTH, 3 * HIDDEN), "Wh": small(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32),
        "Wc": small(HIDDEN, CLASSES) * np.float32(0.1), "bc": np.log(share.sum(1) / share.sum()).astype(np.float32),
        "Ws": small(CLASSES, HIDDEN, SLOTS) * np.float32(0.1), "bs": np.log(share / share.sum(1, keepdims=True)).astype(np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place, a column each: sums along rows of memory are several times faster."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def _log_share(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log of the softmax of each column at its chosen row; overwrites x."""
    x -= x.max(0)
    mine = x[chosen, np.arange(x.shape[1])]
    return mine - np.log(np.exp(x, out=x).sum(0))


def _by_class(c: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order that brings tokens of a class together, and (class, begin, stop) of each class present."""
    order = np.argsort(c.astype(np.int16), kind="stable")  # 16 bits are sorted by radix
    cuts = np.concatenate([[0], np.cumsum(np.bincount(c, minlength=CLASSES))])
    return order, [(q, int(cuts[q]), int(cuts[q + 1])) for q in np.flatnonzero(np.diff(cuts))]


def _slot_logits(p: dict[str, np.ndarray], states: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Slots by tokens; the states are in order of class, so each class's weights are read once."""
    x = np.empty((SLOTS, states.shape[1]), states.dtype)
    for q, a, b in runs:
        x[:, a:b] = p["Ws"][q].T @ states[:, a:b]
        x[:, a:b] += p["bs"][q][:, None]
    return x


class Trainer:
    """Adam over windows of truncated backpropagation."""

    def __init__(self, parameters: dict[str, np.ndarray], rate: float) -> None:
        self.p = {k: v.copy() for k, v in parameters.items()}
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.rate, self.steps, self.tokens = rate, 0, 0
        self.rooms: dict[str, np.ndarray] = {}

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array used again from window to window: fresh memory costs more than the arithmetic."""
        room = self.rooms.get(name)
        if room is None or room.shape != shape:
            room = self.rooms[name] = np.empty(shape, self.p["Wh"].dtype)
        return room

    def train(self, symbols: np.ndarray, streams: int = STREAMS, window: int = WINDOW) -> float:
        """One pass; symbols begin with the end symbol. Returns the mean loss in nats."""
        streams = max(1, min(streams, (len(symbols) - 1) // window))
        length = (len(symbols) - 1) // streams
        if length < 1:
            return 0.0
        x = symbols[: streams * length].reshape(streams, length).T
        y = symbols[1 : streams * length + 1].reshape(streams, length).T
        h = np.zeros((streams, HIDDEN), np.float32)
        loss = 0.0
        for t in range(0, length, window):
            part, h = self._window(x[t : t + window], y[t : t + window], h)
            loss += part
        self.tokens += streams * length
        return loss / (streams * length)

    def _window(self, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """One step of Adam; values lie in rows, tokens in columns, so that each gate is one stretch of memory."""
        p, steps, s = self.p, len(x), x.shape[1]
        room, kind = self._room, p["Wh"].dtype
        keep = (x != 1).astype(kind)  # not class 0, slot 1: an end clears the state
        a = np.take((p["E"] @ p["Wx"] + p["b"]).T.copy(), x, axis=1, out=room("a", 3 * HIDDEN, steps, s), mode="clip")
        out, before, inner = (room(name, HIDDEN, steps, s) for name in ("out", "before", "inner"))
        gates, g, into = room("gates", steps, 3 * HIDDEN, s), room("g", 3 * HIDDEN, s), p["Wh"].T.copy()
        h = h.T.astype(kind, order="C")
        for t in range(steps):
            zr, n = gates[t, : 2 * HIDDEN], gates[t, 2 * HIDDEN :]
            h *= keep[t]
            before[:, t] = h
            np.matmul(into, h, out=g)
            inner[:, t] = g[2 * HIDDEN :]
            _sigmoid(np.add(a[: 2 * HIDDEN, t], g[: 2 * HIDDEN], out=zr))
            np.multiply(zr[HIDDEN:], g[2 * HIDDEN :], out=n)
            n += a[2 * HIDDEN :, t]
            np.tanh(n, out=n)
            h -= n
            h *= zr[:HIDDEN]
            h += n
            out[:, t] = h
        out, target = out.reshape(HIDDEN, -1), y.ravel()
        c, k = target // SLOTS, target % SLOTS
        rows = np.arange(len(target))
        pc = np.matmul(p["Wc"].T, out, out=room("pc", CLASSES, steps * s))
        pc += p["bc"][:, None]
        pc = _softmax(pc)
        order, runs = _by_class(c)
        grouped, place = np.take(out, order, axis=1), k[order]
        ps = _softmax(_slot_logits(p, grouped, runs))
        loss = -float(np.log(np.maximum(pc[c, rows][order] * ps[place, rows], 1e-30)).sum())
        pc[c, rows] -= 1
        ps[place, rows] -= 1
        d = {"Wc": out @ pc.T, "bc": pc.sum(1)}
        d["Ws"], d["bs"] = np.zeros_like(p["Ws"]), np.zeros_like(p["bs"])
        back = np.empty_like(grouped)
        for q, i, j in runs:
            d["Ws"][q], d["bs"][q] = grouped[:, i:j] @ ps[:, i:j].T, ps[:, i:j].sum(1)
            back[:, i:j] = p["Ws"][q] @ ps[:, i:j]
        dout = np.matmul(p["Wc"], pc, out=room("dout", HIDDEN, steps * s))
        dout[:, order] += back
        dout = dout.reshape(HIDDEN, steps, s)
        da, dg, step = room("da", 3 * HIDDEN, steps, s), room("dg", 3 * HIDDEN, steps, s), room("step", 3 * HIDDEN, s)
        dz, dr, dn = step[:HIDDEN], step[HIDDEN : 2 * HIDDEN], step[2 * HIDDEN :]
        dh, rest, down = room("dh", HIDDEN, s), room("rest", HIDDEN, s), room("down", HIDDEN, s)
        down[:] = 0
        for t in range(steps - 1, -1, -1):
            z, r, n = gates[t, :HIDDEN], gates[t, HIDDEN : 2 * HIDDEN], gates[t, 2 * HIDDEN :]
            np.add(dout[:, t], down, out=dh)
            np.subtract(1, z, out=rest)
            # dz = dh (before - n) z (1 - z)
            np.subtract(before[:, t], n, out=dz)
            dz *= dh
            dz *= z
            dz *= rest
            # dn = dh (1 - z) (1 - n n)
            np.multiply(n, n, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= rest
            dn *= dh
            # dr = dn inner r (1 - r)
            np.subtract(1, r, out=dr)
            dr *= r
            dr *= inner[:, t]
            dr *= dn
            da[:, t] = step
            dn *= r
            dg[:, t] = step
            np.matmul(p["Wh"], step, out=down)
            dh *= z
            down += dh
            down *= keep[t]
        back, inputs = da.reshape(3 * HIDDEN, -1), x.ravel()
        d["Wh"] = before.reshape(HIDDEN, -1) @ dg.reshape(3 * HIDDEN, -1).T
        d["b"] = back.sum(1)
        by = np.stack([np.bincount(inputs, row, CLASSES * SLOTS) for row in back], 1).astype(kind)
        d["Wx"], d["E"] = p["E"].T @ by, by @ p["Wx"].T
        self.steps += 1
        for name, grad in d.items():
            grad = np.clip(grad / s, -1, 1)
            self.m[name] += 0.1 * (grad - self.m[name])
            self.v[name] += 0.01 * (grad * grad - self.v[name])
            fix = self.rate * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
            self.p[name] -= (fix * self.m[name] / (np.sqrt(self.v[name]) + 1e-8)).astype(np.float32)
        return loss, h.T


def flat(parameters: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([parameters[k].ravel() for k in sorted(parameters)])


def unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _symbols(texts: list[str], classes: Classes) -> np.ndarray:
    hashes, ending, _ = _with_ends(Words(texts, lower=True), len(texts))
    return classes.symbols(hashes, ending).astype(np.int64)


def fit(docs: DataFrame, classes: Classes) -> dict[str, np.ndarray]:
    """Parameters after the pilot and one pass of every task over its training tokens."""
    start = start_parameters(classes)
    pilot = bounded_sample(docs, PILOT_DOCS, "doc_id", "text").select("text").collect()
    if pilot:
        trainer = Trainer(start, PILOT_RATE)
        symbols = np.concatenate([[1], _symbols([r["text"] or "" for r in pilot], classes)])
        for e in range(PILOT_EPOCHS):
            trainer.rate = PILOT_RATE / (1 + e)
            trainer.train(symbols, 64)
        start = trainer.p

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, held, size = Trainer(start, RATE), [], 0
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in slices(texts):
                held.append(_symbols(texts[a:b], classes))
                size += len(held[-1])
                if size > CHUNK:
                    trainer.train(np.concatenate([[1], *held]))
                    held, size = [], 0
        if held:
            trainer.train(np.concatenate([[1], *held]))
        if trainer.tokens:
            values = flat(trainer.p).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values * trainer.tokens), pa.array(np.full(len(values), trainer.tokens))],
                ["place", "weighted", "tokens"],
            )

    parts = docs.select("text").mapInArrow(trained, "place int, weighted double, tokens long")
    mean = parts.groupBy("place").agg((F.sum("weighted") / F.sum("tokens")).alias("v")).orderBy("place").collect()
    return unflat(np.array([r["v"] for r in mean]), start) if mean else start


def log_probabilities(p: dict[str, np.ndarray], symbols: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Natural log probability of class and slot of every token; documents side by side, longest first."""
    order = np.argsort(-tokens, kind="stable")
    begin = (np.cumsum(tokens) - tokens)[order]
    longest = int(tokens.max()) if len(tokens) else 0
    active = len(tokens) - np.searchsorted(np.sort(tokens), np.arange(longest), side="right")
    out = np.zeros(len(symbols))
    table, into = (p["E"] @ p["Wx"] + p["b"]).T.copy(), p["Wh"].T.copy()
    h = np.zeros((HIDDEN, len(tokens)), np.float32)
    last = np.ones(len(tokens), np.int64)
    # as many steps at once as make about SIDE tokens, in rooms used again
    reached, t = np.cumsum(active), 0
    rooms = {name: np.empty(3 * HIDDEN * len(tokens), np.float32) for name in ("a", "g")}
    while t < longest:
        begun = int(reached[t] - active[t])
        until = min(longest, max(t + 1, int(np.searchsorted(reached, begun + SIDE))))
        width = int(reached[until - 1]) - begun
        state, target, place = np.empty((HIDDEN, width), np.float32), np.empty(width, np.int64), np.empty(width, np.int64)
        stop = 0
        for t in range(t, until):
            n = int(active[t])
            if n < h.shape[1]:
                h = h[:, :n].copy()
            a, g = (rooms[name][: 3 * HIDDEN * n].reshape(3 * HIDDEN, n) for name in ("a", "g"))
            np.take(table, last[:n], axis=1, out=a, mode="clip")
            np.matmul(into, h, out=g)
            a[: 2 * HIDDEN] += g[: 2 * HIDDEN]
            zr, new = _sigmoid(a[: 2 * HIDDEN]), g[2 * HIDDEN :]
            new *= zr[HIDDEN:]
            new += a[2 * HIDDEN :]
            np.tanh(new, out=new)
            h -= new
            h *= zr[:HIDDEN]
            h += new
            start, stop = stop, stop + n
            np.add(begin[:n], t, out=place[start:stop])
            last = np.take(symbols, place[start:stop], out=target[start:stop], mode="clip")
            state[:, start:stop] = h
        t = until
        c, k = target // SLOTS, target % SLOTS
        x = p["Wc"].T @ state
        x += p["bc"][:, None]
        order, runs = _by_class(c)
        slot = _log_share(_slot_logits(p, np.take(state, order, axis=1), runs), k[order])
        out[place] = _log_share(x, c)
        out[place[order]] += slot
    return out


def score(docs: DataFrame, folds: int = 5, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    read = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    training = read.where(remainder("doc_id", folds) != held_out)
    counts = stage(count_words(training), "word-counts")
    classes, total, distinct = classify(counts)
    parameters = fit(training, classes)
    size = read.agg(F.sum(F.octet_length("text"))).collect()[0][0]
    blocks = ceil_div(size, BLOCK_BYTES)
    # a block holds about BLOCK_BYTES of text; both branches below read the one exchange
    dealt = read.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            block = batch.column("block").to_numpy()
            texts = batch.column("text").to_pylist()
            for b in np.unique(block):
                mine = [texts[i] for i in np.flatnonzero(block == b)]
                for i, j in slices(mine):
                    held.setdefault(int(b), []).append(pd.unique(Words(mine[i:j], lower=True).hash))
                if len(held[int(b)]) > 8:
                    held[int(b)] = [pd.unique(np.concatenate(held[int(b)]))]
        for b, parts in held.items():
            words = pd.unique(np.concatenate(parts))
            if len(classes.top):
                words = words[~np.isin(words, classes.top)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), b, np.int32)), pa.array(words.view(np.int64))], ["block", "word"])

    # all columns go in, or the two branches would prune their exchanges differently and make two of them
    wanted = dealt.mapInArrow(asked, "block int, word long")
    known = wanted.join(counts.select("word", "n"), "word").select("block", "word", "n")
    base = float(np.log10(total + 0.5 * (distinct + 1)))

    def scored(key, rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        texts = rows["text"].tolist()
        words = table["word"].to_numpy().view(np.uint64)
        order = np.argsort(words)
        words, number = np.append(words[order], classes.top), np.append(table["n"].to_numpy()[order].astype(np.float64), classes.top_count)
        order = np.argsort(words)
        words, number = words[order], number[order]
        out = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        for i, j in slices(texts, 8_000_000):
            hashes, ending, tokens = _with_ends(Words(texts[i:j], lower=True), j - i)
            at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
            n = np.where(words[at] == hashes, number[at], 0.0)
            symbols = classes.symbols(hashes, ending).astype(np.int64)
            c, rest = symbols // SLOTS, symbols % SLOTS == 0
            inner = np.where(rest, np.log10((n + 0.5) / (classes.mass[c] + 0.5 * (classes.types[c] + 1))), 0.0)
            model = log_probabilities(parameters, symbols, tokens) / np.log(10) + inner
            begin = np.cumsum(tokens) - tokens
            out["n_tokens"].append(tokens)
            out["n_known"].append(np.add.reduceat((n > 0).astype(np.int64), begin))
            out["base_score"].append(np.add.reduceat(np.log10(n + 0.5) - base, begin))
            out["score"].append(np.add.reduceat(model, begin))
        return pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), **{k: np.concatenate(v) for k, v in out.items()}}).astype({"doc_id": "Int64"})

    result = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(
        scored, "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )
    return result.select(
        "doc_id", (remainder("doc_id", folds) == held_out).alias("held_out"), "n_tokens", "n_known",
        F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
    )
