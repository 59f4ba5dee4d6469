"""Bound-certified repacking of tokenised documents into fixed-length sequences.

Documents become pieces of at most `capacity` tokens. Pieces are dealt to partitions by hash
and each partition packs them best-fit decreasing. Dual-feasible functions give a lower bound
on the bins of any packing, so a partition whose count equals its bound is certified optimal.
Partitions with a gap give up the pieces of their partly filled bins, every partition at
most a bounded number; the pooled pieces are dealt anew to fewer partitions and packed again,
until one partition is left or a round saves nothing. Full bins never move.

A null or empty text is one piece holding only the end id. Texts of any length are cut into
pieces of `capacity`, so no piece is too long. Equal pieces are ordered by a hash of
their content and place, repeated rows are packed each on its own, an empty table
gives no pieces. Only doc_id and text of the input are read.
"""

from __future__ import annotations

import gc
import json
import struct
import threading
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieswise.llm.common import ceil_div, stage

CAPACITY = 4096
END_ID = 1
#: Pieces of a packing partition: a few MB in one task.
PIECES = 8_000
#: Entries of one of the two generations of a worker's caches.
RECENT = 250_000
#: Words of the texts that are looked up together.
GROUP_WORDS = 200_000
#: Seconds after which a worker that encodes no more gives up its caches: the next step's memory is not theirs.
IDLE_SECONDS = 15.0
# fixed values: the parts of a tokenizer that lower-case a text and cut it at the ends of runs of letters
_STEPS = [{"type": "NFC"}, {"content": " ", "pattern": {"Regex": r"\s+"}, "type": "Replace"}, {"type": "Lowercase"}]
NORMALIZER = json.dumps({"normalizers": _STEPS, "type": "Sequence"}, sort_keys=True)
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CUTS = [
    {"behavior": "Removed", "invert": True, "pattern": {"Regex": _CUT}, "type": "Split"},
    {"add_prefix_space": False, "trim_offsets": True, "type": "ByteLevel", "use_regex": False},
]
PRE_TOKENIZER = json.dumps({"pretokenizers": _CUTS, "type": "Sequence"}, sort_keys=True)
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"

_RUN = None
_ENCODERS: dict[str, "_Encoder"] = {}


class _Recent:
    """A cache of two generations: what the young one does not hold, but the old one, moves over when it is used.

    A full young generation becomes the old one, so entries in use stay and memory is bounded.
    """

    def __init__(self) -> None:
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, wanted: set | dict) -> list:
        """The wanted keys that are in neither generation; all others are young afterwards, until the next call."""
        if len(self.young) > RECENT:
            self.young, self.old = {}, self.young
        others = set(wanted).difference(self.young)
        out = others.difference(self.old)
        kept = list(others.difference(out))
        self.young.update(zip(kept, map(self.old.__getitem__, kept)))
        return list(out)


@contextmanager
def _uncollected() -> Iterator[None]:
    """No search for cycles meanwhile: words and ids hold none, and each search would visit all of them."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class _Encoder:
    """Ids of texts, word by word: the tokenizer drops white space and never joins two words.

    A text is split at ASCII white space. Words of Latin letters, with or without ASCII
    punctuation behind them, are looked up by their letters in lower case; any other word
    goes to the tokenizer as it is.
    """

    def __init__(self, path: str) -> None:
        import re

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        # where lower-case letters stay one piece, the model alone gives a run's ids
        self.whole_runs = (
            json.dumps(made["normalizer"], sort_keys=True) == NORMALIZER
            and json.dumps(made["pre_tokenizer"], sort_keys=True) == PRE_TOKENIZER
            and not any(t["content"].isalpha() for t in made["added_tokens"])
        )
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        # the model's sign of each byte of the letters' UTF-8 codes
        self.signs = {b: sign for x in range(0xC0, 0x100) for b, sign in zip(chr(x).encode(), level(chr(x))[0][0])}
        # letters and marks of a line that is a plain word, else the line
        self.split = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)|(.+))$", re.MULTILINE).findall
        self.words, self.runs = _Recent(), _Recent()
        self.used, self.idle = threading.Lock(), None

    @contextmanager
    def in_use(self) -> Iterator[_Encoder]:
        """Keeps the caches during a task, and gives them up if none follows soon."""
        if self.idle:
            self.idle.cancel()
        try:
            with self.used:
                yield self
        finally:
            self.idle = threading.Timer(IDLE_SECONDS, self._forget)
            self.idle.daemon = True
            self.idle.start()

    def _forget(self) -> None:
        if self.used.acquire(blocking=False):
            self.words, self.runs = _Recent(), _Recent()
            self.used.release()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn_runs(self, runs: list[str]) -> None:
        """Runs of letters by the model; or many in one call, split again by the word each id belongs to."""
        if self.whole_runs:
            tokenize, signs, learned = self.tokenizer.model.tokenize, self.signs, self.runs.young
            for run in runs:
                piece = run if run.isascii() else run.encode().decode("latin-1").translate(signs)
                ids = [t.id for t in tokenize(piece)]
                learned[run] = struct.pack(f"<{len(ids)}I", *ids)
            return
        for i in range(0, len(runs), 500):
            part = runs[i : i + 500]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, owner = np.asarray(e.ids, "<u4").tobytes(), np.asarray(e.word_ids, np.int64)
            cuts = [0, *(4 * np.flatnonzero(np.diff(owner)) + 4).tolist(), len(ids)]
            if len(cuts) == len(part) + 1:
                self.runs.young.update(zip(part, [ids[a:b] for a, b in zip(cuts, cuts[1:])]))
            else:
                self.runs.young.update(zip(part, self._encode(part)))

    def _learn(self, words: list[bytes]) -> None:
        """All words are taken apart by one search over their lines: no word holds a line end."""
        parts = self.split(b"\n".join(words).decode("utf-8", "replace"))
        lower, tails = [run.lower() for run, _, _ in parts], {tail for _, tail, _ in parts}
        need = self.runs.missing({*lower, *tails} - {""})
        marks = [x for x in need if not x[0].isalpha()]
        self._learn_runs([x for x in need if x[0].isalpha()])
        runs, known = self.runs.young, self.words.young
        runs.update(zip(marks, self._encode(marks)) if marks else ())
        known.update((w, runs[run] + runs[tail] if tail else runs[run]) for w, run, (_, tail, _) in zip(words, lower, parts) if run)
        odd = [(w, whole) for w, (_, _, whole) in zip(words, parts) if whole]
        if odd:
            known.update(zip((w for w, _ in odd), self._encode([whole for _, whole in odd])))

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        group: list[list[bytes]] = []
        size = 0
        for text in texts:
            words = text.encode("utf-8", "replace").split()
            group.append(words)
            size += len(words)
            if size > GROUP_WORDS:
                yield from self._flush(group)
                group, size = [], 0
        yield from self._flush(group)

    def _flush(self, group: list[list[bytes]]) -> Iterator[bytes]:
        with _uncollected():
            missing = self.words.missing(set().union(*group)) if group else []
            if missing:
                self._learn(missing)
        for words in group:
            yield b"".join(map(self.words.young.__getitem__, words))


def encoder(path: str) -> _Encoder:
    """One per worker process and vocabulary; its caches are bounded, and empty while it idles."""
    if path not in _ENCODERS:
        _ENCODERS[path] = _Encoder(path)
    return _ENCODERS[path]


def tokenized(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32 (and the ids, on demand)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.asarray([END_ID], "<u4").tobytes()
        with encoder(vocabulary).in_use() as encode:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for doc, raw in zip(ids, encode.texts(texts)):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        for column, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part)):
                            column.append(value)
                arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *[pa.array(c, pa.int64()) for c in out[2:5]]]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    arrays.append(pa.array([np.frombuffer(p, "<u4").astype("int32") for p in out[5]], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = PIECE_SCHEMA + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each piece. Bins are kept by free space, so a piece costs one search for the next free size."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit f is set while a bin with f free tokens exists
    made = 0
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        above = free >> size
        if above:
            space = size + (above & -above).bit_length() - 1
            held = open_bins[space]
            b = held.pop()
            if not held:
                free &= ~(1 << space)
        else:
            space, b = capacity, made
            made += 1
        bins[i] = b
        left = space - size
        if left:
            open_bins[left].append(b)
            free |= 1 << left
    return bins


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs at least: the best of a family of dual-feasible functions.

    A dual-feasible function maps sizes so that whatever fits a bin sums to at most the mapped
    capacity; the mapped total over the mapped capacity then bounds the bins. Used are the
    identity, the threshold functions (sizes above capacity - t count whole, those below t
    nothing) and the rounding functions floor((k + 1) * size / capacity) / k.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    up_to = np.cumsum(count)
    volume = np.cumsum(count * size)
    best = -(-int(volume[-1]) // capacity)
    t = np.arange(1, capacity // 2 + 1)
    whole = up_to[-1] - up_to[capacity - t]
    middle = volume[capacity - t] - volume[t - 1]
    best = max(best, int((whole + -(-middle // capacity)).max()))
    for k in range(1, 41):
        scaled = (k + 1) * size
        exact = scaled % capacity == 0
        mapped = np.where(exact, k * scaled // capacity, (k + 1) * (scaled // capacity))
        best = max(best, -(-int((count * mapped).sum()) // (k * (k + 1))))
    return best


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_task: int = PIECES) -> DataFrame:
    """Rows of `pieces` with sequence_id, offset, and whether their partition met its bound.

    Only ids and lengths move between rounds. A certified partition gives up its emptiest bin,
    because the sum of many rounded-up bounds may exceed the bound of the whole; any other
    gives up every bin with room. Each round needs fewer partitions than the one before, or
    it is the last one.
    """
    staged = stage(pieces.withColumn("pid", F.monotonically_increasing_id()), "pieces")
    todo = staged.select("pid", F.xxhash64("ids_crc32", "pid").alias("tie"), "length")

    def packed(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "tie", "pid"], ascending=[False, True, True], ignore_index=True)
        sizes = pdf["length"].to_numpy()
        bins = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(bins, weights=sizes).astype(np.int64)
        gap = len(fill) - lower_bound(sizes, capacity)
        gives = fill < capacity
        if not gap:
            gives &= np.arange(len(fill)) == fill.argmin()
        before = pd.Series(sizes).groupby(bins).cumsum().to_numpy() - sizes
        return pd.DataFrame({
            "pid": pdf["pid"], "tie": pdf["tie"], "length": sizes, "part": key[0], "bin": bins,
            "offset": before, "certified": gap == 0, "gives": gives[bins],
        })

    schema = "pid long, tie long, length long, part long, bin long, offset long, certified boolean, gives boolean"
    left, level, placed = todo.count(), 0, None
    while True:
        parts = ceil_div(left, per_task)
        dealt = todo.withColumn("part", F.pmod(F.xxhash64("tie", F.lit(level)), F.lit(parts)))
        result = stage(dealt.groupBy("part").applyInPandas(packed, schema), "packed")
        left = result.where("gives").count() if parts > 1 else 0
        last = not left or ceil_div(left, per_task) >= parts
        stays = (result if last else result.where(~F.col("gives"))).select(
            "pid", "offset", "certified", (F.lit(level) * F.lit(1 << 54) + F.col("part") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id")
        )
        placed = stays if placed is None else placed.unionByName(stays)
        if last:
            return staged.join(placed, "pid").drop("pid")
        todo, level = result.where("gives").select("pid", "tie", "length"), level + 1
