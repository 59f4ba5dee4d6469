"""Fill-in-the-middle by a piecewise-linear learned rank index.

A text is cut into prefix, middle and suffix at two of its unit boundaries (code points, or words)
and written in one of three forms: plain (the text as it is), psm (`<P>`prefix`<S>`suffix`<M>`middle)
or spm (`<S>`suffix`<P>`prefix`<M>`middle).

UTF-8 has no direct way from a unit's rank to its byte. The rank index gives one: all boundary
offsets of a chunk of texts, in order, are one rising sequence of (rank, byte offset), covered
greedily by straight segments that pass through their first point and miss no other by more than
ERROR bytes (each point narrows the cone of slopes still allowed; the segment ends where the cone
closes). A boundary's offset minus its rounded prediction is its residual, one byte each. A cut
is looked up by a binary search over the segments' first ranks, predicted by one multiplication,
and corrected exactly by the stored residual. Plain ASCII is one segment however long it is.

The work is one pass over the rows, without a shuffle; a task holds one chunk of CHUNK_BYTES (or one
longer text) with its boundaries at a time.

Null texts count as empty, empty texts and texts that contain a marker are plain, a null key counts
as the empty string. Equal keys draw equal hashes, so repeated rows are cut alike. Very long texts
are whole chunks. An empty table gives an empty result. Input columns named like a result column are
replaced; all others are kept as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes by which a segment may miss a boundary; a residual fits in one signed byte.
ERROR = 31
#: Text bytes indexed together.
CHUNK_BYTES = 4_000_000
#: Points looked at in one step while a segment grows.
LEAST_STEP, MOST_STEP = 64, 65_536

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKER = re.compile(rb"<[PSM]>")
WORD_END = re.compile(rb"[^\x20\x09-\x0D]+")
UNITS = ("chars", "words")
RESULT = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_units", T.LongType()),
    T.StructField("middle_units", T.LongType()), T.StructField("prefix_bytes", T.LongType()), T.StructField("middle_bytes", T.LongType()),
    T.StructField("output", T.StringType()),
])


class RankIndex(NamedTuple):
    """Segments by first rank, with the offset there and the slope, and the residual of every boundary."""

    first: np.ndarray
    offset: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.first, ranks, side="right") - 1
        return self.offset[at] + np.rint(self.slope[at] * (ranks - self.first[at])).astype(np.int64)

    def lookup(self, ranks: np.ndarray) -> np.ndarray:
        """Byte offsets of the boundaries of these ranks, exactly."""
        return self.predict(ranks) + self.residual[ranks]


def _segment(offsets: np.ndarray, start: int, step: int, error: int) -> tuple[int, float]:
    """End (exclusive) and slope of the longest segment from `start` whose cone of slopes stays open."""
    low, high, at, n = -np.inf, np.inf, start + 1, len(offsets)
    while at < n:
        stop = min(at + step, n)
        run, rise = np.arange(at - start, stop - start), offsets[at:stop] - offsets[start]
        # rounding moves a prediction by half a byte
        least = np.maximum.accumulate(np.maximum((rise - (error - 0.5)) / run, low))
        most = np.minimum.accumulate(np.minimum((rise + (error - 0.5)) / run, high))
        if least[-1] > most[-1]:
            closed = int(np.argmax(least > most))
            if closed:
                low, high = float(least[closed - 1]), float(most[closed - 1])
            return at + closed, (low + high) / 2 if at + closed > start + 1 else 0.0
        low, high, at, step = float(least[-1]), float(most[-1]), stop, min(2 * step, MOST_STEP)
    return n, (low + high) / 2 if n > start + 1 else 0.0


def fit_index(offsets: np.ndarray, error: int = ERROR) -> RankIndex:
    """Index of a rising sequence of offsets, one for each rank from 0."""
    starts, slopes, at, step = [], [], 0, MOST_STEP // 16
    while at < len(offsets):
        end, slope = _segment(offsets, at, step, error)
        starts.append(at)
        slopes.append(slope)
        # the next segment is likely about as long
        step = int(min(max(end - at, LEAST_STEP), MOST_STEP))
        at = end
    first = np.array(starts, np.int64)
    index = RankIndex(first, offsets[first].astype(np.int64) if len(first) else first, np.array(slopes), np.empty(0, np.int16))
    residual = np.empty(len(offsets), np.int8 if error < 128 else np.int64)
    for low in range(0, len(offsets), MOST_STEP * 4):
        ranks = np.arange(low, min(low + MOST_STEP * 4, len(offsets)))
        residual[ranks] = offsets[ranks] - index.predict(ranks)
    return index._replace(residual=residual)


def boundaries(data: np.ndarray, starts: np.ndarray, units: str) -> tuple[np.ndarray, np.ndarray]:
    """Boundary offsets of all texts of a chunk, in order, and the rank of each text's first one.

    Text i is data[starts[i]:starts[i + 1]] and has one boundary more than units: before its first unit, and after
    each. An empty text has one boundary. With words, what precedes the first word belongs to it, and what
    follows the last word to that.
    """
    if units == "chars":
        inner = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of every code point
        counts, points = np.diff(np.searchsorted(inner, starts)), inner
    else:
        pieces, counts = [], np.zeros(len(starts) - 1, np.int64)
        raw = data.tobytes()
        for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
            ends = [m.end() for m in WORD_END.finditer(raw, a, b)]
            if ends:
                pieces.append(np.array([a, *ends[:-1]], np.int64))
                counts[i] = len(ends)
        points = np.concatenate(pieces) if pieces else np.empty(0, np.int64)
    # a text's boundaries are the starts of its units and its own end
    first = np.concatenate([[0], np.cumsum(counts + 1)])[:-1]
    offsets = np.empty(len(points) + len(counts), np.int64)
    last = first + counts
    own = np.ones(len(offsets), bool)
    own[last] = False
    offsets[own], offsets[last] = points, starts[1:]
    return offsets, first


def draws(seed: str, key: str) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the sha256 of `seed:key`."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))


def _transform(keys: list, data: np.ndarray, starts: np.ndarray, seed: str, plain: int, spm: int, units: str) -> list[tuple]:
    """RESULT of every text of a chunk."""
    offsets, first = boundaries(data, starts, units)
    n = np.diff(np.append(first, len(offsets))) - 1
    hashes = np.array([draws(seed, "" if k is None else str(k)) for k in keys], np.int64).reshape(-1, 4)
    a, b = hashes[:, 0] % (n + 1), hashes[:, 1] % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    index = fit_index(offsets)
    cuts = index.lookup(np.concatenate([first + low, first + high])).reshape(2, -1)
    raw, out = data.tobytes(), []
    for i, (begin, end, c1, c2) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), *cuts.tolist())):
        if not n[i] or hashes[i, 2] % 100 >= 100 - plain or MARKER.search(raw, begin, end):
            out.append((int(n[i]), "plain", None, None, None, None, raw[begin:end]))
            continue
        parts = {PREFIX: raw[begin:c1], MIDDLE: raw[c1:c2], SUFFIX: raw[c2:end]}
        form, order = ("spm", (SUFFIX, PREFIX, MIDDLE)) if hashes[i, 3] % 100 < spm else ("psm", (PREFIX, SUFFIX, MIDDLE))
        written = b"".join(m + parts[m] for m in order)
        out.append((int(n[i]), form, int(low[i]), int(high[i] - low[i]), c1 - begin, c2 - c1, written))
    return out


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most CHUNK_BYTES of text, one row at least."""
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > CHUNK_BYTES:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "1", plain: int = 10, spm: int = 20, units: str = "chars"
) -> DataFrame:
    """`docs` with n (units), form, prefix and middle in units and bytes (null if plain), and the output.

    Of 100 texts about `plain` stay plain, and of 100 others about `spm` are written suffix first.
    """
    if units not in UNITS:
        raise ValueError(f"unknown units {units!r}; available: {UNITS}")
    own = [f for f in docs.schema.fields if f.name not in RESULT.names]
    given = [T.StructField("_0", docs.schema[key].dataType), T.StructField("_1", T.StringType())]
    kept = T.StructType([T.StructField(f"_{i + 2}", f.dataType) for i, f in enumerate(own)])
    quoted = lambda name: F.col(f"`{name.replace('`', '``')}`")
    # positions instead of names inside: nothing can clash
    rows = docs.select(
        quoted(key).alias("_0"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("_1"),
        *[quoted(f.name).alias(k) for f, k in zip(own, kept.names)],
    )
    made = T.StructType([T.StructField(f"r{i}", f.dataType) for i, f in enumerate(RESULT.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            body = texts.buffers()[2]
            data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
            keys = batch.column(0).to_pylist()
            for low, high in _chunks(np.diff(ends)):
                base = int(ends[low])
                out = _transform(keys[low:high], data[base : int(ends[high])], ends[low : high + 1] - base, seed, plain, spm, units)
                columns = list(zip(*out))
                arrays = [pa.array(c, pa.int64()) for c in (columns[0], *columns[2:6])]
                form = pa.array(columns[1], pa.string())
                output = pa.array(columns[6], pa.binary()).cast(pa.string())
                cells = [*batch.slice(low, high - low).columns[2:], arrays[0], form, *arrays[1:], output]
                yield pa.RecordBatch.from_arrays(cells, names=[*kept.names, *made.names])

    done = rows.mapInArrow(run, T.StructType([*kept.fields, *made.fields]))
    names = dict(zip([*kept.names, *made.names], [*[f.name for f in own], *RESULT.names]))
    return done.select(*[F.col(k).alias(name) for k, name in names.items()])


def restored(output: str | Column, form: str | Column) -> Column:
    """The text, rebuilt from the output and its form alone.

    Parts hold no marker, and no marker can arise where parts and markers meet.
    """
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "<[PSM]>", -1)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .otherwise(F.concat(parts[2], parts[3], parts[1]))
    )
