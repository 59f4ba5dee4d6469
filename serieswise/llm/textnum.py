"""Words of many texts at once in numpy: 64-bit hashes by simple tabulation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_TABLE = np.random.default_rng(20).integers(0, 1 << 64, (64, 256), dtype=np.uint64).ravel()
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Doubles above 0, at most 1, from hashed values."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a batch: hash, document, and where each begins and ends in `data`."""

    def __init__(self, texts: list[str], lower: bool = False) -> None:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        self.data = _LOWER[data] if lower else data
        blank = _BLANK[data]
        turns = blank[1:] != blank[:-1]
        bounds = np.flatnonzero(turns) + 1
        if not blank[0]:
            bounds = np.concatenate([[0], bounds])
        self.start, self.stop = bounds[0::2], bounds[1::2]
        ends = np.cumsum(np.array([len(r) + 1 for r in raw], np.int64))
        before = np.searchsorted(self.start, ends)  # words up to the end of each text
        self.count = np.diff(before, prepend=0)
        self.document = np.repeat(np.arange(len(texts)), self.count)
        if not len(self.start):
            self.hash = np.zeros(0, np.uint64)
            return
        size = self.stop - self.start
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        narrow = np.int32 if len(data) < 1 << 31 else np.int64
        place = np.arange(int(size.sum()), dtype=narrow)
        place -= np.repeat(first.astype(narrow), size)
        at = (place & 63) << 8
        at += self.data[~blank]
        values = np.take(_TABLE, at)
        if int(size.max()) > 64:  # longer words: another factor for each stretch of 64
            values = values * ((place >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        self.hash = mix(np.add.reduceat(values, first) + size.astype(np.uint64))


def slices(texts: list[str], size: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `size` characters each; a text is never cut."""
    begin = 0
    while begin < len(texts):
        stop, held = begin, 0
        while stop < len(texts) and (stop == begin or held + len(texts[stop]) < size):
            held += len(texts[stop])
            stop += 1
        yield begin, stop
        begin = stop
