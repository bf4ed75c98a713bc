"""Words, windows and their hashes, for many texts at once.

The bytes of an Arrow string column lie side by side, so one pass of numpy over a slice of it splits and
hashes the words of hundreds of texts. A hash of a run is a polynomial over 2^64 with an odd base, which
can be taken from two prefix sums; every result is mixed at the end. Two lanes give 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 20

#: Bytes of the words [^\x20\x09-\x0D]+ and, after lower-casing, of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Lane:
    """One 64-bit hash family: byte values, and powers of the bases and of their inverses."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.values = rng.integers(0, 2**64, 256, dtype=U)
        self.bases = [int(b) | 1 for b in rng.integers(0, 2**64, 2, dtype=U)]
        self.tables: list[list[np.ndarray]] = [[np.ones(1, U), np.ones(1, U)] for _ in self.bases]

    def powers(self, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = self.tables[which]
        if len(have[0]) < n:
            n = max(n, 1 << 21 if which == 0 else 1 << 19)
            base = self.bases[which]
            for k, b in enumerate((base, pow(base, -1, 1 << 64))):
                steps = np.full(n, b, U)
                steps[0] = 1
                have[k] = np.multiply.accumulate(steps)
        return have[0], have[1]

    def sums(self, which: int, items: np.ndarray) -> np.ndarray:
        out = np.zeros(len(items) + 1, U)
        np.cumsum(items * self.powers(which, len(items))[0][: len(items)], out=out[1:])
        return out

    def runs(self, which: int, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = self.powers(which, len(sums))[1]
        return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U) * U(0x9E3779B97F4A7C15))


LANES = (Lane(11), Lane(23))


@dataclass
class Slice:
    """Texts `first` up to `last` of a batch: their bytes, and where each starts and ends in them."""

    first: int
    last: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Null counts as empty. A text is never split: one that is longer than the limit has a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    if not len(column):
        return
    _, where, raw = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        at = offsets[first : last + 1] - offsets[first]
        yield Slice(first, last, data[offsets[first] : offsets[last]], at[:-1], at[1:])
        first = last


@dataclass
class Words:
    """start, end: bytes of each word; text: the text's number in the slice; upto: words before each text, and in all."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    upto: np.ndarray


def find_words(s: Slice, allowed: np.ndarray) -> Words:
    inside = allowed[s.data]
    begin, stop = inside.copy(), inside.copy()
    if len(inside):
        begin[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        full = s.end > s.start
        begin[s.start[full]] = inside[s.start[full]]
        stop[s.end[full] - 1] = inside[s.end[full] - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    upto = np.append(np.searchsorted(start, s.start, side="left"), len(start))
    return Words(start, end, np.repeat(np.arange(len(s.start)), np.diff(upto)), upto)


def word_hashes(data: np.ndarray, w: Words, lane: Lane) -> np.ndarray:
    return lane.runs(0, lane.sums(0, lane.values[data]), w.start, w.end)


def window_starts(w: Words, n: int) -> np.ndarray:
    """The first word of each run of n words that lies in one text."""
    if len(w.text) < n:
        return np.zeros(0, np.int64)
    return np.flatnonzero(w.text[n - 1 :] == w.text[: len(w.text) - n + 1])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
