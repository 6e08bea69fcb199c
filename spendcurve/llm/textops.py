"""Vectorised word, line and shingle hashing over Arrow string columns.

A chunk of documents is one byte array. A word's hash is a polynomial over a random value per byte,
read off a running sum, so that every word of a chunk is hashed by a handful of numpy passes. Hashes
have 64 bits and are the same in every process.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers from a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_RAW = constants(256, 1)
_LOWER = _RAW.copy()
_LOWER[65:91] = _RAW[97:123]
_LOW_BYTES = np.arange(256, dtype=np.uint8)
_LOW_BYTES[65:91] += 32
#: The bytes that separate words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers = np.ones(1, dtype=U64)
_inverses = np.ones(1, dtype=U64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, CHUNK_BYTES + 1)
        both = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers, _inverses = both


class Chunk:
    """Some whole documents: their bytes and offsets. Null texts are empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n_docs = len(offsets) - 1

    def running(self, lower: bool) -> np.ndarray:
        return self.running_of(_LOWER if lower else _RAW)

    def running_of(self, values: np.ndarray) -> np.ndarray:
        """Running sums of a polynomial over a value per byte."""
        _grow(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, dtype=U64)
        np.cumsum(values[self.data] * _powers[: len(self.data)], out=out[1:])
        return out

    def spans_hash(self, run: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each byte span, the same wherever it stands."""
        return mix((run[ends] - run[starts]) * _inverses[starts] + (ends - starts).astype(U64))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and the index of each document's first word (n_docs + 1)."""
        inside = ~SPACE[self.data]
        before = np.zeros(len(inside), dtype=bool)
        before[1:] = inside[:-1]
        edges = self.offsets[self.offsets < len(inside)]
        before[edges] = False
        after = np.zeros(len(inside), dtype=bool)
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the \\n-split lines, and the index of each document's first line; a document has one line at least."""
        breaks = np.flatnonzero(self.data == 10)
        per_doc = np.diff(np.searchsorted(breaks, self.offsets)) + 1
        first = np.concatenate([[0], np.cumsum(per_doc)])
        starts = np.empty(first[-1], dtype=np.int64)
        ends = np.empty(first[-1], dtype=np.int64)
        head = np.zeros(first[-1], dtype=bool)
        head[first[:-1]] = True
        tail = np.zeros(first[-1], dtype=bool)
        tail[first[1:] - 1] = True
        starts[head], ends[tail] = self.offsets[:-1], self.offsets[1:]
        starts[~head], ends[~tail] = breaks + 1, breaks
        return starts, ends, first


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks of whole documents of about `limit` bytes; a longer document is a chunk by itself."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield Chunk(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def word_hashes(chunk: Chunk, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a chunk and the index of each document's first word."""
    starts, ends, first = chunk.words()
    return chunk.spans_hash(chunk.running(lower), starts, ends), first


def span_hasher(values: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function (starts, ends) -> hash of these spans of 64-bit numbers, the same wherever they stand."""
    _grow(len(values) + 1)
    run = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(mix(values) * _powers[: len(values)], out=run[1:])
    inverses = _inverses
    return lambda starts, ends: mix((run[ends] - run[starts]) * inverses[starts])


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 positions are missing."""
    if len(words) < n:
        return np.zeros(0, dtype=U64)
    weights = constants(n, 77) | U64(1)
    out = words[: len(words) - n + 1] * weights[0]
    for k in range(1, n):
        out = out + words[k : len(words) - n + 1 + k] * weights[k]
    return mix(out + U64(n))


def shingle_lists(words: np.ndarray, first: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """For each document, the hashes of its n-word shingles in order; with fewer words, of its whole sequence; without words, none."""
    every = ngrams(words, n)
    out = []
    bounds = first.tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        out.append(every[a : b - n + 1] if b - a >= n else ngrams(words[a:b], b - a) if b > a else every[:0])
    return out
