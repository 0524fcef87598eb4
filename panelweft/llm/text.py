"""Whole columns of text as byte buffers: words, hashes and windows without a Python loop per word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at once; one longer text is a piece of its own.
PIECE = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _lut(chars) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


#: Bytes between words: white space alone, or everything but digits, small letters and non-ASCII (after lower-casing), or digits too.
WHITE = _lut([0x20, *range(0x09, 0x0E)])
NOT_WORD = _lut([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
NOT_LETTER = _lut([*range(0x00, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base ** (0..n) mod 2**64; kept for the usual length of pieces."""
    have = _POWERS.get(name)
    if have is None or len(have) <= n:
        have = np.full(max(n, PIECE) + 1, base, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= PIECE:
            _POWERS[name] = have
    return have


def pieces(column: pa.Array | pa.ChunkedArray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """(first, stop) of runs of rows with about ``size`` bytes of text; a longer row stands alone."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)
    first = held = 0
    for i, n in enumerate(lengths):
        if i > first and held + n > size:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(lengths):
        yield first, len(lengths)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a string column: byte spans, and where each row's words begin.

    ``begin``/``end`` are byte positions in ``body``; row r has words ``first[r]:first[r + 1]``.
    Rows that are null or have no word have none.
    """

    def __init__(self, column: pa.Array, between: np.ndarray = WHITE, lower: bool = False):
        body, offsets = flat(column)
        self.body = LOWER[body] if lower else body
        self.offsets = offsets
        inside = ~between[self.body]
        n = len(body)
        head = np.zeros(n + 1, bool)
        head[offsets] = True  # a word ends where its row ends
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
            opens = inside & (~before | head[:n])
            after = np.zeros(n, bool)
            after[:-1] = inside[1:]
            closes = inside & (~after | head[1:])
        else:
            opens = closes = np.zeros(0, bool)
        self.begin = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.begin, offsets)

    def __len__(self) -> int:
        return len(self.begin)

    def some(self, which) -> Words:
        """A choice of the words, without rows; hashes and spans are theirs alone."""
        out = Words.__new__(Words)
        begin, size = self.begin[which], (self.end - self.begin)[which]
        at = np.cumsum(size) - size
        out.body = self.body[np.repeat(begin - at, size) + np.arange(int(size.sum()))]
        out.begin, out.end = at, at + size
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, seed: int = 1) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1))
        up, down = _powers("up", _BASE, len(self.body)), _powers("down", _INVERSE, len(self.body))
        total = np.zeros(len(self.body) + 1, np.uint64)
        np.cumsum(table[self.body] * up[: len(self.body)], out=total[1:])
        return mix((total[self.end] - total[self.begin]) * down[self.begin] + (self.end - self.begin).astype(np.uint64))

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """(code of each word, the distinct words as strings)."""
        step = np.zeros(len(self.body) + 1, np.int8)
        step[self.begin] += 1
        step[self.end] -= 1  # where words of neighbouring rows touch, both cancel out
        data = self.body[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
        offsets = np.append(0, np.cumsum(self.end - self.begin)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        return np.asarray(words.indices).astype(np.int64), words.dictionary

    def text(self, i: int) -> str:
        return self.body[self.begin[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` word hashes (len - width + 1 of them)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= np.uint64(0xD1342543DE82EF95)
        out += hashes[j : j + n]
    return mix(out)


def window_starts(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, row) of each window that lies inside one row."""
    room = np.maximum(counts - width + 1, 0)
    rows = np.repeat(np.arange(len(counts)), room)
    ahead = np.repeat(np.cumsum(counts) - counts - (np.cumsum(room) - room), room)
    return np.arange(len(rows)) + ahead, rows


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in a run of ``width`` words from any of ``starts`` (width: scalar or array)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:n]) > 0


def by_piece(f: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text", size: int = PIECE):
    """For mapInArrow: applies f to runs of rows with bounded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(column), size):
                yield f(batch.slice(a, b - a))

    return run
