"""Words and rolling word hashes of Arrow string columns, in numpy.

Everything works on slices of an Arrow batch that hold a few MB of text, so a
task's memory follows the largest single document and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

#: ASCII white space: tab, line feed, vertical tab, form feed, carriage return, space.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = 0xD6E8FEB86659FD93 & ~7 | 3  # 3 modulo 8: its powers keep the longest period
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finalizer)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the base or of its inverse, from a table that is kept as long as it is small."""
    have = _powers[kind]
    if len(have) < n:
        room = -(-n // (1 << 18)) << 18
        while len(have) < room:
            step = pow(_BASE if kind == "up" else _INVERSE, len(have), 1 << 64)
            have = np.concatenate([have, have * _U(step)])
        if room <= 1 << 23:
            _powers[kind] = have[:room].copy()
    return have[:n]


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a sequence from the hashes of its two parts."""
    return mix(a * _U(0x9E3779B97F4A7C15) + b * _U(0xC2B2AE3D27D4EB4F) + _U(0x165667B19E3779F9))


def windows(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of `length` consecutive words: runs of 1, 2, 4, ... are doubled,
    then joined along the binary digits of the length."""
    n = len(words) - length + 1
    if n <= 0:
        return words[:0]
    run, size, out, done = words, 1, None, 0
    while True:
        if length & size:
            part = run[done : done + n]
            out = part if out is None else pair(out, part)
            done += size
        if size * 2 > length:
            return out
        run = pair(run[: len(run) - size], run[size:])
        size *= 2


class Words:
    """The words of consecutive rows of a string column: runs of bytes outside `gap`."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE):
        self.buf, self.offsets, self.rows = buf, offsets, len(offsets) - 1
        solid = ~gap[buf]
        edge = np.zeros(len(buf) + 1, dtype=bool)
        edge[offsets] = True
        first, last = solid.copy(), solid.copy()
        if len(buf):
            first[1:] &= edge[1:-1] | ~solid[:-1]
            last[:-1] &= edge[1:-1] | ~solid[1:]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        #: Index of each row's first word; rows + 1 entries.
        self.first = np.searchsorted(self.row, np.arange(self.rows + 1))

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def sums(self, lower: bool = False) -> np.ndarray:
        """Prefix sums from which span_hashes() takes the hash of any byte span."""
        data = LOWER[self.buf] if lower else self.buf
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power("up", len(data)), out=out[1:])
        return out

    @staticmethod
    def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (sums[ends] - sums[starts]) * _power("down", len(sums))[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * _U(0x9E3779B97F4A7C15))

    def hashes(self, lower: bool = False) -> np.ndarray:
        return self.span_hashes(self.sums(lower), self.starts, self.ends)

    def whole(self, length: int) -> np.ndarray:
        """For each start of a run of `length` words: whether the run lies in one row."""
        n = max(0, len(self) - length + 1)
        return self.row[:n] == self.row[length - 1 : length - 1 + n]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def slices(column: pa.Array, limit: int = CHUNK_BYTES, gap: np.ndarray = SPACE) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words), a few MB at a time, always whole rows."""
    data, at = column_bytes(column)
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + limit, side="right")) - 1)
        yield a, b, Words(data[at[a] : at[b]], at[a : b + 1] - at[a], gap)
        a = b
