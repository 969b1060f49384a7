"""Words of whole Arrow text columns as numpy arrays: offsets and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The bytes that separate words: space and tab to carriage return.
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that any bits of a hash are usable alone."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column back to back, and len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of every text: bytes ``buf``, spans ``start``/``end``, and ``first[d]:first[d + 1]`` for text ``d``."""

    def __init__(self, column, lower: bool = False, separators: np.ndarray = SPACES):
        self.buf, self.offsets = utf8(column)
        if lower:
            self.buf = np.where((self.buf >= 65) & (self.buf <= 90), self.buf + np.uint8(32), self.buf)
        n = len(self.buf)
        inside = ~separators[self.buf]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self, *ends) -> list[np.ndarray]:
        """Hashes of each word's bytes up to each of ``ends`` (an array of end offsets; the word's own end if none), in
        blocks of a bounded number of bytes."""
        ends = ends or (self.end,)
        out = [np.empty(len(self), np.uint64) for _ in ends]
        i = 0
        while i < len(self):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + _BLOCK, side="right")))
            a, b = int(self.start[i]), int(self.end[j - 1])
            powers, inverses = _powers(_BASE, b - a), _powers(_INVERSE, b - a)
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum((self.buf[a:b].astype(np.uint64) + np.uint64(1)) * powers, out=total[1:])
            s = self.start[i:j] - a
            for o, e in zip(out, ends):
                e = e[i:j] - a
                o[i:j] = mix((total[e] - total[s]) * inverses[s] + (e - s).astype(np.uint64))
            i = j
        return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words (those that run from one text into the next included)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _powers(_BASE, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * _powers(_INVERSE, n)[: n - k + 1])


def tidy() -> None:
    """Gives memory that a finished group has freed back to the system; a worker that lives on would keep it."""
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


def pack(values: np.ndarray) -> bytes:
    """Numbers as byte planes, which a shuffle's compression shrinks well."""
    values = np.ascontiguousarray(values)
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def unpack(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """As ``pack``, for ascending unsigned 64-bit numbers: their differences."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)
