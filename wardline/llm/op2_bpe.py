"""Byte-level BPE over length-bucketed padded matrices.

A text's pieces (matches of the tokenizer's pattern) are encoded once for each distinct piece of a batch. Pieces of similar
length stand in one padded matrix; each round every row merges its leftmost pair of minimum rank, pairs being
looked up in a hashed table, and rows with nothing left to merge are compacted away. Pieces over 256 bytes, rare in
text, follow the same rule with a heap of candidates, as a matrix would take quadratic time for them.
"""

from __future__ import annotations

import base64
import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
_WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 64, 128, 256)
_NONE = np.int32(2**31 - 1)
_TEXT = 1 << 21
_PIECES = 200_000
_CACHE = 300_000


class Encoder:
    """Encodes and decodes by the ranks in a file of base64 tokens and ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.find = regex.compile(pattern)
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {(self.ranks[t[:i]], self.ranks[t[i:]]): r for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        keys = np.array([(a << 32) | b for a, b in pairs], np.uint64)
        self._build(keys, np.array(list(pairs.values()), np.int32))
        self.known = {t: np.uint32(r).tobytes() for t, r in self.ranks.items()}
        self.cache: dict[str, bytes] = {}

    def _build(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = np.uint64(64 - int(len(keys) * 4).bit_length())
        size = 1 << (64 - int(self.bits))
        self.keys, self.values = np.full(size, ~np.uint64(0)), np.full(size, _NONE)
        at, self.probes = self._slot(keys), 0
        while len(keys):
            free = np.flatnonzero(self.keys[at] == ~np.uint64(0))
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & (size - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; a large number where it is no token."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at, out = self._slot(keys), np.full(len(keys), _NONE)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            found = self.keys[at]
            hit = found == keys
            out[todo[hit]] = self.values[at[hit]]
            go = ~hit & (found != ~np.uint64(0))
            if not go.any():
                break
            todo, keys, at = todo[go], keys[go], (at[go] + 1) & (len(self.keys) - 1)
        return out

    def _rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Encodes pieces of 2 to ``width`` bytes in one padded matrix."""
        n, lengths = len(pieces), np.array([len(p) for p in pieces])
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        tokens = self.single[flat]
        inside = np.arange(width - 1)[None, :] < (lengths - 1)[:, None]
        ranks = np.full((n, width - 1), _NONE)
        ranks[inside] = self.rank(tokens[:, :-1][inside], tokens[:, 1:][inside])
        out: list[bytes] = [b""] * n
        ids = np.arange(n)
        while len(ids):
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(ids)), at]
            done = low == _NONE
            if done.any():
                for i, row, k in zip(ids[done].tolist(), tokens[done].astype("<u4"), lengths[done].tolist()):
                    out[i] = row[:k].tobytes()
                live = ~done
                ids, tokens, ranks, lengths, at, low = ids[live], tokens[live], ranks[live], lengths[live], at[live], low[live]
                if not len(ids):
                    break
                width = int(lengths.max())
                tokens, ranks = tokens[:, :width], ranks[:, : width - 1]
            row = np.arange(len(ids))
            tokens[row, at] = low
            take = np.minimum(np.arange(width)[None, :] + (np.arange(width)[None, :] > at[:, None]), width - 1)
            tokens = np.take_along_axis(tokens, take, axis=1)
            ranks = np.take_along_axis(ranks, np.minimum(take[:, :-1], max(width - 2, 0)), axis=1)
            lengths = lengths - 1
            ranks[np.arange(width - 1)[None, :] >= (lengths - 1)[:, None]] = _NONE
            for where in (at - 1, at):
                ok = np.flatnonzero((where >= 0) & (where < lengths - 1))
                ranks[ok, where[ok]] = self.rank(tokens[ok, where[ok]], tokens[ok, where[ok] + 1])
        return out

    def _long(self, piece: bytes) -> bytes:
        tokens = [int(self.single[b]) for b in piece]
        n = len(tokens)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.rank(np.array(tokens[:-1]), np.array(tokens[1:])).tolist()
        heap = [(r, i, tokens[i], tokens[i + 1]) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        join, ranks = self.bytes, self.ranks
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if tokens[i] == a else n
            if j >= n or tokens[j] != b:
                continue
            tokens[i], tokens[j] = r, -1
            nxt[i] = k = nxt[j]
            if k < n:
                prev[k] = i
            for x, y in ((prev[i], i), (i, k)):
                if x >= 0 and y < n and (s := ranks.get(join[tokens[x]] + join[tokens[y]])) is not None:
                    heapq.heappush(heap, (s, x, tokens[x], tokens[y]))
        return np.array([t for t in tokens if t >= 0], "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Encodes the pieces that aren't in the cache, and keeps the cache bounded."""
        new = [p for p in pieces if p not in self.cache]
        if len(self.cache) + len(new) > _CACHE:
            self.cache, new = {}, list(pieces)
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in new:
            raw = p.encode("utf-8")
            if (whole := self.known.get(raw)) is not None:
                self.cache[p] = whole
            else:
                buckets.setdefault(next((w for w in _WIDTHS if len(raw) <= w), 0), []).append((p, raw))
        for width, rows in buckets.items():
            codes = self._rows([raw for _, raw in rows], width) if width else [self._long(raw) for _, raw in rows]
            self.cache.update(zip((p for p, _ in rows), codes))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if sum(map(len, texts)) > 2 * _TEXT:
            return [b"".join(self._stream(t)) for t in texts]
        found = [self.find.findall(t) for t in texts]
        self.learn(set().union(*found))
        return [b"".join(map(self.cache.__getitem__, x)) for x in found]

    def _stream(self, text: str):
        matches = (m[0] for m in self.find.finditer(text))
        while block := list(islice(matches, _PIECES)):
            self.learn(set(block))
            yield b"".join(map(self.cache.__getitem__, block))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _code(path: str, pattern: str, carry: list[str]):
    def code(batches):
        encoder = Encoder(path, pattern)
        for batch in batches:
            i, sizes = 0, np.cumsum([len(t) if t else 0 for t in (x.as_py() for x in batch.column("text"))])
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + _TEXT, side="right")))
                texts = [t or "" for t in batch.column("text").slice(i, j - i).to_pylist()]
                # Copies of a text often stand side by side; each is encoded once.
                once = list(dict.fromkeys(texts))
                ids = encoder.encode(once)
                of = {t: k for k, t in enumerate(once)}
                take = pa.array([of[t] for t in texts], pa.int64())
                both = [pa.array(x, pa.binary()).take(take) for x in (ids, [encoder.decode(x) for x in ids])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in carry), *both], [*carry, "ids", "decoded"])
                i = j

    return code


def encode(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The columns of ``carry``, ids (packed little-endian unsigned 32-bit integers) and decoded (their bytes).

    ``path`` is a rank file that every worker can open. Null texts count as empty (no ids); texts of any length are encoded
    whole. Every row is encoded for itself, whatever its id; an empty table gives an empty result. Columns that aren't carried are
    ignored, whatever their names.
    """
    docs = docs.select(*carry, "text")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry) + ", ids binary, decoded binary"
    return docs.mapInArrow(_code(path or public_tokenizers.path(VOCABULARY), pattern, list(carry)), schema)


def digest(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return encode(docs, carry).select(*carry, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
