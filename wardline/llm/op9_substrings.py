"""Substring dedup by seed and extend over winnowed anchors.

A window is 13 consecutive words. Its anchor is the smallest hash of its runs of 5 words, so equal windows have
equal anchors wherever they stand. Chunks of texts send their distinct anchors to shards, which answer with one bit:
is the anchor in more than one document? Each anchor of several documents is extended both ways to all the windows that
hold it; their hashes go to shards again, which find each window's first document. Windows that start in an
earlier document are merged into maximal repeats, at least 13 words long, and those words are removed.

Nothing pairs documents: a passage shared by m documents costs one entry for each chunk that holds it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import chunked, chunks_of
from .words import Words, grams, pack, pack_sorted, tidy, unpack, unpack_sorted

_NO_ID = np.iinfo(np.int64).max
_ASK = "shard int, chunk int, keys binary, lowest binary, several binary"
_BITS = "shard int, chunk int, bits binary"
_FOUND = "chunk int, keys binary, lowest binary"


class _Windows:
    """The windows of a chunk's texts: hash, anchor and document of each."""

    def __init__(self, table: pa.Table, window: int, seed: int):
        tidy()
        self.words = Words(table.column("text"))
        self.ids = table.column("doc_id").cast(pa.int64()).fill_null(_NO_ID).to_numpy()
        hashes = self.words.hashes()[0]
        left = np.repeat(self.words.first[1:], self.words.counts()) - np.arange(len(hashes))
        self.at = np.flatnonzero(left >= window)
        self.doc = self.ids[self.words.doc()[self.at]]
        low, width = grams(hashes, seed), 1
        while width * 2 <= window - seed + 1:
            low, width = np.minimum(low[: len(low) - width], low[width:]), width * 2
        rest = window - seed + 1 - width
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        self.anchor = low[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.hash = grams(hashes, window)[self.at] if len(self.at) else np.zeros(0, np.uint64)


def _lowest(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the smallest document of each, and whether it is in several."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(keys)) - 1 if len(first) else first
    return keys[first], docs[first], docs[last] != docs[first]


def _ask(chunk: int, shards: int, keys, docs) -> pa.Table:
    keys, lowest, several = _lowest(keys, docs)
    cuts = np.searchsorted((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1))
    rows = [(s, chunk, pack_sorted(keys[a:b]), pack(lowest[a:b]), np.packbits(several[a:b]).tobytes()) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    return _rows(rows, _ASK)


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.table([pa.array(x, pa.int32() if kind == "int" else pa.binary()) for x, (_, kind) in zip(columns, fields)], [n for n, _ in fields])


def _asked(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray, list, list]:
    """What the chunks sent to a shard: chunks, the smallest document of each key and whether it is in several, for all
    entries, and by chunk the keys and the entries' own smallest document and flag."""
    tidy()
    table = table.sort_by("chunk")
    keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    low = [unpack(x, np.int64) for x in table.column("lowest").to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(table.column("several").to_pylist(), keys)]
    every = np.concatenate(keys)
    distinct, lowest, more = _lowest(np.concatenate([every, every[np.concatenate(several)]]), np.concatenate([*low, np.concatenate(low)[np.concatenate(several)]]))
    at = np.searchsorted(distinct, every)
    many = more[at] | (np.bincount(at, np.concatenate(several), len(distinct)) > 0)[at]
    return table.column("chunk").to_pylist(), lowest[at], many, keys, list(zip(low, several))


def _seeds(shards: int, window: int, seed: int):
    def seeds(key, table):
        x = _Windows(table, window, seed)
        return _ask(key[0].as_py(), shards, x.anchor, x.doc)

    return seeds


def _shared():
    def shared(key, table):
        chunks, _, many, keys, _ = _asked(table)
        cuts = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        return _rows([(key[0].as_py(), c, np.packbits(many[a:b]).tobytes()) for c, a, b in zip(chunks, cuts, cuts[1:])], _BITS)

    return shared


def _extend(shards: int, window: int, seed: int):
    def extend(key, docs, bits):
        if not docs.num_rows:
            return _rows([], _ASK)
        x = _Windows(docs, window, seed)
        anchors, at = np.unique(x.anchor, return_inverse=True)
        cuts = np.searchsorted((anchors >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1))
        hit = np.zeros(len(anchors), bool)
        for s, b in zip(bits.column("shard").to_pylist(), bits.column("bits").to_pylist()):
            hit[cuts[s] : cuts[s + 1]] = np.unpackbits(np.frombuffer(b, np.uint8), count=cuts[s + 1] - cuts[s])
        keep = hit[at]
        return _ask(key[0].as_py(), shards, x.hash[keep], x.doc[keep])

    return extend


def _first(key, table):
    chunks, lowest, _, keys, own = _asked(table)
    rows, a = [], 0
    for c, k, (low, several) in zip(chunks, keys, own):
        found = lowest[a : a + len(k)]
        keep = several | (found < low)
        a += len(k)
        if keep.any():
            rows.append((c, pack_sorted(k[keep]), pack(found[keep])))
    return _rows(rows, _FOUND)


def _remove(window: int, seed: int, carry: list[str], kinds: list[str]):
    def remove(key, docs, found):
        x = _Windows(docs, window, seed)
        w, n = x.words, len(x.words)
        keys = np.concatenate([np.zeros(0, np.uint64), *(unpack_sorted(k) for k in found.column("keys").to_pylist())])
        low = np.concatenate([np.zeros(0, np.int64), *(unpack(k, np.int64) for k in found.column("lowest").to_pylist())])
        order = np.argsort(keys)
        keys, low = keys[order], low[order]
        gone = np.zeros(len(x.at), bool)
        if len(keys):
            i = np.minimum(np.searchsorted(keys, x.hash), len(keys) - 1)
            gone = (keys[i] == x.hash) & (low[i] < x.doc)
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, x.at[gone], 1)
        np.add.at(step, x.at[gone] + window, -1)
        covered = np.cumsum(step[:n]) > 0
        doc = w.doc()
        removed = np.bincount(doc, covered, len(x.ids)).astype(np.int64)
        texts = _joined(w, doc, ~covered)
        edge = np.flatnonzero(covered & np.concatenate([[True], ~covered[:-1] | (doc[1:] != doc[:-1])])) if n else np.zeros(0, int)
        stop = np.flatnonzero(covered & np.concatenate([~covered[1:] | (doc[1:] != doc[:-1]), [True]])) + 1 if n else edge
        per = np.concatenate([[0], np.cumsum(np.bincount(doc[edge], minlength=len(x.ids)))])
        base = w.first[doc[edge]]
        spans = pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.array([{"start": int(a), "end": int(b)} for a, b in zip(edge - base, stop - base)], pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        out = [docs.column(c) for c in carry]
        return pa.table([*out, pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()), pa.array(w.counts().astype(np.int64)), pa.array(removed), spans, pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], [*carry, "kept", "n_words", "n_removed", "removed", "kept_sha256"])

    return remove


def _joined(w: Words, doc: np.ndarray, keep: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one space."""
    start, end, doc = w.start[keep], w.end[keep], doc[keep]
    size = len(w.buf)
    step = np.zeros(size + 1, np.int8)
    step[start] += 1
    step[end] -= 1
    mask = np.cumsum(step[:size], dtype=np.int8) > 0
    out = w.buf.copy()
    inner = doc[1:] == doc[:-1]
    spaces = end[:-1][inner] if len(end) else end
    out[spaces] = 32
    mask[spaces] = True
    sizes = np.bincount(doc, end - start, len(w.first) - 1) + np.bincount(doc[1:][inner], minlength=len(w.first) - 1)
    cuts = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    raw = out[mask].tobytes()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = (), window: int = 13, seed: int = 5, chunk_bytes: int = 4 << 20, chunks_per_shard: int = 4) -> DataFrame:
    """Removes every word covered by a window of ``window`` words that also starts in a document with a smaller id.

    Columns: doc_id, those of ``carry``, kept (the words left, joined by one space), n_words, n_removed, removed (maximal
    repeats as word offsets), kept_sha256; carried columns of those names are left out. Null texts count as empty: nothing kept. A null id counts as larger than
    all others. Rows that repeat an id are one document to the rule, each with its own result. Texts of any length are read whole. An
    empty table gives an empty result; columns that aren't carried are ignored, whatever their names.
    """
    carry = ["doc_id", *(c for c in carry if c not in ("doc_id", "kept", "n_words", "n_removed", "removed", "kept_sha256"))]
    docs = docs.select(*dict.fromkeys([*carry, "text"]))
    kinds = [docs.schema[c].dataType.simpleString() for c in carry]
    n = chunks_of(docs, chunk_bytes)
    shards = max(1, -(-n // chunks_per_shard))
    dealt = chunked(docs, n)
    by_chunk = dealt.groupBy("__chunk")
    shared = by_chunk.applyInArrow(_seeds(shards, window, seed), _ASK).groupBy("shard").applyInArrow(_shared(), _BITS)
    windows = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(_extend(shards, window, seed), _ASK)
    found = windows.groupBy("shard").applyInArrow(_first, _FOUND)
    schema = ", ".join(f"`{c}` {k}" for c, k in zip(carry, kinds)) + ", kept string, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept_sha256 string"
    return by_chunk.cogroup(found.groupBy("chunk")).applyInArrow(_remove(window, seed, carry, kinds), schema)


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
