"""Merkle manifest of a table: a tree for each language, and a tree over their roots.

Rows become leaves by native expressions, so texts are read once and only digests move on. Leaves are put in order by ranges and numbered, and
every aligned block of them is hashed on its own: a contiguous matrix of hex digests, reshaped by the fan-out and hashed row by row, level
by level. Block roots are the leaves of the next round, until each tree has one node. On the way down each block adds the siblings
of its nodes, found by index arithmetic, to the path of its own root, so proofs cost one visit to each block.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.frames import null_safe

from .tables import BROADCAST, checkpointed

#: Leaves of a block at most (a block is a power of the fan-out).
BLOCK = 1024
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 64


def leaf(fields: list[Column]) -> Column:
    """SHA-256 of fields one after another: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


def tampers(doc_id: Column) -> Column:
    """Whether the query tampers with a row: 7 divides the crc32 of its decimal id. Rows without an id are left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``index``, the place of each row in the order of its group, from 0, and ``total``, the rows of the group. Rows are sorted by
    ranges and numbered within them; only the ranges' counts are summed up."""
    at = F.monotonically_increasing_id()
    rows = checkpointed(rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", at).withColumn("_part", F.shiftright("_at", 33)))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    starts = parts.select(*(F.col(k).alias(f"_k_{k}") for k in [*by, "_part"]), (F.coalesce(F.sum("_n").over(upto), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("total"))
    starts = checkpointed(starts)
    if starts.limit(BROADCAST + 1).count() <= BROADCAST:
        starts = F.broadcast(starts)
    joined = rows.join(starts, null_safe([*by, "_part"]))
    return joined.withColumn("index", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift", *(f"_k_{k}" for k in [*by, "_part"]))


def _matrix(digests: pa.ChunkedArray) -> np.ndarray:
    """Binary digests as rows of 64 hex digits."""
    return np.frombuffer(b"".join(digests.to_pylist()).hex().encode(), np.uint8).reshape(-1, _HEX)


def _hashed(rows: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """The digests, as rows of hex digits, of the rows of a contiguous matrix, or of the first ``sizes`` bytes of each."""
    n, width = rows.shape
    data = memoryview(np.ascontiguousarray(rows).reshape(-1))
    ends = [width] * n if sizes is None else sizes.tolist()
    return np.frombuffer("".join([sha256(data[i * width : i * width + e]).hexdigest() for i, e in enumerate(ends)]).encode(), np.uint8).reshape(n, _HEX)


def _runs(count: int, fanout: int) -> np.ndarray:
    """How many nodes each run of a level of ``count`` nodes has."""
    return np.minimum(fanout, count - np.arange(-(-count // fanout)) * fanout)


def _levels(nodes: np.ndarray, fanout: int, height: int | None) -> list[np.ndarray]:
    """``nodes`` and the levels above: ``height`` of them, or as many as leave one node."""
    out = [nodes]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        below = out[-1]
        runs = _runs(len(below), fanout)
        rows = np.zeros((len(runs) * fanout, _HEX), np.uint8)
        rows[: len(below)] = below
        out.append(_hashed(rows.reshape(len(runs), fanout * _HEX), runs * _HEX))
    return out


def _height(fanout: int, block: int) -> int:
    """The levels of a block: as many as keep its leaves within ``block``, one at least."""
    height = 1
    while fanout ** (height + 1) <= block:
        height += 1
    return height


class _Block:
    """A block's levels, and by level the siblings of its nodes' ancestors."""

    def __init__(self, table: pa.Table, fanout: int, height: int):
        # Within its tree the block ends with one node; it stops early only if that is the tree's root.
        total = table.column("total")[0].as_py()
        self.levels = _levels(_matrix(table.column("digest")), fanout, height if total > fanout**height else None)
        self.fanout, self.n = fanout, len(self.levels[0])

    def above(self, level: int):
        """For each node of the block the run of its ancestor at ``level``, as node numbers, its place within, and which of them exist."""
        node = np.arange(self.n) // self.fanout**level
        run = (node // self.fanout * self.fanout)[:, None] + np.arange(self.fanout)
        count = len(self.levels[level])
        return np.minimum(run, count - 1), node % self.fanout, run < count

    def siblings(self):
        """By level the others of each node's run, as a matrix (node, other, digit), and which of them exist. Columns are from left to right."""
        for level in range(len(self.levels) - 1):
            run, place, there = self.above(level)
            other = np.arange(self.fanout - 1) + (np.arange(self.fanout - 1) >= place[:, None])
            yield self.levels[level][np.take_along_axis(run, other, 1)], np.take_along_axis(there, other, 1), place

    def folded(self, current: np.ndarray) -> np.ndarray:
        """What the block's root becomes if each node, on its own, is replaced by its row of ``current``."""
        for level in range(len(self.levels) - 1):
            run, place, there = self.above(level)
            rows = self.levels[level][run]
            rows[np.arange(self.n), place] = current
            current = _hashed(rows.reshape(self.n, -1), there.sum(1) * _HEX)
        return current


_NODE, _PATH = "tree string, index long, total long, digest binary", "tree string, index long, left array<string>, right array<string>, root string"


def _root(fanout: int, height: int):
    span = fanout**height

    def root(table: pa.Table) -> pa.Table:
        table = table.sort_by("index")
        block, first = _Block(table, fanout, height), table.slice(0, 1)
        index, total = first.column("index")[0].as_py() // span, -(-first.column("total")[0].as_py() // span)
        return pa.table([first.column("tree"), pa.array([index]), pa.array([total]), pa.array([bytes.fromhex(block.levels[-1].tobytes().decode())], pa.binary())], ["tree", "index", "total", "digest"])

    return root


def _paths(fanout: int, height: int):
    def paths(table: pa.Table, above: pa.Table) -> pa.Table:
        table = table.sort_by("index")
        block, n = _Block(table, fanout, height), table.num_rows
        left, right = [[] for _ in range(n)], [[] for _ in range(n)]
        for nodes, there, place in block.siblings():
            for i in range(n):
                left[i].append(nodes[i, : place[i]][there[i, : place[i]]].tobytes().decode())
                right[i].append(nodes[i, place[i] :][there[i, place[i] :]].tobytes().decode())
        more, root = [above.column(c)[0].as_py() for c in ("left", "right")], above.column("root")[0].as_py()
        strings = pa.list_(pa.string())
        return pa.table([table.column("tree"), table.column("index"), pa.array([x + more[0] for x in left], strings), pa.array([x + more[1] for x in right], strings), pa.array([root] * n, pa.string())], ["tree", "index", "left", "right", "root"])

    return paths


def _proved(fanout: int, height: int, carry: list[str]):
    def proved(leaves: pa.Table, above: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("index")
        block, n = _Block(leaves, fanout, height), leaves.num_rows
        left, right = (above.column(c)[0].as_py() for c in ("left", "right"))
        rest = "".join(a + b for a, b in zip(left, right)).encode()
        parts = list(block.siblings())
        nodes = np.concatenate([p[0] for p in parts], axis=1) if parts else np.zeros((n, 0, _HEX), np.uint8)
        there = np.concatenate([p[1] for p in parts], axis=1) if parts else np.zeros((n, 0), bool)
        proofs = [sha256((nodes[i] if whole else nodes[i][there[i]]).tobytes() + rest).hexdigest() for i, whole in enumerate(there.all(axis=1).tolist())]
        changed = leaves.column("changed").to_pylist()
        current = block.levels[0].copy()
        for i, digest in enumerate(changed):
            if digest is not None:
                current[i] = np.frombuffer(digest.hex().encode(), np.uint8)
        folded = block.folded(current)
        top: dict[bytes, str] = {}
        for node in {r.tobytes() for r in folded}:
            top[node] = reduce(lambda x, ends: sha256(ends[0].encode() + x + ends[1].encode()).hexdigest().encode(), zip(left, right), node).decode()
        text = lambda m: pa.array([r.tobytes().decode() for r in m], pa.string())
        out = [text(block.levels[0]), pa.array([above.column("root")[0].as_py()] * n, pa.string()), pa.array(proofs, pa.string()), pa.array([top[r.tobytes()] for r in folded], pa.string())]
        return pa.table([*(leaves.column(c) for c in carry), *out], [*carry, "leaf", "subroot", "proof_sha256", "folded_root"])

    return proved


def _blocks(nodes: DataFrame, fanout: int, height: int):
    return nodes.groupBy("tree", F.floor(F.col("index") / fanout**height).alias("block"))


def grown(nodes: DataFrame, fanout: int, height: int) -> list[DataFrame]:
    """``nodes``: tree, index, total and digest (binary) of all leaves. Returns them and the block roots of each round; the last are the trees' roots."""
    most = nodes.agg(F.max("total").alias("n")).first().n or 0
    out = [nodes]
    while True:
        out.append(checkpointed(_blocks(out[-1].select("tree", "index", "total", "digest"), fanout, height).applyInArrow(_root(fanout, height), _NODE)))
        most = -(-most // fanout**height)
        if most <= 1:
            return out


def routed(rounds: list[DataFrame], fanout: int, height: int, roots: DataFrame) -> DataFrame:
    """The paths of the nodes of rounds[0], given those of the trees' roots (index 0)."""
    paths = roots
    for nodes in reversed(rounds[:-1]):
        by = _blocks(nodes, fanout, height).cogroup(paths.groupBy("tree", "index"))
        paths = checkpointed(by.applyInArrow(_paths(fanout, height), _PATH))
    return paths


def manifest(docs: DataFrame, changed: Column | None = None, carry: tuple[str, ...] = ("doc_id",), fanout: int = 2, block: int = BLOCK) -> DataFrame:
    """The columns of ``carry``, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``.

    A node is the SHA-256 of the hex digests of ``fanout`` consecutive ones, of fewer at the end, while there are several; a lone leaf is its own
    root. A task hashes ``block`` nodes at once at most. ``changed``: a row's leaf as found later (null: as it was); folded_root is recomputed from it and the row's siblings. Each row is a
    leaf, whatever it repeats: rows of one language and id are in the order of their leaves, and a null id or language comes first. Any column may be
    null, texts may be empty or of any length; an empty table gives an empty result. Further columns are ignored, whatever their names.
    """
    changed, height = F.lit(None).cast("string") if changed is None else changed, _height(fanout, block)
    rows = docs.select(*(F.col(c).alias(f"c_{c}") for c in carry), F.col("lang").alias("tree"), "doc_id", F.unhex(leaf([F.col(c) for c in FIELDS])).alias("digest"), F.unhex(changed).alias("changed"))
    leaves = checkpointed(numbered(checkpointed(rows), ["tree"], ["doc_id", "digest"]).drop("doc_id"))
    rounds = grown(leaves, fanout, height)
    tops = numbered(rounds[-1].select("tree", "digest"), [], ["tree"]).withColumnRenamed("tree", "lang").withColumn("tree", F.lit(None).cast("string"))
    tops = checkpointed(tops)
    over = grown(tops, fanout, height)
    found = over[-1].first()
    root = found.digest.hex() if found else None
    whole = over[-1].select("tree", "index", *(F.array().cast("array<string>").alias(c) for c in ("left", "right")), F.lit(root).cast("string").alias("root"))
    paths = routed(over, fanout, height, whole).drop("tree").join(tops.select("lang", "index", F.hex("digest").alias("subroot")), "index")
    paths = paths.select(F.col("lang").alias("tree"), F.lit(0).cast("long").alias("index"), "left", "right", F.lower("subroot").alias("root"))
    schema = ", ".join(f"`c_{c}` {docs.schema[c].dataType.simpleString()}" for c in carry) + ", leaf string, subroot string, proof_sha256 string, folded_root string"
    # The leaves' own paths stay within their blocks; only those of block roots are written.
    above = routed(rounds[1:], fanout, height, paths)
    out = _blocks(leaves, fanout, height).cogroup(above.groupBy("tree", "index")).applyInArrow(_proved(fanout, height, [f"c_{c}" for c in carry]), schema)
    return out.select(*(F.col(f"c_{c}").alias(c) for c in carry), "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


def digest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, of which those that ``tampers`` names have one character more than they say by the time they are verified."""
    more = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    return manifest(docs, F.when(tampers(F.col("doc_id")), leaf(more)))
