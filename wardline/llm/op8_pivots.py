"""Embedding near-dedup by a pivot-permutation index.

Reference points (pivots) are taken from a bounded sample of the vectors; their number grows with the root of the table's, so that lists stay
short. A vector is described by its nearest pivots in order. The inverted lists are keyed by sets of three of its nearest six, so that two
vectors meet in a list exactly if they share at least three of them, and what they share is counted only once: in the list of their three
smallest shared pivots. Vectors that meet are compared by the order of their pivots (Spearman's footrule), and those in like order are
verified by cosine in double precision. Equal vectors are one class. The pairs of all short lists of a batch are verified
at once, those of long lists in matrix products; very long lists are cut into tiles. Verified pairs aren't expanded: a batch yields counts
and a spanning set of links.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import absorb, components, tiled
from .tables import checkpointed

#: Reference points: so many for each root of the number of vectors, at most so many, of a sample of four times as many vectors (at
#: least ``SAMPLE``), those with the smallest hashed ids; each as far as can be from those before it. So a large group of near
#: copies yields one, and its members agree on their nearest.
PIVOTS_PER_ROOT, MOST_PIVOTS, SAMPLE = 2.5, 16_384, 2048
NEAREST, SHARED = 6, 3
#: The largest footrule of two orders that are verified: the sum of the differences of place, pivots that only one has being in the
#: place after the last. Orders that share nothing have NEAREST * (NEAREST + 1).
FOOTRULE = 28
TILE = 1024
_SETS = np.array(list(combinations(range(NEAREST), SHARED)))
#: Rows of a list up to which its pairs are listed, and pairs that are verified at once.
_SHORT, _PAIRS = 192, 1 << 17


def _apart(sample: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` rows of ``sample``, each the one least similar to all those before it."""
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    near, pick = np.full(len(unit), -np.inf), [0]
    while len(pick) < min(most, len(unit)):
        near = np.maximum(near, unit @ unit[pick[-1]])
        pick.append(int(near.argmin()))
    return sample[pick]


def _packed(three: np.ndarray) -> np.ndarray:
    """Three ascending numbers of pivots as one."""
    return (three[..., 0] << 42) | (three[..., 1] << 21) | three[..., 2]


def _describe(pivots: np.ndarray):
    def describe(batches):
        for batch in batches:
            v = batch.column("v")
            flat, lengths = v.flatten().to_numpy(), v.value_lengths().to_numpy()
            of = np.concatenate([[0], np.cumsum(lengths)])
            near = np.zeros((len(lengths), NEAREST), np.int64)
            for width in np.unique(lengths):
                y = pivots[:, :width] if pivots.shape[1] >= width else np.pad(pivots, ((0, 0), (0, width - pivots.shape[1])))
                y = (y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)).T
                k = min(NEAREST, y.shape[1])
                every = np.flatnonzero(lengths == width)
                for i in range(0, len(every), 512):
                    rows = every[i : i + 512]
                    x = flat[of[rows][:, None] + np.arange(width)]
                    d = -(x / np.linalg.norm(x, axis=1, keepdims=True)) @ y
                    some = np.sort(np.argpartition(d, k - 1, axis=1)[:, :k], axis=1)
                    order = np.argsort(np.take_along_axis(d, some, axis=1), axis=1, kind="stable")
                    near[rows, :k] = np.take_along_axis(some, order, axis=1) + 1
            keys = _packed(np.sort(near, axis=1)[:, _SETS])
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (near, keys)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), v, *lists], ["id", "n", "v", "near", "keys"])

    return describe


def _alike(x: np.ndarray, y: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether two orders of pivots are to be verified in the list ``key``: it holds their smallest shared three, and they are in like
    order."""
    both = x[:, :, None] == y[:, None, :]
    shared = np.sort(np.where(both.any(axis=2), x, 1 << 20), axis=1)[:, :SHARED]
    i, j = np.arange(NEAREST)[None, :, None], np.arange(NEAREST)[None, None, :]
    apart = np.where(both, np.abs(i - j), 0).sum(axis=(1, 2))
    lost = np.where(~both.any(axis=2), NEAREST - np.arange(NEAREST), 0).sum(axis=1) + np.where(~both.any(axis=1), NEAREST - np.arange(NEAREST), 0).sum(axis=1)
    return (_packed(shared) == key) & (apart + lost <= FOOTRULE)


def _pairs(first: np.ndarray, last: np.ndarray):
    """Blocks of all pairs of rows of lists; each row's list goes from ``first`` to before ``last``."""
    rows = np.arange(len(first))
    n = last - rows - 1
    upto = np.cumsum(n)
    a = 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + _PAIRS, side="right")))
        p = np.repeat(rows[a:b], n[a:b])
        yield p, p + 1 + np.arange(len(p)) - np.repeat(upto[a:b] - n[a:b] - (upto[a - 1] if a else 0), n[a:b])
        a = b


def _verified(table: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (a, b, 0) that span the links of whole lists, and (a, a, n) for n rows linked to a."""
    ids, copies, side, group, key = (table.column(c).to_numpy() for c in ("id", "n", "side", "group", "key"))
    lists, near = table.column("v").combine_chunks(), table.column("near").combine_chunks().flatten().to_numpy().reshape(-1, NEAREST)
    flat, lengths = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    width = int(lengths.max())
    if (lengths == width).all():
        x = flat.reshape(-1, width)
    else:
        x = np.zeros((len(lengths), width))
        x[np.arange(width)[None, :] < lengths[:, None]] = flat
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, len(group)))
    first, last = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
    two = np.repeat(np.maximum.reduceat(side, starts), sizes)
    short = last - first <= _SHORT
    found = []
    for p, q in _pairs(np.where(short, first, 0), np.where(short, last, np.arange(len(first)) + 1)):
        keep = (lengths[p] == lengths[q]) & ((two[p] == 0) | (side[p] != side[q]))
        p, q = p[keep], q[keep]
        keep = _alike(near[p], near[q], key[p])
        p, q = p[keep], q[keep]
        close = np.einsum("ij,ij->i", x[p], x[q]) >= least
        found.append((p[close], q[close]))
    label, links, count = np.arange(len(ids)), [], np.zeros(len(ids), np.int64)

    def take(p: np.ndarray, q: np.ndarray) -> None:
        nonlocal label
        np.add.at(count, p, copies[q])
        np.add.at(count, q, copies[p])
        label, used = absorb(label, p, q)
        links.append(used)

    for p, q in found:
        take(p, q)
    for a, b in zip(starts[sizes > _SHORT], (starts + sizes)[sizes > _SHORT]):
        left = a + np.flatnonzero(side[a:b] == 0)
        right = a + np.flatnonzero(side[a:b] == 1) if two[a] else left
        for i in range(0, len(left), 256):
            p, q = np.nonzero(x[left[i : i + 256]] @ x[right].T >= least)
            p, q = left[i : i + 256][p], right[q]
            keep = (lengths[p] == lengths[q]) & ((p < q) | bool(two[a]))
            p, q = p[keep], q[keep]
            for k in range(0, len(p), _PAIRS):
                some = _alike(near[p[k : k + _PAIRS]], near[q[k : k + _PAIRS]], key[p[k : k + _PAIRS]])
                take(p[k : k + _PAIRS][some], q[k : k + _PAIRS][some])
    links = np.concatenate(links) if links else np.zeros((0, 2), np.int64)
    some = np.flatnonzero(count)
    return np.concatenate([ids[links[:, 0]], ids[some]]), np.concatenate([ids[links[:, 1]], ids[some]]), np.concatenate([np.zeros(len(links), np.int64), count[some]])


def _verify(least: float):
    def verify(batches):
        held: list[pa.RecordBatch] = []

        def runs(final: bool) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            group = table.column("group").to_numpy()
            cut = np.flatnonzero(group[1:] != group[:-1]) + 1
            stop = len(group) if final else (int(cut[-1]) if len(cut) else 0)
            held[:] = table.slice(stop).to_batches()
            out = _verified(table.slice(0, stop), least) if stop else [np.zeros(0, np.int64)] * 3
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], ["a", "b", "n"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield runs(False)
        if held:
            yield runs(True)

    return verify


def near_duplicates(vectors: DataFrame, least: float = 0.95, pivots: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors``.

    Vectors that are null, zero, or hold components that are null or not finite link with nothing. Only vectors of equal
    length link. Equal vectors always link; other links are found if the two share three of their six nearest pivots, in like order.
    Different vectors are told apart by a 64-bit hash: of 10**9 about 0.03 pairs are expected to be taken for equal. ``pivots``: how many
    reference points, by default from the number of vectors.
    Rows that repeat an id each count as a vector. A null id is no component's id unless all its ids are null. An empty
    table gives an empty result; further columns are ignored, whatever their names.
    """
    x = F.transform("embedding", lambda e: e.cast("double") + F.lit(0.0))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) | ~F.exists(x, lambda e: e != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("embedding").isNotNull() & ~bad, x).alias("v"))
    classes = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("doc"), F.count("*").alias("n"))
    classes = checkpointed(classes.select(F.xxhash64("v").alias("id"), "doc", "n", "v"))
    n = classes.count()
    pivots = pivots or min(MOST_PIVOTS, max(64, math.ceil(PIVOTS_PER_ROOT * math.sqrt(n))))
    some = [r.v for r in classes.orderBy(F.xxhash64("id"), "id").limit(max(SAMPLE, 4 * pivots)).select("v").collect()]
    points = np.zeros((max(1, len(some)), max([1, *map(len, some)])))
    for i, v in enumerate(some):
        points[i, : len(v)] = v
    described = classes.select("id", "n", "v").mapInArrow(_describe(_apart(points, pivots)), "id long, n long, v array<double>, near array<long>, keys array<long>")
    described = checkpointed(described)
    keyed = tiled(described.select("id", F.explode(F.array_distinct("keys")).alias("key")), ["key"], "id", TILE)
    lists = keyed.join(described, "id").select("group", "side", "key", "id", "n", "v", "near")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = checkpointed(lists.repartition(parts, "group").sortWithinPartitions("group", "id").mapInArrow(_verify(least), "a long, b long, n long"))
    roots = components(found.where("a <> b").select("a", "b"))
    counts = found.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    linked = classes.select("id", "doc").join(roots.withColumnRenamed("node", "id"), "id")
    lowest = linked.groupBy("root").agg(F.min("doc").alias("component"))
    several = linked.join(lowest, "root").select("id", "component")
    known = classes.select("id", "doc", "n").join(counts, "id", "left").join(several, "id", "left")
    known = checkpointed(known.select("id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "doc").alias("component")))
    each = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("id")).join(known, "id", "left")
    component = F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return each.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
