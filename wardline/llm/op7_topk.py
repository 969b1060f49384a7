"""Exact top-k search by tiled matrix products.

Rows are packed into shards and queries into tiles, as matrices of whole numbers. A cell is a tile and a band of a few shards,
so every shard meets every tile once. A cell multiplies a part of its tile with one shard at a time, selects each
query's best, and returns one short list for each query; lists are merged up a tree of fixed fan-in over the bands.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors of a shard, queries of a tile, shards of a band at most, lists merged at once, queries of a product.
SHARD, TILE, BAND, FAN_IN, _STEP = 4096, 8192, 16, 32, 512
_EXACT, _LONG = float(1 << 53), float(1 << 63)
_OWN = np.iinfo(np.int64).min


def whole(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, ``v`` (floor(scale * x) of each component) and ``n``, the number of rows that have both; without ids, vectors or
    components that are null or not finite. A component beyond a long is held to the largest long."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    most = math.nextafter(_LONG, 0)
    v = F.transform(x, lambda e: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), e * scale))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad)
    return rows.groupBy(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).agg(F.count("*").alias("n"))


def _packed(size: int, by: str):
    def pack(key, table):
        ids, copies = (table.column(c).to_numpy() for c in ("vec_id", "n"))
        lists = table.column("v").combine_chunks()
        flat, lengths = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        rows, first, of = [], 0, np.concatenate([[0], np.cumsum(lengths)])
        for width in np.unique(lengths):
            pick = np.flatnonzero(lengths == width)
            block = flat[of[pick][:, None] + np.arange(width)]
            # An order that depends on the rows alone, so that a task run again numbers them alike.
            several = len(np.unique(ids[pick])) < len(pick)
            order = np.lexsort((*block.T[::-1], ids[pick])) if several else np.argsort(ids[pick])
            pick, block = pick[order], block[order]
            small = np.abs(block).max(initial=0) < 1 << 31 and block.min(initial=0) > -(1 << 31)
            for i in range(0, len(pick), size):
                some, part = pick[i : i + size], block[i : i + size]
                raw = np.ascontiguousarray(part, "<i4" if small else "<i8").tobytes()
                rows.append((key[0].as_py(), int(width), first, 4 if small else 8, ids[some].astype("<i8").tobytes(), copies[some].astype("<i8").tobytes(), raw))
                first += len(some)
        names, kinds = [by, "width", "first", "bytes", "ids", "copies", "block"], [pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names)

    return pack


def _unpacked(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(r["ids"], "<i8")
    return ids, np.frombuffer(r["copies"], "<i8"), np.frombuffer(r["block"], f"<i{r['bytes']}").reshape(len(ids), r["width"])


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k largest scores of each row, ties to the smaller id."""
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k]
        rows, columns = np.nonzero(scores >= least[:, None])
    else:
        rows, columns = np.nonzero(np.ones(scores.shape, bool))
    order = np.lexsort((ids[columns], ~scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[rank < k], columns[rank < k]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; those beyond a long are held to the largest."""
    bound = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if bound < _EXACT:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    if bound < _LONG / 2:
        return q.astype(np.int64) @ x.T.astype(np.int64)
    return np.clip(q.astype(object) @ x.T.astype(object), _OWN + 2, np.iinfo(np.int64).max).astype(np.int64)


def _cell(k: int):
    def cell(key, tiles, shards):
        tile, band = key[0].as_py(), key[1].as_py()
        queries, found = tiles.to_pylist(), []
        for s in shards.to_pylist():
            xi, xn, x = _unpacked(s)
            for t in (t for t in queries if t["width"] == s["width"]):
                qi, qn, q = _unpacked(t)
                for a in range(0, len(qi), _STEP):
                    scores = products(q[a : a + _STEP], x)
                    left = np.broadcast_to(xn, scores.shape)
                    i, j = np.nonzero(qi[a : a + _STEP, None] == xi[None, :])
                    own = (q[a + i] == x[j]).all(axis=1)
                    if own.any():
                        left = left.copy()
                        left[i[own], j[own]] -= 1
                        scores[left == 0] = _OWN
                    i, j = best(scores, xi, k)
                    keep = left[i, j] > 0
                    i, j = i[keep], j[keep]
                    found.append((t["first"] + a + i, qi[a + i], qn[a + i], xi[j], scores[i, j], np.minimum(left[i, j], k)))
        query, qi, qn, xi, score, n = (np.concatenate(c) for c in zip(*found)) if found else [np.zeros(0, np.int64)] * 6
        order = np.repeat(np.lexsort((xi, ~score, query)), n[np.lexsort((xi, ~score, query))])
        rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order = order[rank < k]
        columns = [query[order] + (tile << 32), qi[order], qn[order], xi[order], score[order], np.full(len(order), band)]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query", "query_id", "copies", "vec_id", "score", "band"])

    return cell


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Each query's ``k`` largest inner products with all rows but its own: query_id, rank from 1, vec_id and score.

    ``vectors`` and ``queries`` come from ``whole``, which leaves out further columns. Rows that repeat an id are all candidates,
    also of each other, and all queries, with a list each. Only vectors of the query's length are compared; empty vectors, whose
    products are 0, meet each other. Fewer rows give fewer results, none gives none; ties go to the smaller id. Products
    beyond a long are held to the largest long.
    """
    n, m = vectors.count(), queries.count()
    shards, tiles = max(1, math.ceil(n / SHARD)), max(1, math.ceil(m / TILE))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bands = max(math.ceil(shards / BAND), min(shards, math.ceil(2 * parts / tiles)))
    dealt = lambda df, of, name: df.withColumn(name, F.pmod(F.xxhash64("vec_id", "v"), F.lit(of)))
    packed = lambda df, size, name: df.groupBy(name).applyInArrow(_packed(size, name), f"{name} long, width int, first long, bytes int, ids binary, copies binary, block binary")
    copied = lambda of, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long"))).alias(name)
    left = packed(dealt(queries, tiles, "tile"), TILE, "tile").select("*", copied(bands, "band"))
    right = packed(dealt(vectors, shards, "shard"), SHARD, "shard").withColumn("band", F.col("shard") % bands).select("*", copied(tiles, "tile"))
    # By number, as the products of few bytes are long and small partitions would be joined.
    left, right = (x.repartition(parts, "tile", "band").groupBy("tile", "band") for x in (left, right))
    lists = left.cogroup(right).applyInArrow(_cell(k), "query long, query_id long, copies long, vec_id long, score long, band long")
    while True:
        bands = math.ceil(bands / FAN_IN)
        lists = lists.withColumn("band", F.expr(f"band div {FAN_IN}"))
        place = F.row_number().over(Window.partitionBy("query", "band").orderBy(F.desc("score"), "vec_id"))
        lists = lists.withColumn("rank", place).where(F.col("rank") <= k)
        if bands == 1:
            break
    each = lists.select("*", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return each.select("query_id", "rank", "vec_id", "score")
