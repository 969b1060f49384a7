"""Connected components by random contraction, in DataFrame operations only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """``edges``: long columns a and b. Returns (node, root), with one root for each component, for every node of an edge.

    Each round orders the nodes by a fresh hash; every node joins its smallest neighbour or stays, and edges are
    rewritten to the nodes joined. A round leaves a fraction of the nodes whatever the shape, chains and stars alike. A hub
    costs one row per edge, its minimum is combined before the shuffle and its joins can be split.
    """
    edges = checkpointed(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found, seed = None, 0
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = F.least(F.min(F.struct(F.xxhash64("b", F.lit(seed)).alias("h"), F.col("b").alias("x"))), F.first(F.struct(F.xxhash64("a", F.lit(seed)).alias("h"), F.col("a").alias("x"))))
        joined = checkpointed(both.groupBy("a").agg(low.alias("low")).select(F.col("a").alias("node"), F.col("low.x").alias("root")))
        if found is None:
            found = joined
        else:
            later = joined.select(F.col("node").alias("root"), F.col("root").alias("to"))
            found = checkpointed(found.join(later, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        a = joined.select(F.col("node").alias("a"), F.col("root").alias("x"))
        b = joined.select(F.col("node").alias("b"), F.col("root").alias("y"))
        pairs = edges.join(a, "a").join(b, "b").where("x <> y")
        edges = checkpointed(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        seed += 1
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else found


def absorb(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unites, in the labels of a block's rows, the groups of each pair (i, j). Returns the new labels and pairs that
    suffice for it: each label taken over costs one pair, however many pairs come in."""
    used = []
    while True:
        different = label[i] != label[j]
        i, j = i[different], j[different]
        if not len(i):
            return label, np.concatenate(used) if used else np.zeros((0, 2), np.int64)
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        order = np.lexsort((low, high))
        one = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
        used.append(np.stack([i[one], j[one]], axis=1))
        to = np.arange(len(label))
        to[high[one]] = low[one]
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def tiled(keyed: DataFrame, keys: list[str], by: str, size: int, weight: str | None = None, most: int = 0) -> DataFrame:
    """Rows of ``keyed`` whose key is not their own alone, ready to be compared within ``group``. A key with more than
    ``size`` rows, or with more than ``most`` of the column ``weight``, is cut into tiles; each pair of tiles is a group, in which ``side`` 0
    meets side 1 (in a tile's own group all are of side 0 and meet each other). So no task holds a whole frequent key, and each pair meets
    once."""
    of = F.ceil(F.count("*") / size).cast("long")
    if weight:
        # Two tiles meet in a group, so each takes half; more tiles than rows would stay empty.
        of = F.greatest(of, F.when(F.sum(weight) > most, F.least(F.count("*"), F.ceil(2 * F.sum(weight) / most).cast("long"))))
    many = keyed.groupBy(*keys).agg(F.count("*").alias("_n"), of.alias("_of")).where("_n > 1").drop("_n")
    rows = keyed.join(many, keys).withColumn("_i", F.pmod(F.xxhash64(by), F.col("_of")))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_of") - 1), lambda j: F.struct((F.least("_i", j) * F.col("_of") + F.greatest("_i", j)).alias("pair"), (F.col("_i") > j).cast("int").alias("side")))
    rows = rows.withColumn("_m", F.explode(meets))
    return rows.select("*", F.xxhash64(*keys, "_m.pair").alias("group"), F.col("_m.side").alias("side")).drop("_of", "_i", "_m")
