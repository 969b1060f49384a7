"""Mixing sources to target weights by pivotal rounding, in DataFrame operations only.

A source's target divided by its size is the number of copies of each of its documents: a whole number and a
fraction. Fractions are rounded in pairs: words move from one document's fraction to the other's until one of them is
whole, in a direction drawn so that every expectation holds, and the words of the pair stay the same. Documents fall into
small leaves by hash; a leaf takes large documents first and leaves at most one fraction; those meet in the leaf above, up a tree to
one fraction for each source, which goes to the nearer whole number. So a source's words miss its target by half a
document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import WORD, attached, checkpointed

#: Documents of a leaf on average, and leaves that meet in the one above.
LEAF = 32
_EDGE = 1e-9


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``place``, the position from 0 by code point, null last, without bringing all sources together."""
    dealt = checkpointed(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before, offsets = 0, []
    for r in dealt.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        offsets.append((r.part, before))
        before += r.n
    offsets = dealt.sparkSession.createDataFrame(offsets, "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.withColumn("row", place).join(offsets, "part").withColumn("place", F.col("row") + F.col("before")).drop("part", "row", "before")


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sources``: source, source_size. Adds ``target``: ``share`` of all sizes by weight, where weights repeat by place,
    at most ``most`` times the source's size; what is over is shared again by weight until none is above."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    known = checkpointed(ranked(sources).withColumn("weight", weight))
    total = known.agg(F.sum("source_size").alias("n")).first().n or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * level > most * F.col("source_size") if capped >= 0 else F.lit(False)
        r = known.agg(F.sum(F.when(full, most * F.col("source_size")).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"), F.count(F.when(full, 1)).alias("n")).first()
        if r.n == capped or not r.open:
            break
        level, capped = (share * total - r.held) / r.open, r.n
    return known.withColumn("target", F.least(F.col("weight") * level, most * F.col("source_size"))).drop("weight", "place")


def _uniform(*of: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / float(1 << 53)


def _pair(a: Column, b: Column, seed: int) -> tuple[Column, Column]:
    """Fractions of two documents after one transfer of words between them."""
    up = F.least((1 - a.f) * a.m, b.f * b.m)
    down = F.least(a.f * a.m, (1 - b.f) * b.m)
    moved = F.when(_uniform(a.id, b.id, F.lit(seed)) * (up + down) < down, up).otherwise(-down)
    return a.f + moved / a.m, b.f - moved / b.m


def _rounded(f: Column) -> Column:
    return F.when(f < _EDGE, 0.0).when(f > 1 - _EDGE, 1.0).otherwise(f)


def _fold(units: Column, seed: int) -> Column:
    """Folds a leaf's documents: struct(open: the document still fractional, or null; done: those decided)."""
    unit = "struct<m:double,id:bigint,f:double>"

    def step(state: Column, x: Column) -> Column:
        a, b = _pair(state.open, x, seed)
        a, b = (F.struct(y.m.alias("m"), y.id.alias("id"), _rounded(f).alias("f")) for y, f in ((state.open, a), (x, b)))
        return F.when(state.open.isNull(), F.struct(x.alias("open"), state.done.alias("done"))).otherwise(_close(state.done, a, b))

    def _close(done: Column, a: Column, b: Column) -> Column:
        whole = lambda y: (y.f == 0) | (y.f == 1)
        return F.struct(F.when(~whole(a), a).when(~whole(b), b).alias("open"), F.concat(done, F.filter(F.array(a, b), whole)).alias("done"))

    start = F.struct(F.lit(None).cast(unit).alias("open"), F.array().cast(f"array<{unit}>").alias("done"))
    return F.aggregate(units, start, step)


def pivotal(units: DataFrame, n: DataFrame, seed: int = 0) -> DataFrame:
    """``units``: source, id, m (words, over 0), f (fraction, over 0 and under 1); ``n``: source and its number of units.
    Returns id and k, 0 or 1, of every unit; ``id`` tells all units apart."""
    leaves = F.greatest(F.lit(1), F.ceil(F.col("n") / LEAF)).cast("long")
    counted = n.select("source", leaves.alias("leaves"))
    biggest = counted.agg(F.max("leaves").alias("n")).first().n or 1
    level = attached(units, counted, "source", "id").select("source", F.pmod(F.xxhash64("id"), F.col("leaves")).alias("leaf"), F.struct("m", "id", "f").alias("unit"))
    out = []
    while True:
        grouped = level.groupBy("source", "leaf").agg(F.sort_array(F.collect_list("unit"), asc=False).alias("units"))
        folded = checkpointed(grouped.select("source", "leaf", _fold(F.col("units"), seed + len(out)).alias("x")))
        out.append(folded.select(F.explode("x.done").alias("d")).select("d.id", F.col("d.f").cast("int").alias("k")))
        rest = folded.where(F.col("x.open").isNotNull())
        if biggest == 1:
            last = F.col("x.open")
            out.append(rest.select(last.id.alias("id"), (last.f >= 0.5).cast("int").alias("k")))
            break
        level = rest.select("source", F.expr(f"leaf div {LEAF}").alias("leaf"), F.col("x.open").alias("unit"))
        biggest = -(-biggest // LEAF)
    whole = out[0]
    for x in out[1:]:
        whole = whole.union(x)
    return whole


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """doc_id, source, size (words), source_size, target, copies and taken (size times copies) of every row of ``docs``.

    Null texts and texts without words have size 0 and are taken with 0 words. Rows that share a source and an id
    are one document of their joint size and get the same number of copies. A null source comes last, as one source. Draws
    come from hashes, so that reruns agree; a last fraction of a half becomes a copy. Texts of any length are counted whole. An empty
    table gives an empty result; further columns are ignored, whatever their names.
    """
    sized = checkpointed(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    sources = checkpointed(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, most))
    known = sources.select("source", "source_size", "target")
    each = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    whole = F.floor(each + _EDGE)
    units = attached(sized.groupBy("source", "doc_id").agg(F.sum("size").cast("double").alias("m")), known, "source", "doc_id")
    units = units.select("source", F.xxhash64("source", "doc_id").alias("id"), "m", (each - whole).alias("f")).where((F.col("f") > _EDGE) & (F.col("m") > 0))
    # One row for each id, so that two documents of equal hash share a draw and stay two rows.
    drawn = pivotal(units, sources.select("source", "n"), seed).groupBy("id").agg(F.max("k").alias("k"))
    rows = sized.withColumn("id", F.xxhash64("source", "doc_id")).join(drawn, "id", "left")
    rows = attached(rows, known, "source", "doc_id")
    copies = (whole + F.coalesce("k", F.lit(0))).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
