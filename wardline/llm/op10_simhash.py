"""SimHash near-dedup with bit-sliced comparison.

Fingerprints that lie within 3 bits agree on at least 2 of 5 bit blocks, so distinct fingerprints are keyed by each
of the 10 pairs of blocks and compared within a key. There, bit planes stand vertically: one 64-bit word holds one bit
of 64 fingerprints, carry-save counters add up the differing planes for 64 at a time, and blocks whose counters
have all passed the radius are abandoned. Keys with many fingerprints are cut into tiles, and pairs of tiles are
compared apart. A comparison yields a spanning set of links, not all pairs.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import absorb, components, tiled
from .op9_substrings import _joined
from .tables import checkpointed
from .words import Words, grams, mix

_SHINGLES = 100_000
_DOCS = 500
#: A tile of a frequent key: at most about this many fingerprints.
TILE = 2048
_CUTS = (0, 13, 26, 39, 52, 64)


def _fingerprints(texts, size: int) -> np.ndarray:
    w = Words(texts, lower=True)
    counts = w.counts()
    raw = b"".join(_joined(w, w.doc(), np.ones(len(w), bool)))
    length = w.end - w.start
    doc = w.doc()
    last = np.zeros(len(w), bool)
    last[w.first[1:][counts > 0] - 1] = True
    end = np.cumsum(length + ~last)
    start = end - length - ~last
    end = end - ~last
    n = np.maximum(np.minimum(counts, 1), counts - size + 1)
    of = np.repeat(np.arange(len(counts)), n)
    at = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n) + w.first[:-1][of]
    a, b = start[at], end[np.minimum(at + size, w.first[1:][of]) - 1]
    ones = np.zeros((len(counts), 64), np.int64)
    digest, view = xxhash.xxh64_intdigest, memoryview(raw)
    for i in range(0, len(of), _SHINGLES):
        j = min(len(of), i + _SHINGLES)
        h = np.array([digest(view[p:q], 42) for p, q in zip(a[i:j].tolist(), b[i:j].tolist())], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.concatenate([[True], of[i + 1 : j] != of[i : j - 1]]))
        ones[of[i:j][cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _batches(size: int):
    def fingerprint(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, _DOCS):
                part = batch.slice(i, _DOCS)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(_fingerprints(part.column("text"), size).view(np.int64))], ["doc_id", "bits"])

    return fingerprint


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and the 64-bit SimHash ``bits`` of each text (null or without words: 0)."""
    return docs.select("doc_id", "text").mapInArrow(_batches(shingle), "doc_id long, bits long")


def linked(values: np.ndarray, radius: int) -> np.ndarray:
    """Pairs (i, j), j < i, that span the components of ``values`` under links of at most ``radius`` differing bits."""
    n = len(values)
    words = -(-n // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[:n] = values
    each = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(each.T.copy(), axis=1, bitorder="little").view(np.uint64)
    valid = np.packbits(np.arange(words * 64) < n, bitorder="little").view(np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    label, out = np.arange(n), []
    digits = radius.bit_length()
    for lo in range(0, n, 256):
        q = np.repeat(np.arange(lo, min(n, lo + 256)), words)
        block = np.tile(np.arange(words), len(q) // words)
        keep = block <= q // 64
        q, block = q[keep], block[keep]
        count = [np.zeros(len(q), np.uint64) for _ in range(digits)]
        over = np.zeros(len(q), np.uint64)
        for bit in range(64):
            carry = planes[bit][block] ^ np.where((values[q] >> np.uint64(bit)) & np.uint64(1), full, np.uint64(0))
            for d in range(digits):
                count[d], carry = count[d] ^ carry, count[d] & carry
            over |= carry
            if bit % 8 == 7 and bit < 63:
                live = over != full
                if not live.all():
                    q, block, over, count = q[live], block[live], over[live], [c[live] for c in count]
        near = _within(count, over, radius) & valid[block]
        some = near != 0
        q, block, near = q[some], block[some], near[some]
        rows, bits = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i, j = q[rows], block[rows] * 64 + bits
        i, j = i[j < i], j[j < i]
        label, used = absorb(label, i, j)
        out.append(used)
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _within(count: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Where a bit-sliced count that hasn't passed its digits is at most ``radius``."""
    less, equal = np.zeros_like(over), ~np.zeros_like(over)
    for d in reversed(range(len(count))):
        if radius >> d & 1:
            less |= equal & ~count[d]
            equal &= count[d]
        else:
            equal &= ~count[d]
    return (less | equal) & ~over


def _compare(radius: int):
    def compare(batches):
        key, bits = [], []

        def runs(final: bool):
            k, b = np.concatenate(key), np.concatenate(bits)
            cut = np.flatnonzero(k[1:] != k[:-1]) + 1
            stop = len(k) if final else (cut[-1] if len(cut) else 0)
            edges = []
            for i, j in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(k)]])):
                if j - i > 1 and j <= stop:
                    part = np.unique(b[i:j])
                    edges.append(part[linked(part, radius)].view(np.int64).reshape(-1, 2))
            key[:], bits[:] = [k[stop:]], [b[stop:]]
            edges = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                key.append(batch.column("group").to_numpy())
                bits.append(batch.column("bits").to_numpy().view(np.uint64))
                yield runs(False)
        if key:
            yield runs(True)

    return compare


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints in column ``bits`` that span all links of at most 3 bits."""
    if radius > 3:
        raise ValueError("5 bit blocks find a radius of 3 at most")
    parts = [F.shiftrightunsigned("bits", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(_CUTS, _CUTS[1:])]
    keys = [F.struct(F.lit(t).alias("t"), (parts[i] * 16384 + parts[j]).alias("v")) for t, (i, j) in enumerate(combinations(range(5), 2))]
    keyed = distinct.select("bits", F.explode(F.array(*keys)).alias("k")).select("bits", "k.t", "k.v")
    many = keyed.groupBy("t", "v").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / TILE)
    tile = F.pmod(F.xxhash64("bits"), tiles).alias("i")
    tiled = keyed.join(many, ["t", "v"]).select("bits", "t", "v", tiles.alias("of"), tile)
    pairs = F.when(F.col("of") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("of") - 1), lambda j: F.least("i", j) * F.col("of") + F.greatest("i", j)))
    groups = tiled.select("bits", "t", "v", F.explode(pairs).alias("p")).select(F.xxhash64("t", "v", "p").alias("group"), "bits")
    # By number, as the comparison of few bytes is long and small partitions would be joined.
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.repartition(n, "group").sortWithinPartitions("group").mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row: the smallest id reachable over links of
    fingerprints with at most ``radius`` differing bits.

    Texts that are null or have no words have fingerprint zero and link like any other; texts of fewer words than a
    shingle are one shingle. Rows with a null id are kept, and are no component's id unless all its ids are null
    (then null). Repeated rows are each returned. Texts of any length are read whole. A bit set in exactly half of the hashes is 0. An empty
    table gives an empty result; further columns are ignored, whatever their names.
    """
    each = checkpointed(fingerprints(docs, shingle))
    classes = checkpointed(each.groupBy("bits").agg(F.min("doc_id").alias("doc")))
    roots = components(links(classes.select("bits"), radius)).withColumnRenamed("node", "bits")
    joined = classes.join(roots, "bits")
    least = joined.groupBy("root").agg(F.min("doc").alias("component_id"))
    several = joined.join(least, "root").select("bits", "component_id")
    # Written, so that the last join has a shuffle on either side and the rows of a frequent fingerprint can be split.
    ids = checkpointed(classes.join(several, "bits", "left").select("bits", F.coalesce("component_id", "doc").alias("component_id")))
    return each.join(ids, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


# Documents by the similarity of their shingle sets: wider fingerprints, whose links are verified.

#: Bits of a wide fingerprint, and how many of them two sets of Jaccard 0.8 differ in at most: 19 on average, 4 standard deviation.
_BITS, _RADIUS = 128, 32
#: Fingerprints that share a key on average, in a table of any size; and the distance up to which nineteen of twenty pairs meet.
_BUCKET, _MEETS = 256, 24
_SECOND = np.uint64(0x5851F42D4C957F2D)
#: Shingles that a task verifies together, beyond which a group is cut into pairs of tiles; cells of a block's rows, and shingles
#: gathered at once.
_SET_TILE, _CELLS, _AT_ONCE = 4_000_000, 1 << 25, 1 << 21


def _shingles(texts, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct shingle hashes of each text and the text of each, by text; a text of fewer words is one shingle, one without words has
    none."""
    w = Words(texts, lower=True)
    counts, doc, hashes = w.counts(), w.doc(), w.hashes()[0]
    left = np.repeat(w.first[1:], counts) - np.arange(len(hashes))
    h, of = [], []
    for k in range(1, size + 1):
        whole = np.minimum(counts, size)[doc] == k
        at = np.flatnonzero(whole & (left >= k))
        h.append(grams(hashes, k)[at] if len(at) else np.zeros(0, np.uint64))
        of.append(doc[at])
    h, of = np.concatenate(h), np.concatenate(of)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    one = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]) if len(h) else np.zeros(0, bool)
    return h[one], of[one], len(counts)


def _by_text(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by text, modulo 2**64 for hashes."""
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    if len(of):
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        out[of[first]] = np.add.reduceat(values, first, axis=0)
    return out


def _wide(texts, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text, two hashes of its set of shingles, the two halves of its fingerprint, and the number of distinct shingles: a bit is 1
    if set in over half of these."""
    h, of, n = _shingles(texts, size)
    both = np.stack([h, mix(h ^ _SECOND)], axis=1)
    sets = _by_text(mix(both * np.uint64(3)), of, n)
    ones = np.zeros((n, _BITS), np.int64)
    for i in range(0, len(h), _SHINGLES):
        part, its = both[i : i + _SHINGLES], of[i : i + _SHINGLES]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        first = np.flatnonzero(np.concatenate([[True], its[1:] != its[:-1]]))
        ones[its[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    each = np.bincount(of, minlength=n)
    return sets, np.packbits(ones * 2 > each[:, None], axis=1, bitorder="little").view(np.uint64), each


def _widely(size: int):
    def widely(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, _DOCS):
                part = batch.slice(i, _DOCS)
                sets, print_, n = _wide(part.column("text"), size)
                columns = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (*sets.T, *print_.T, n)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *columns], ["doc_id", "s0", "s1", "f0", "f1", "n"])

    return widely


def key_masks(n: int) -> np.ndarray:
    """Bits that make up each table's key, two 64-bit words for each table: for ``n`` fingerprints, so many bits that ``_BUCKET`` share a
    key, and so many tables that nineteen of twenty pairs that differ in ``_MEETS`` bits agree on one. Tables grow with n ** 0.3."""
    width = min(48, max(1, math.ceil(math.log2(max(n, 2) / _BUCKET))))
    agree = math.comb(_BITS - _MEETS, width) / math.comb(_BITS, width)
    rng = np.random.default_rng(_BITS)
    picked = np.zeros((math.ceil(math.log(20) / agree), _BITS), bool)
    for row in picked:
        row[rng.choice(_BITS, width, replace=False)] = True
    return np.packbits(picked, axis=1, bitorder="little").view(np.uint64)


def _keyed(masks: np.ndarray):
    def keyed(batches):
        for batch in batches:
            f = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("f0", "f1")], axis=1)
            for t, m in enumerate(masks):
                k = mix(mix(f[:, 0] & m[0]) * np.uint64(3) + (f[:, 1] & m[1]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(f), t, np.int32)), pa.array(k.view(np.int64)), *(batch.column(c) for c in ("doc", "f0", "f1"))], ["t", "key", "doc", "f0", "f1"])

    return keyed


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A carry-save adder: the sums and carries of three words' bits."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int):
    """Blocks of pairs (i, j) of wide fingerprints that differ in at most ``radius`` bits. Eight planes at a time go through carry-save
    adders into counters that start so high that they run over at the first bit beyond the radius."""
    digits, words = max(4, radius.bit_length()), -(-len(right) // 64)
    padded = np.zeros((words * 64, left.shape[1]), np.uint64)
    padded[: len(right)] = right
    planes = np.packbits(np.unpackbits(padded.view(np.uint8).reshape(len(padded), -1), axis=1, bitorder="little").T.copy(), axis=1, bitorder="little").view(np.uint64)
    valid = np.packbits(np.arange(words * 64) < len(right), bitorder="little").view(np.uint64)
    full, start = np.uint64(0xFFFFFFFFFFFFFFFF), (1 << digits) - 1 - radius
    for a in range(0, len(left), 256):
        some = left[a : a + 256]
        mine = np.where(np.unpackbits(some.view(np.uint8).reshape(len(some), -1), axis=1, bitorder="little").T, full, np.uint64(0))
        q, block = np.divmod(np.arange(len(some) * words), words)
        count = [np.full(len(q), full if start >> d & 1 else np.uint64(0)) for d in range(digits)]
        over, whole = ~valid[block], True
        for bit in range(0, len(planes), 8):
            # While no block is abandoned, all rows stand against all blocks.
            d = [(planes[k][None, :] ^ mine[k][:, None]).ravel() if whole else planes[k][block] ^ mine[k][q] for k in range(bit, bit + 8)]
            count[0], two = _add(count[0], d[0], d[1])
            count[0], two_ = _add(count[0], d[2], d[3])
            count[1], four = _add(count[1], two, two_)
            count[0], two = _add(count[0], d[4], d[5])
            count[0], two_ = _add(count[0], d[6], d[7])
            count[1], four_ = _add(count[1], two, two_)
            count[2], carry = _add(count[2], four, four_)
            for k in range(3, digits):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over |= carry
            if bit + 8 > radius and bit % 16 == 8:
                live = over != full
                if not live.all():
                    q, block, over, count, whole = q[live], block[live], over[live], [c[live] for c in count], False
        rows, bits = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        yield a + q[rows], block[rows] * 64 + bits


def _not_met(x: np.ndarray, y: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Whether the fingerprints of each pair agree in none of the tables of ``masks``."""
    out = np.ones(len(x), bool)
    for i in range(0, len(x) if len(masks) else 0, 1 << 15):
        z = x[i : i + (1 << 15)] ^ y[i : i + (1 << 15)]
        for m in masks:
            out[i : i + (1 << 15)] &= ((z[:, 0] & m[0]) | (z[:, 1] & m[1])) != 0
    return out


def _met(masks: np.ndarray, radius: int):
    """Of each group, the documents with a near partner in it which they meet in no earlier table."""

    def met(batches):
        held: list[pa.RecordBatch] = []

        def runs(final: bool) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            group, t, side, doc = (table.column(c).to_numpy() for c in ("group", "t", "side", "doc"))
            f = np.stack([table.column(c).to_numpy().view(np.uint64) for c in ("f0", "f1")], axis=1)
            cut = np.flatnonzero(group[1:] != group[:-1]) + 1
            stop = len(group) if final else (int(cut[-1]) if len(cut) else 0)
            held[:] = table.slice(stop).to_batches()
            out = []
            for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(group)]])):
                if b <= stop and b - a > 1:
                    found = np.zeros(b - a, bool)
                    left, right = np.flatnonzero(side[a:b] == 0), np.flatnonzero(side[a:b] == 1)
                    within = not len(right)
                    right = left if within else right
                    for i, j in near_pairs(f[a:b][left], f[a:b][right], radius):
                        i, j = left[i], right[j]
                        if within:
                            i, j = i[i < j], j[i < j]
                        keep = ~(found[i] & found[j])
                        i, j = i[keep], j[keep]
                        first = _not_met(f[a + i], f[a + j], masks[: t[a]])
                        found[i[first]] = found[j[first]] = True
                    out.append(a + np.flatnonzero(found))
            out = np.concatenate(out) if out else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(group[out]), pa.array(doc[out])], ["group", "doc"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield runs(False)
        if held:
            yield runs(True)

    return met


def _sets(size: int):
    def sets(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, _DOCS):
                part = batch.slice(i, _DOCS)
                h, of, n = _shingles(part.column("text"), size)
                _, f, _ = _wide(part.column("text"), size)
                lists = pa.LargeListArray.from_arrays(np.searchsorted(of, np.arange(n + 1)), pa.array(h.view(np.int64))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in f.T), lists], ["doc", "f0", "f1", "shingles"])

    return sets


def _verified(least: float, radius: int):
    """Pairs of a group's documents of a Jaccard of at least ``least`` that span all such pairs within the radius. Pairs that are united
    already aren't compared, so a group of copies costs about a block of its rows against all. Memory is a few times the group's shingles."""

    def verified(key, table):
        doc, lists = table.column("doc").to_numpy(), table.column("shingles").combine_chunks()
        f = np.stack([table.column(c).to_numpy().view(np.uint64) for c in ("f0", "f1")], axis=1)
        lengths = lists.value_lengths().to_numpy().astype(np.int64)
        first = np.concatenate([[0], np.cumsum(lengths)])
        distinct, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        block = int(np.clip(_CELLS // max(1, len(distinct)), 1, 64))
        label, out = np.arange(len(doc)), []
        for lo in range(0, len(doc), block):
            hi = min(len(doc), lo + block)
            mine = np.zeros((hi - lo, len(distinct)), np.uint8)
            mine[np.repeat(np.arange(hi - lo), lengths[lo:hi]), at[first[lo] : first[hi]]] = 1
            for i, j in near_pairs(f[lo:hi], f, radius):
                # Sets whose sizes differ too much can't be similar.
                n, m = lengths[lo + i], lengths[j]
                keep = (lo + i < j) & (label[lo + i] != label[j]) & (np.minimum(n, m) >= least * np.maximum(n, m) - 1e-9)
                i, j = i[keep], j[keep]
                # The second document's shingles, gathered from the first's row, for so many pairs at once: how many of them it has.
                part = np.maximum(np.arange(len(j)) // 2048, np.cumsum(lengths[j]) // _AT_ONCE)
                cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
                for p, q in zip(np.split(i, cuts), np.split(j, cuts)):
                    again = label[lo + p] != label[q]
                    p, q = p[again], q[again]
                    if not len(q):
                        continue
                    n = lengths[q]
                    pair = np.repeat(np.arange(len(q)), n)
                    place = (first[q] - np.cumsum(n) + n)[pair] + np.arange(len(pair))
                    both = np.bincount(pair, mine[p[pair], at[place]], len(q))
                    close = both >= least * (lengths[lo + p] + n - both) - 1e-9
                    label, used = absorb(label, lo + p[close], q[close])
                    out.append(used)
        out = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return pa.table([pa.array(doc[out[:, 0]]), pa.array(doc[out[:, 1]])], ["a", "b"])

    return verified


def similar_documents(docs: DataFrame, shingle: int = 5, least: float = 0.8, radius: int = _RADIUS) -> DataFrame:
    """doc_id and component_id of every row with an id: the smallest id reachable over pairs of texts whose sets of ``shingle`` words have
    a Jaccard of at least ``least``.

    Equal sets always link. Others are found by wide SimHash fingerprints within ``radius`` bits that agree on one of several sets of
    bits (``key_masks``); every link found is verified by its whole sets. So a link may be missed, with a likelihood that falls with the
    similarity, but none is wrong. Letters are compared lower-cased (A-Z). Null texts count as empty; those without words are alike, those
    of fewer words than a shingle are one shingle. Texts of any length are read whole. Rows that repeat an id are one document. Rows
    without an id are left out; an empty table gives an empty result; further columns are ignored.
    """
    known = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    each = checkpointed(known.mapInArrow(_widely(shingle), "doc_id long, s0 long, s1 long, f0 long, f1 long, n long"))
    classes = checkpointed(each.groupBy("s0", "s1").agg(*(F.min(c).alias(d) for c, d in (("doc_id", "doc"), ("f0", "f0"), ("f1", "f1"), ("n", "n")))))
    masks = key_masks(classes.count())
    keyed = classes.select("doc", "f0", "f1").mapInArrow(_keyed(masks), "t int, key long, doc long, f0 long, f1 long")
    groups = tiled(keyed, ["t", "key"], "doc", TILE).select("group", "t", "side", "doc", "f0", "f1")
    # By number, as the comparison of few bytes is long and small partitions would be joined.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = checkpointed(groups.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(_met(masks, radius), "group long, doc long"))
    # Groups of long texts are cut further, so that no task holds more than two tiles' shingles.
    sizes = classes.groupBy("doc").agg(F.max("n").alias("n"))
    met = checkpointed(tiled(met.join(sizes, "doc").withColumnRenamed("group", "met"), ["met"], "doc", 2 * TILE, "n", _SET_TILE).select("group", "doc"))
    texts = known.join(met.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_sets(shingle), "doc long, f0 long, f1 long, shingles array<long>")
    found = met.join(texts, "doc").repartition(parts, "group").groupBy("group").applyInArrow(_verified(least, radius), "a long, b long")
    roots = components(found).withColumnRenamed("node", "doc")
    joined = classes.select("doc").distinct().join(roots, "doc")
    smallest = joined.groupBy("root").agg(F.min("doc").alias("component_id"))
    several = joined.join(smallest, "root").select("doc", "component_id")
    ids = checkpointed(classes.join(several, "doc", "left").select("s0", "s1", F.coalesce("component_id", "doc").alias("component_id")))
    return each.join(ids, ["s0", "s1"]).select("doc_id", "component_id")
