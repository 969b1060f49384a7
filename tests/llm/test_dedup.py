"""Substring, SimHash and embedding dedup against brute force, and their odd inputs."""

import hashlib
import re

import numpy as np
import xxhash

from wardline.llm import op8_pivots, op9_substrings, op10_simhash
from wardline.llm.components import absorb, components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})
LAST = 2**63 - 1


def brute_substrings(rows, window=13):
    first = {}
    words = [(LAST if i is None else i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            first[k] = min(first.get(k, LAST), i)
    out = []
    for (i, w), (raw, _) in zip(words, rows):
        keep = [True] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                keep[j : j + window] = [False] * window
        left = [x for x, k in zip(w, keep) if k]
        out.append((raw, len(w), len(w) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def substrings(df, **options):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in op9_substrings.remove_repeats(df, **options).collect()), key=repr)


def test_substrings(odd_docs, no_docs, sample):
    for df in (odd_docs, sample.limit(120)):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert substrings(df) == brute_substrings(rows)
        assert substrings(df, chunk_bytes=20_000, chunks_per_shard=2) == brute_substrings(rows)
    assert substrings(no_docs) == []
    cut = {r.doc_id: r for r in op9_substrings.remove_repeats(odd_docs, ("lang", "chunk")).where("doc_id IS NOT NULL").collect()}
    assert cut[9].kept == "own head two" and [(s.start, s.end) for s in cut[9].removed] == [(3, 43)] and cut[9].chunk == "1"
    assert cut[6].n_removed == 0 and cut[14].n_removed == 20


def fingerprint(text, size=3):
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, close):
    label = list(range(len(ids)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in close:
        a, b = find(i), find(j)
        label[a] = b
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        if x is not None:
            least[r] = min(least.get(r, LAST), x)
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash(odd_docs, no_docs, sample):
    for df in (odd_docs, sample):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        f = [fingerprint(t) for _, t in rows]
        close = [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 3]
        want = sorted(((d, f"{x:016x}", c) for (d, _), x, c in zip(rows, f, brute_components([d for d, _ in rows], close))), key=repr)
        assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in op10_simhash.near_duplicates(df).collect()), key=repr) == want
    assert op10_simhash.near_duplicates(no_docs).count() == 0


def test_bit_slices():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(700)], np.uint64)
    values = np.unique(np.concatenate([base, base[rng.integers(0, 40, 700)] ^ flips]))
    for radius in (0, 1, 2, 3):
        distance = np.bitwise_count(values[:, None] ^ values[None, :])
        want, _ = absorb(np.arange(len(values)), *np.nonzero(distance <= radius))
        got, _ = absorb(np.arange(len(values)), *op10_simhash.linked(values, radius).T)
        assert (want == got).all()


def test_tiles_of_a_frequent_key(spark, monkeypatch):
    monkeypatch.setattr(op10_simhash, "TILE", 16)
    values = [(1 << 40) | (1 << i) | (1 << j) for i in range(12) for j in range(i)] + [5 << 30, (5 << 30) | 7]
    edges = op10_simhash.links(spark.createDataFrame([(v,) for v in values], "bits long")).collect()
    label, _ = absorb(np.arange(len(values)), *np.array([(values.index(e.a), values.index(e.b)) for e in edges]).T)
    v = np.array(values, np.uint64)
    want, _ = absorb(np.arange(len(v)), *np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= 3))
    assert (label == want).all()


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1100)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(chain + star + [(5, 5)], "a long, b long")).collect()}
    assert len({roots[i] for i in range(201)}) == 1 and len({roots[i] for i in range(1000, 1100)}) == 1 and roots[0] != roots[1000]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pivots(vectors, spark):
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in op8_pivots.near_duplicates(vectors).collect()}
    linked = {0, 3, 4, 12, None}
    want = {(i, 4 if i in linked else 0, 0 if i in linked else i, i == 0 if i in linked else True) for i in (0, 3, 4, 12, None, 5, 6, 7, 8, 9, 11, 13, 100, 200)}
    assert got == want
    assert op8_pivots.near_duplicates(vectors.limit(0)).count() == 0


def test_pivot_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(150, 32))
    x = np.concatenate([centres, centres[rng.integers(0, 20, 900)] + 0.15 * rng.normal(size=(900, 32))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    got = {r.vec_id: r.n_links for r in op8_pivots.near_duplicates(df, pivots=64).collect()}
    degrees = close.sum(axis=1)
    assert all(got[i] <= degrees[i] for i in got)
    assert sum(got.values()) >= 0.9 * degrees.sum() > 1000


def test_wide_bit_slices():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (30, 2), dtype=np.uint64)
    left = base[rng.integers(0, 30, 300)]
    right = base[rng.integers(0, 30, 500)].copy()
    for row in right:
        for b in rng.choice(128, rng.integers(0, 50), replace=False):
            row[b // 64] ^= np.uint64(1 << (int(b) % 64))
    distance = np.bitwise_count(left[:, None] ^ right[None, :]).sum(axis=2)
    for radius in (0, 3, 20, 32, 63):
        pairs = [np.stack(x, axis=1) for x in op10_simhash.near_pairs(left, right, radius)]
        got = set(map(tuple, np.concatenate(pairs).tolist()))
        assert got == set(zip(*(x.tolist() for x in np.nonzero(distance <= radius))))


def word_sets(text, size=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def similar(df, least=0.8):
    rows = [(r.doc_id, word_sets(r.text)) for r in df.where("doc_id IS NOT NULL").select("doc_id", "text").collect()]
    close = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] == rows[j][0] or rows[i][1] == rows[j][1] or len(rows[i][1] & rows[j][1]) >= least * len(rows[i][1] | rows[j][1]) > 0]
    return sorted(zip([d for d, _ in rows], brute_components([d for d, _ in rows], close)))


def test_similar_documents(odd_docs, no_docs, sample, spark, monkeypatch):
    for df in (odd_docs, sample):
        assert sorted(map(tuple, op10_simhash.similar_documents(df).collect())) == similar(df)
    assert op10_simhash.similar_documents(no_docs).count() == 0
    # A group of edited copies in several tiles, chains among them, beside texts that share half of their words.
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(150):
        w = list(words) if i < 110 else [f"v{i % 4}{x}" if k % 2 else x for k, x in enumerate(words)]
        for at in rng.choice(160, int(rng.integers(0, 4)), replace=False):
            w[at] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = similar(df)
    for tile, shingles in ((2048, 4_000_000), (16, 4_000_000), (2048, 2000)):
        monkeypatch.setattr(op10_simhash, "TILE", tile)
        monkeypatch.setattr(op10_simhash, "_SET_TILE", shingles)
        monkeypatch.setattr(op10_simhash, "_AT_ONCE", shingles)
        got = sorted(map(tuple, op10_simhash.similar_documents(df).collect()))
        assert sum(a == b for a, b in zip(got, want)) >= 147 and all(a[1] >= b[1] for a, b in zip(got, want))


def test_recall_of_similar_documents(spark):
    """Pairs of a Jaccard of 0.8 to 0.95 among many others: nearly all are found, none is wrong."""
    rng = np.random.default_rng(8)
    rows, pairs = [], []
    for i in range(400):
        w = [f"a{i}b{k}" for k in range(300)]
        v = list(w)
        for at in rng.choice(np.arange(0, 300, 12), int(rng.integers(2, 7)), replace=False):
            v[at] = f"y{i}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        a, b = word_sets(rows[-2][1]), word_sets(rows[-1][1])
        pairs.append(len(a & b) / len(a | b))
    got = dict(map(tuple, op10_simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert all(got[2 * i + 1] == 2 * i + 1 for i, j in enumerate(pairs) if j < 0.8)
    found = [got[2 * i + 1] == 2 * i for i, j in enumerate(pairs) if j >= 0.8]
    assert len(found) > 250 and np.mean(found) >= 0.95


def test_pivot_recall_over_cosines(spark):
    """Pairs spread evenly over cosines of 0.95 to 1, among as many vectors that link with nothing."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = np.linspace(0.9501, 1, len(x), endpoint=False)[:, None]
    every = np.concatenate([x, c * x + np.sqrt(1 - c * c) * z, rng.normal(size=(1500, 64))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in op8_pivots.near_duplicates(df).collect()}
    assert all(got[i] == 0 for i in range(3000, 4500)) and max(got.values()) == 1
    assert np.mean([got[i] for i in range(1500)]) >= 0.95
