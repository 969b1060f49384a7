"""Mixing, URL filter and exact search: invariants, brute force, odd inputs."""

import math
import re
import time

import numpy as np

from wardline.llm import op4_mixing, op5_urls, op7_topk, tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})


def brute_targets(sizes):
    """``sizes`` by source, None last."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in target]
        rest = total - sum(target.values())
        w = sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * rest / w > 2 * sizes[s]]
        if not over:
            return target | {s: weight[s] * rest / w for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(odd_docs, no_docs, sample):
    for df in (odd_docs, sample):
        rows = op4_mixing.mix(df).collect()
        assert len(rows) == df.count()
        sizes, taken, joint = {}, {}, {}
        for r in rows:
            sizes[r.source] = sizes.get(r.source, 0) + r.size
            taken[r.source] = taken.get(r.source, 0) + r.taken
            joint[r.source, r.doc_id] = joint.get((r.source, r.doc_id), 0) + r.size
            assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        want = brute_targets(sizes)
        assert all(math.isclose(r.target, want[r.source], abs_tol=1e-6) and r.source_size == sizes[r.source] for r in rows)
        assert all(abs(taken[s] - want[s]) <= max(n for (t, _), n in joint.items() if t == s) / 2 + 1e-3 for s in sizes)
        again = sorted((repr(r) for r in op4_mixing.mix(df.repartition(3)).collect()))
        assert again == sorted(repr(r) for r in rows)
    texts = {r.doc_id: r.text for r in sample.collect()}
    assert all(r.size == len(WORD.findall(texts[r.doc_id])) for r in rows)
    assert op4_mixing.mix(no_docs).count() == 0


def test_sources_too_many_to_broadcast(odd_docs, monkeypatch):
    want = sorted(repr(r) for r in op4_mixing.mix(odd_docs).collect())
    monkeypatch.setattr(tables, "BROADCAST", 1)
    assert sorted(repr(r) for r in op4_mixing.mix(odd_docs).collect()) == want


def test_pivotal_keeps_sums_and_expectations(spark):
    df = spark.range(900).selectExpr("'s' AS source", "id", "CAST(1 + id % 7 AS DOUBLE) AS m", "0.3D AS f")
    n = spark.createDataFrame([("s", 900)], "source string, n long")
    size = {r.id: r.m for r in df.collect()}
    hits = np.zeros(900)
    for seed in range(6):
        out = {r.id: r.k for r in op4_mixing.pivotal(df, n, seed).collect()}
        assert len(out) == 900 and abs(sum(out[i] * size[i] for i in out) - 0.3 * sum(size.values())) <= 7
        hits += [out[i] for i in range(900)]
    assert abs(hits.mean() / 6 - 0.3) < 0.03


def test_urls(spark):
    urls = [
        ("http://a.net/x", "a.net", "/x", "net/", "block"),
        ("https://m.Example.NET/en/25#top", "m.example.net", "/en/25", "example.net/en/", "allow"),
        ("http://example.com/de/?q", "example.com", "/de/", "example.com/de/", "block"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, None),
        ("http://x.org/fr/a", "x.org", "/fr/a", "org/fr/", "allow"),
        ("http://net", "net", "", None, None),
        ("http://net?x://y/", "net", "", None, None),
        ("no scheme.net/", "", "", None, None),
        ("a://b://c.net/", "b:", "//c.net/", None, None),
        (None, "", "", None, None),
        ("", "", "", None, None),
        ("http://planet/", "planet", "/", None, None),
    ]
    df = spark.createDataFrame([(i, u[0], "h", "x") for i, u in enumerate(urls)] + [(None, "http://a.net/x", None, None)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in op5_urls.judge(df).collect()}
    assert len(got) == len(urls) + 1
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert op5_urls.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in op5_urls.judge(df, rules=()).collect()} == {"allow"}


def test_url_model_signs(spark):
    labelled = spark.createDataFrame([("abca", 1), ("abcb", 1), ("zzz", 0)], "text string, allow int")
    seen = spark.createDataFrame([("^^^a",), ("abca",), ("zzzz",)], "gram string")
    ratio = {r.gram: r.ratio for r in op5_urls.model(labelled, seen).collect()}
    assert ratio["^^^a"] > 0 and ratio["abca"] > 0 and ratio["zzzz"] < 0


def brute_urls(urls, calibrates):
    """Score, threshold and verdict of each url by dictionaries; ``calibrates``: the texts kept for the threshold."""

    def split(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        return host.translate(LOWER), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]

    def rule(u):
        host, path = split(u)
        fit = [(len(h + p), kind) for kind, h, p in op5_urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1] if fit else None

    texts = [re.sub("[^a-z0-9./:?#=&%_-]", "~", (u or "").translate(LOWER)) for u in urls]
    decided = [rule(u) for u in urls]
    known = {(t, d) for t, d in zip(texts, decided) if d}
    counts = {}
    for t, d in known:
        if t not in calibrates:
            padded = "^^^" + t
            for i in range(3, len(padded)):
                for k in range(4):
                    counts[d, padded[i - k : i + 1]] = counts.get((d, padded[i - k : i + 1]), 0) + 1
                    counts[d, "after", padded[i - k : i]] = counts.get((d, "after", padded[i - k : i]), 0) + 1

    def log_p(d, gram):
        p = (counts.get((d, gram[3:]), 0) + 1) / (counts.get((d, "after", ""), 0) + 47)
        for k in (1, 2, 3):
            p = (counts.get((d, gram[3 - k :]), 0) + 4 * p) / (counts.get((d, "after", gram[3 - k : 3]), 0) + 4)
        return math.log(p)

    def score(t):
        padded = "^^^" + t
        grams = [padded[i : i + 4] for i in range(len(t))]
        return sum(log_p("allow", g) - log_p("block", g) for g in grams) / len(t) if t else 0.0

    held = {d: [score(t) for t, e in known if e == d and t in calibrates] for d in ("allow", "block")}
    cut = 0.0
    if held["allow"] and held["block"]:
        (m0, s0), (m1, s1) = ((np.mean(x), (np.std(x, ddof=1) if len(x) > 1 else 0) + 1e-9) for x in (held["block"], held["allow"]))
        cut = (m0 * s1 + m1 * s0) / (s0 + s1)
    return [(d, score(t), cut) for t, d in zip(texts, decided)]


def test_urls_against_dictionaries(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    long = "http://long.example.com/" + "path/x-1/" * 3000
    extra = [None, "", "no scheme casino", "http://q.com/?casino=viagra", "http://q.com/", "HTTP://Q.com/\u00e9\u65e5 ~", "x", long, "http://a.net/x", "http://a.net/x", "http://b.org/fr/1", "HTTP://B.org/fr/1#x"]
    rows = [(r.page_id, r.url, "y") for r in pages.collect()] + [(1_000_000 + i, u, "y") for i, u in enumerate(extra)]
    df = spark.createDataFrame(rows, "page_id long, url string, score string")
    texts = df.select(op5_urls._plain(df.url).alias("t"))
    apart = {r.t for r in texts.where(op5_urls.calibrates(texts.t)).collect()}
    got = {r.page_id: r for r in op5_urls.judge(df).collect()}
    assert len(got) == len(rows)
    for (i, u, _), (decided, score, cut) in zip(rows, brute_urls([u for _, u, _ in rows], apart)):
        assert math.isclose(got[i].score, score, abs_tol=2e-6) and math.isclose(got[i].threshold, cut, abs_tol=2e-6)
        if decided or abs(score - cut) > 1e-5:
            assert got[i].verdict == (decided or ("allow" if score >= cut else "block"))
    assert got[1_000_003].score != got[1_000_004].score and got[1_000_002].score != 0


def test_urls_of_a_million_characters(spark):
    """The cost is linear in a URL's length; equal rows are scored alike."""
    long = "http://long.example.com/" + "path/x-1/" * 120_000
    urls = [long, long, long + "z", "http://a.net/x", "http://b.net/y", "http://c.org/fr/1", "http://d.org/fr/2"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    start = time.monotonic()
    got = {r.page_id: r for r in op5_urls.judge(df).select("page_id", "score").collect()}
    assert time.monotonic() - start < 60
    texts = df.select(op5_urls._plain(df.url).alias("t"))
    apart = {r.t for r in texts.where(op5_urls.calibrates(texts.t)).collect()}
    for i, (_, score, _) in enumerate(brute_urls(urls, apart)):
        assert math.isclose(got[i].score, score, abs_tol=2e-6)


def test_topk(vectors, spark):
    w = op7_topk.whole(vectors)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in op7_topk.search(w, w.where("vec_id % 100 = 0")).collect()}
    rows = {r.vec_id: r.v for r in w.collect()}
    assert set(rows) == {0, 100, 3, 4, 5, 200, 11, 12, 13}
    for q in (0, 100, 200):
        scores = sorted((-sum(a * b for a, b in zip(rows[q], v)), i) for i, v in rows.items() if i != q and len(v) == 2)
        assert [got[q, k + 1] for k in range(len(scores))] == [(i, -s) for s, i in scores]
    none = op7_topk.whole(vectors.limit(0))
    assert op7_topk.search(none, none).count() == 0
    assert op7_topk.search(w, w.where("vec_id = -1")).count() == 0


def test_topk_with_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(op7_topk, "SHARD", 40)
    monkeypatch.setattr(op7_topk, "TILE", 3)
    monkeypatch.setattr(op7_topk, "FAN_IN", 2)
    monkeypatch.setattr(op7_topk, "BAND", 3)
    monkeypatch.setattr(op7_topk, "_STEP", 2)
    rng = np.random.default_rng(0)
    x = rng.integers(-3, 4, (300, 5)) / 4
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    w = op7_topk.whole(df)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in op7_topk.search(w, w.where("vec_id % 20 = 0"), 4).collect())
    y = np.floor(x * 1024).astype(int)
    want = []
    for q in range(0, 300, 20):
        best = sorted((-int(y[q] @ y[i]), i) for i in range(300) if i != q)[:4]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want


def test_large_numbers():
    huge = np.array([[2**40, -(2**40)]])
    assert op7_topk.products(huge, huge).tolist() == [[2**63 - 1]]
    assert op7_topk.products(huge, -huge).tolist() == [[-(2**63) + 2]]
    middle = np.array([[2**30, 3]])
    assert op7_topk.products(middle, middle).tolist() == [[2**60 + 9]]


def test_topk_of_odd_rows(spark, monkeypatch):
    """Every row but the query's own is a candidate: rows that repeat an id, a query's id and whole rows included; vectors may be empty."""
    rows = [(3, [1.0]), (3, [5.0]), (100, [1.0]), (100, [2.0]), (100, [2.0]), (200, []), (300, []), (5, []), (0, [0.5, 0.5]), (6, [4.0e18]), (7, [-1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard in (op7_topk.SHARD, 1):
        monkeypatch.setattr(op7_topk, "SHARD", shard)
        w = op7_topk.whole(df)
        got = {}
        for r in op7_topk.search(w, w.where("vec_id % 100 = 0"), 3).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        most = 2**63 - 1
        x = 2**63 - 1024
        first = [(1, 6, min(most, x * 1024)), (2, 3, 5 * 1024**2), (3, 100, 2 * 1024**2)]
        second = [(1, 6, min(most, x * 2048)), (2, 3, 10 * 1024**2), (3, 100, 4 * 1024**2)]
        assert sorted(got[100]) == sorted(first + 2 * second)
        assert sorted(got[200]) == [(1, 5, 0), (2, 300, 0)] and sorted(got[300]) == [(1, 5, 0), (2, 200, 0)]
        assert 0 not in got and set(got) == {100, 200, 300}
