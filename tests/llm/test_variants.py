"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

from wardline.llm import op13_variants

LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})


def words(rows):
    out = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = run.translate(LOWER)
            x = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            out[run[: x % len(run)] + run[x % len(run) + 1 :] if x % 31 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(count):
    links, out = {}, []
    for w, n in count.items():
        others = [v for v in count if near(w, v)]
        best = min(others, key=lambda v: (-count[v], v), default=None)
        links[w] = best if best is not None and count[best] >= 10 * n else None, len(others)
    for w, (form, n_near) in links.items():
        root = w
        while links[root][0] is not None:
            root = links[root][0]
        out.append((w, form, root, count[w], n_near, count.get(form)))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=repr)


def test_documents(odd_docs, no_docs, sample):
    for df in (odd_docs, sample.limit(60)):
        assert got(op13_variants.grouped(df)) == brute(words(df.collect()))
    assert op13_variants.grouped(no_docs).count() == 0


def table(spark, count):
    return spark.createDataFrame(list(count.items()), "word string, n long")


def test_random_words(spark, monkeypatch):
    """Short alphabets, so that most words have neighbours, halves repeat and chains of forms are long; small shards, parts and matrices."""
    r = random.Random(3)
    count = {"".join(r.choice("abé") for _ in range(r.randint(1, 9))): 10 ** r.randint(0, 6) + r.randint(0, 1) for _ in range(700)}
    want = brute(count)
    assert got(op13_variants.variants(table(spark, count))) == want
    for name, value in (("WORDS", 100), ("OWNERS", 5), ("_TILE", 64), ("_MANY", 30)):
        monkeypatch.setattr(op13_variants, name, value)
    assert got(op13_variants.variants(table(spark, count))) == want


def test_halves_that_many_words_share(spark, monkeypatch):
    monkeypatch.setattr(op13_variants, "_MANY", 2000)
    r = random.Random(4)
    ends = {"".join(r.choice("xyz") for _ in range(6)) for _ in range(300)}
    count = {"common" + e: r.randint(1, 50) for e in ends} | {e + "common": r.randint(1, 50) for e in ends}
    assert got(op13_variants.variants(table(spark, count))) == brute(count)


def test_long_words_and_chains(spark):
    long = "abcdefghij" * 3000
    count = {long: 500, long[:-1]: 40, "z" + long: 3, "chained": 10**6, "chainedd": 10**5, "chaineddd": 10**4, "chaineddds": 10**3, "chainedddst": 10**2}
    assert got(op13_variants.variants(table(spark, count))) == brute(count)


def test_halves_of_halves(monkeypatch):
    """Called here, as a changed constant doesn't reach the tasks: each ordered pair is found once, however small the matrices."""
    r = random.Random(5)
    ends = sorted({"".join(r.choice("xyz") for _ in range(r.randint(5, 8))) for _ in range(150)})
    words = ["common" + e for e in ends] + [e + "common" for e in ends]
    want = sorted((a, b) for a in words for b in words if near(a, b))
    for many, tile in ((1 << 22, 1 << 20), (2000, 64), (30, 64)):
        monkeypatch.setattr(op13_variants, "_MANY", many)
        monkeypatch.setattr(op13_variants, "_TILE", tile)
        got = [(words[i], words[j]) for p, q in op13_variants.neighbours(words, [3] * len(words), words) for i, j in zip(p.tolist(), q.tolist())]
        assert sorted(got) == want
