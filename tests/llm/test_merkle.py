"""The Merkle manifest against a plain version with lists."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from wardline.llm import op12_merkle
from wardline.llm.op12_merkle import FIELDS


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    values = [None if row[c] is None else str(row[c] + more if c == "n_chars" else row[c]) for c in FIELDS]
    return h("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def tree(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return levels


def path(levels, i, fanout):
    """(left, right) siblings at each level."""
    out = []
    for level in levels[:-1]:
        a = i // fanout * fanout
        out.append((level[a:i], level[i + 1 : a + fanout]))
        i //= fanout
    return out


def brute(rows, fanout=2):
    langs = defaultdict(list)
    for r in rows:
        langs[r.lang].append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees, sorted_rows = {}, {}
    for lang in order:
        sorted_rows[lang] = sorted(langs[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in sorted_rows[lang]], fanout)
    top = tree([trees[x][-1][0] for x in order], fanout)
    out = []
    for k, lang in enumerate(order):
        for i, r in enumerate(sorted_rows[lang]):
            steps = path(trees[lang], i, fanout) + path(top, k, fanout)
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.n_chars is not None
            node = leaf(r, 1) if changed else leaf(r)
            for a, b in steps:
                node = h("".join([*a, node, *b]))
            proof = h("".join("".join([*a, *b]) for a, b in steps))
            out.append((r.doc_id, leaf(r), trees[lang][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def got(df):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_documents(odd_docs, no_docs, sample):
    for df in (odd_docs, sample):
        assert got(op12_merkle.digest(df)) == brute(df.collect())
    verified = [r.verified for r in op12_merkle.digest(sample).collect()]
    assert 0 < verified.count(False) < len(verified) / 4
    assert op12_merkle.digest(no_docs).count() == 0
    one = odd_docs.where("doc_id = 1")
    assert got(op12_merkle.digest(one)) == brute(one.collect())


@pytest.mark.parametrize("fanout, block", [(2, 8), (3, 10), (16, 16), (5, 2)])
def test_rounds_and_fanouts(spark, fanout, block):
    """Several rounds of small blocks, in trees that end within a run, and a table of one language for every tree."""
    r, rows = random.Random(fanout), []
    for lang, n in ((None, 3), ("a", 1), ("b", 129), ("é", 64), ("z", 70), *((f"l{i}", i % 3 + 1) for i in range(9))):
        rows += [(r.randrange(10**6), f"text {r.random()}", lang, None, r.choice([None, 5])) for _ in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    more = [op12_merkle.F.col(c) + 1 if c == "n_chars" else op12_merkle.F.col(c) for c in FIELDS]
    changed = op12_merkle.F.when(op12_merkle.tampers(op12_merkle.F.col("doc_id")), op12_merkle.leaf(more))
    assert got(op12_merkle.manifest(df, changed, fanout=fanout, block=block)) == brute(df.collect(), fanout)


def test_any_tampering_shows(odd_docs):
    F = op12_merkle.F
    changed = F.when(F.col("doc_id") == 7, op12_merkle.leaf([F.col(c) if c != "text" else F.lit("other") for c in FIELDS]))
    rows = op12_merkle.manifest(odd_docs, changed, carry=("doc_id", "source")).collect()
    assert [r.doc_id for r in rows if not r.verified] == [7] and len({r.root for r in rows}) == 1
