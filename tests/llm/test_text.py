"""Language-model scores, BPE, toxicity and quality: brute force, round trips, held-out accuracy, odd inputs."""

import base64
import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import tiktoken

from wardline.llm import op1_hpylm, op2_bpe, op3_toxicity, op6_quality, tables
from wardline.llm.words import Words, pack, pack_sorted, unpack, unpack_sorted

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})


def test_words():
    texts = ["a  bb\tccc", None, "", " x", "é ü", "last"]
    w = Words(pa.array(texts))
    flat = [x for t in texts for x in WORD.findall(t or "")]
    assert [bytes(w.buf[a:b]).decode() for a, b in zip(w.start, w.end)] == flat
    assert w.counts().tolist() == [len(WORD.findall(t or "")) for t in texts]
    h = w.hashes()[0]
    assert len(set(h.tolist())) == len(set(flat))
    x = np.sort(h)
    assert (unpack_sorted(pack_sorted(x)) == x).all() and (unpack(pack(x), np.uint64) == x).all()


def test_hpylm(odd_docs, no_docs, sample):
    for df in (odd_docs, sample):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        tokens = [WORD.findall((t or "").translate(LOWER)) + ["</s>"] for _, t in rows]
        held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
        c = collections.Counter(x for t, h in zip(tokens, held) if not h for x in t)
        n, v = sum(c.values()), len(c)
        base = [(i, h, len(t), sum(x in c for x in t), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), 5)) for (i, _), h, t in zip(rows, held, tokens)]
        got = op1_hpylm.score(df, chunk_bytes=50_000).collect()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=repr) == sorted(base, key=repr)
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert op1_hpylm.score(no_docs).count() == 0


def test_hpylm_sums_to_one():
    """After every context, a spread one included, the probabilities of the vocabulary, the end and one unknown word add up to 1."""
    train = "a b a c a b b c a a b c d a b a b"
    every = " ".join(f"{u} {w}" for u in "abcd" for w in ("a", "b", "c", "d", "unseen"))
    docs = pa.table({"text": [train, train[:9], every, "a", "b", "c", "d"], "fold": [0, 0, 1, 1, 1, 1, 1]})
    word_a = int(op1_hpylm._Chunk(docs, 1, {}).high[np.searchsorted(op1_hpylm._Chunk(docs, 1, {}).words, Words(pa.array(["a"])).hashes()[0][0])])
    for shards, hot in ((1, {}), (3, {}), (3, {word_a: 2})):
        asked = op1_hpylm._gather(shards, hot)([pa.scalar(0)], docs)
        answer, got = op1_hpylm._answer(hot, 0.8, 1.0, 0.6, 5, 2), {}
        for kind in (0, 1):
            for s in range(shards):
                part = asked.filter(pa.compute.and_(pa.compute.equal(asked["kind"], kind), pa.compute.equal(asked["shard"], s)))
                if part.num_rows:
                    for r in answer([pa.scalar(kind), pa.scalar(s)], part).to_pylist():
                        got[kind, s] = r["head"], r["values"], r["extra"]
        x = op1_hpylm._Chunk(docs, shards, hot)
        p, c, n, v = op1_hpylm._probabilities(x, got, shards, 0.8, 1.0, 0.6, 1.0)
        assert (n, v) == (len(train.split()) + len(train[:9].split()) + 2, 5)
        for u in Words(pa.array(["a b c d"])).hashes()[0]:
            mine = x.words[x.u] == u
            assert mine.sum() == 6 and math.isclose(p[mine].sum(), 1.0, rel_tol=1e-5)


def test_seating_by_enumeration():
    """Gibbs's mean tables equal those of the exact distribution over all seatings of two small restaurants."""
    d, theta = 0.8, 1.0
    c, context, prior = np.array([3, 2, 6, 1, 5, 4]), np.array([0, 0, 0, 0, 1, 1]), np.array([0.3, 0.2, 0.05, 0.1, 0.4, 0.01])
    ways = {(0, 0): 1.0}
    for n in range(6):
        for t in range(1, n + 2):
            ways[n + 1, t] = ways.get((n, t - 1), 0.0) + (n - d * t) * ways.get((n, t), 0.0)
    assert all(math.isclose(math.exp(op1_hpylm.stirling(d, 64)[k]), w) for k, w in ways.items() if w)
    want = np.zeros(len(c))
    for r in (0, 1):
        dishes = np.flatnonzero(context == r)
        total, sums = 0.0, np.zeros(len(dishes))
        for t in itertools.product(*(range(1, c[i] + 1) for i in dishes)):
            w = math.prod(theta + d * i for i in range(sum(t))) * math.prod(prior[i] ** k * ways[c[i], k] for i, k in zip(dishes, t))
            total, sums = total + w, sums + w * np.array(t)
        want[dishes] = sums / total
    got = op1_hpylm.gibbs(c, context, prior, d, theta, np.ones(2), 6000, 50, 1)
    assert np.abs(got - want).max() < 0.04


def test_hpylm_levels_are_coupled(spark):
    """Scores don't depend on how texts are dealt into chunks: the root's customers are the contexts' tables, not their chunks."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = ({r.doc_id: r for r in op1_hpylm.score(docs, chunk_bytes=b).collect()} for b in (1 << 30, 10_000))
    held = [r for r in one.values() if r.held_out]
    apart = sum(many[r.doc_id].score - r.score for r in held) / sum(r.n_tokens for r in held)
    assert len(one) == len(many) and abs(apart) < 0.003


def test_bpe(spark, odd_docs, no_docs, sample):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(op2_bpe.VOCABULARY), "rb"))}
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (odd_docs, sample):
        want = sorted(((r.doc_id, *_digests(exact.encode_ordinary(r.text or ""), r.text or "")) for r in df.select("doc_id", "text").collect()), key=repr)
        assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op2_bpe.digest(df).collect()), key=repr) == want
    assert op2_bpe.digest(no_docs).count() == 0
    encoder = op2_bpe.Encoder(public_tokenizers.path(op2_bpe.VOCABULARY), public_tokenizers.PATTERN)
    for text in ("a" * 5000, "ab" * 3000, " " * 1000 + "x", "\n" * 700, "é" * 900, "日本語" * 500, "\x00\x01", "zq" * 130, "it's  we'll\t\tfoo 123,,,," * 40):
        ids = encoder.encode([text])[0]
        assert np.frombuffer(ids, "<u4").tolist() == exact.encode_ordinary(text)
        assert encoder.decode(ids).decode() == text


def _digests(ids, text):
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_marginals_by_enumeration():
    """The scanned marginals equal those of a plain forward-backward pass."""
    field = op3_toxicity.Field()
    rng = np.random.default_rng(0)
    field.weights = rng.normal(size=len(field.weights))
    x = op3_toxicity.Tokens(pa.array(["a b c d", "", "e", " ".join(f"t{i}" for i in range(700))]))
    p, joint, start = field.marginals(x, pairs=True)
    m = field._matrices(x)
    n = len(p)
    f, b = np.zeros((n, 2)), np.ones((n, 2))
    v = np.array([0.5, 0.5])
    for t in range(n):
        v = v @ np.array([[m[0][t], m[1][t]], [m[2][t], m[3][t]]])
        v = v / v.sum()
        f[t] = v
    for t in range(n - 2, -1, -1):
        b[t] = np.array([[m[0][t + 1], m[1][t + 1]], [m[2][t + 1], m[3][t + 1]]]) @ b[t + 1]
        b[t] /= b[t].sum()
    want = f * b
    assert np.allclose(p, want[:, 1] / want.sum(axis=1))
    assert math.isclose(joint.sum(), n - 3) and math.isclose(start.sum(), 3)


def test_toxicity(spark, odd_docs, no_docs, odd_labels, no_labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = op3_toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert np.mean([r.predicted for r in toxic]) > 0.5 and np.mean([r.predicted for r in clean]) < 0.1
    for labels_ in (odd_labels, no_labels):
        got = op3_toxicity.score(odd_docs, labels_).collect()
        assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
        assert op3_toxicity.score(no_docs, labels_).count() == 0


def test_quality(spark, odd_docs, no_docs, odd_labels, no_labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = op6_quality.score(docs, labels).join(labels, "doc_id").collect()
    assert np.mean([r.kept for r in rows if r.quality]) > 0.98 and np.mean([r.kept for r in rows if not r.quality]) < 0.9
    for labels_ in (odd_labels, no_labels):
        assert op6_quality.score(odd_docs, labels_).count() == odd_docs.count()
        assert op6_quality.filtered(no_docs, labels_).count() == 0


def test_quality_of_unseen_documents(spark):
    """Trusted documents that neither the model nor the thresholds have seen are kept, in a small table as well."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen = labels.where("crc32(cast(doc_id AS string)) % 4 <> 0")
    rows = op6_quality.score(docs, seen).join(labels.where("quality = 1").join(seen, "doc_id", "left_anti"), "doc_id").collect()
    assert len(rows) > 50 and np.mean([r.kept for r in rows]) > 0.95


def test_quality_in_small_languages(spark):
    """Thresholds from few trusted rows (10 to 20 of these languages) keep unseen trusted documents as well, and still reject others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = []
    for odd in (0, 1):
        rows += op6_quality.score(docs, labels.where(f"doc_id % 2 = {odd}")).join(labels.where(f"doc_id % 2 <> {odd}"), "doc_id").collect()
    small = [r for r in rows if r.lang != "en"]
    assert len(small) > 100 and np.mean([r.kept for r in small if r.quality]) >= 0.95
    assert np.mean([r.kept for r in rows if not r.quality]) < 0.6


def test_cuts_of_few_rows(spark):
    """A further row of a language with 10 rows is under its cut as often as the quantile says; with many rows the cut is the quantile."""
    r = np.random.default_rng(5)
    rows = [(f"s{i}", float(x)) for i in range(300) for x in r.normal(i % 7, 1.0, 10)] + [(None, float(x)) for x in r.normal(3, 1.0, 40_000)]
    got = {c.of: c.cut for c in op6_quality._cuts(spark.createDataFrame(rows, "lang string, x double"), 0.995).collect()}
    further = np.concatenate([r.normal(i % 7, 1.0, 200) <= got[f"s{i}"] for i in range(300)])
    assert 0.985 < further.mean() < 1 and abs(got[None] - np.quantile([x for l, x in rows if l is None], 0.995)) < 0.05
    assert [c.cut for c in op6_quality._cuts(spark.createDataFrame([("a", 2.0)], "lang string, x double"), 0.995).collect()] == [2.0]
    assert op6_quality._cuts(spark.createDataFrame([], "lang string, x double"), 0.995).count() == 0


def test_pieces_have_no_false_ends():
    """Counts of a text's pieces: starts and ends only where the text has them."""
    whole = op6_quality.counts(pa.array(["a b c d e f"])).column("keys").to_pylist()
    yes, no = np.array([True, False, False]), np.array([False, False, True])
    pieces = op6_quality.counts(pa.array(["a b c", "c d", "d e f"]), yes, no).column("keys").to_pylist()
    assert set(pieces) < set(whole) and len(pieces) == 3 + 0 + 2
    assert op6_quality.counts(pa.array(["", "x", None]), no & yes, no & yes).num_rows == 0


def brute_kneser_ney(train, text):
    """Words and -ln p of a text, by dictionaries: trigram counts, then numbers of types before, down to the uniform share."""
    split = lambda t: ["<s>", "<s>", *re.findall(r"[^\x20\x09-\x0D.,;:!?]+", t.translate(LOWER)), "</s>"]
    levels = [collections.Counter() for _ in range(3)]
    for t in train:
        w = split(t)
        levels[0].update(zip(w, w[1:], w[2:]))
    for k in (1, 2):
        levels[k].update(key[1:] for key in levels[k - 1])

    def discount(level, c):
        n = collections.Counter(min(x, 5) for x in level.values())
        if not n[1] or not n[2]:
            return (0, 0.5, 0.75, 0.75)[min(c, 3)]
        k, y = min(c, 3), n[1] / (n[1] + 2 * n[2])
        return min(max(k - (k + 1) * y * n[k + 1] / max(1, n[k]), 0.05), k - 0.05)

    def p(key):
        level = levels[3 - len(key)]
        inside = {k: c for k, c in level.items() if k[:-1] == key[:-1]}
        total, left = sum(inside.values()), sum(discount(level, c) for c in inside.values())
        lower = p(key[1:]) if len(key) > 1 else 1 / (len(level) + 1)
        if not total:
            return lower
        own = inside.get(key, 0)
        return (own - discount(level, own) if own else 0) / total + left / total * lower

    w = split(text)
    return len(w) - 2, sum(-math.log(p(tuple(w[i - 2 : i + 1]))) for i in range(2, len(w)))


def test_kneser_ney(sample):
    train = ["a b a c b a d", "b a c c a", "a b", "", "A, b. a c!", *(r.text[:400] for r in sample.orderBy("doc_id").limit(8).collect())]
    model = op6_quality.Model(pa.array(train))
    texts = ["a b a", "c", "", "never seen words", "a b nothere a b", "d d d", *train[5:8]]
    n, loss = model.loss(pa.array(texts))
    want = [brute_kneser_ney(train, t) for t in texts]
    assert n.tolist() == [x for x, _ in want] and np.allclose(loss, [x for _, x in want], rtol=1e-4)
    one, _, _, _ = op6_quality.tokens(pa.array([" ".join(train)]))
    p = model.words.get(np.unique(one)).astype(float) + model.unseen
    assert math.isclose(p.sum() + model.unseen, 1.0, abs_tol=1e-5)


def test_samples_stay_bounded(spark):
    """An id that many rows repeat counts as one labelled row."""
    rows = [(1, f"kind words number {i}") for i in range(300)] + [(i, f"other text {i}") for i in range(2, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 12)], "doc_id long, quality int, toxic int")
    one = docs.groupBy("doc_id").agg({"text": "min"}).toDF("doc_id", "text")
    assert op6_quality.fit(docs, labels).unseen == op6_quality.fit(one, labels).unseen
    assert (op3_toxicity.fit(docs, labels).scale == op3_toxicity.fit(one, labels).scale).all()


def test_windows_of_long_texts(spark):
    text = "".join(chr(97 + i % 26) for i in range(2503))
    rows = spark.createDataFrame([(0, text), (1, "short"), (2, None)], "i int, t string")
    got = {r.i: r.w for r in rows.select("i", tables.windows(rows.t, 5, 100).alias("w")).collect()}
    assert [len(w) for w in got[0]] == [100] * 5 and got[0][0] == text[:100] and got[0][-1] == text[-100:] and got[0][2] == text[1201:1301]
    assert got[1] == ["short"] and got[2] == [""]


def test_long_texts_teach(spark):
    """Where every toxic or trusted text is long, the models learn from them all the same."""
    filler = " ".join(f"plain{i % 97}" for i in range(4000))
    rows = [(i, (f"{filler} zqvile{i % 3} zqvile{(i + 1) % 3} " * 2 if i % 2 else filler + filler)) for i in range(1, 121)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 121)], "doc_id long, quality int, toxic int")
    assert op6_quality.fit(docs, labels).unseen < 0.1
    assert (op3_toxicity.fit(docs, labels).weights != 0).any()
