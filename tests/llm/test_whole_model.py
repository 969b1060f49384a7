"""The model of op6 is of all trusted texts, and shards' losses are those of one model of them."""

import pathlib
import time

import numpy as np
import pyarrow as pa

from wardline.llm import op6_quality


def test_all_trusted_texts_teach(spark, sample):
    few = [(r.doc_id, (r.text or "")[:600], r.lang) for r in sample.orderBy("doc_id").limit(150).collect()]
    # More trusted rows of the model's half than the 1,500 that a sample had held.
    rows = [(10**6 + i, f"word{i} word{i + 1} word{i % 7} ends, word{i % 50}.", "en") for i in range(4000)] + few + [(3, None, None), (3, "", None), (None, "no id", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.where("doc_id IS NOT NULL").selectExpr("doc_id", "1 AS quality").distinct()
    half = labels.where(~op6_quality._for_cut("doc_id")).join(docs, "doc_id").groupBy("doc_id").agg({"text": "min"}).toDF("doc_id", "text").collect()
    assert len(half) > 1700
    model = op6_quality.Model(pa.array([r.text for r in half], pa.string()))
    n, loss = model.loss(pa.array([r[1] for r in rows], pa.string()))
    for shards in (1, 5):
        fitted = op6_quality.fit(docs, labels, shards)
        assert np.isclose(fitted.unseen, model.unseen, rtol=1e-9)
        got = sorted((r.doc_id or -1, r.lang or "", r.n, r.loss) for r in op6_quality.losses(docs, fitted).collect())
        want = sorted((r[0] or -1, r[2] or "", int(a), float(b)) for r, a, b in zip(rows, n, loss))
        assert [x[:3] for x in got] == [x[:3] for x in want]
        assert np.allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-4)


def test_what_was_shuffled_is_removed(spark, sample):
    """Texts are judged in parts with the same losses, and nothing that a part has shuffled stays on disk."""
    docs = sample.select("doc_id", "text", "lang")
    labels = docs.where("doc_id IS NOT NULL").selectExpr("doc_id", "1 AS quality").distinct()
    folders = [pathlib.Path(str(d)) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    left = lambda: {f for d in folders for f in d.glob("*/shuffle_*.data")}
    before = left()
    op6_quality.score(docs, labels)
    for _ in range(50):
        if not left() - before:
            break
        time.sleep(0.1)
    assert not left() - before
    fitted = op6_quality.fit(docs, labels, 3)
    one, four = (sorted((r.doc_id, r.n, r.loss) for r in op6_quality.losses(docs, fitted, parts).collect()) for parts in (1, 4))
    assert one == four and len(one) == docs.count()


def test_messages_give_their_columns_back():
    r = np.random.default_rng(3)
    for n, words in ((0, 1), (1, 1), (1, 9), (2000, 40), (500, 2)):
        v, w, u, text = (r.integers(0, words, n) for _ in range(4))
        at = op6_quality._by_pair(v, w)
        got = op6_quality._columns(op6_quality._message(v[at], w[at], u[at], text[at]), n, 2)
        assert all((a == b[at]).all() for a, b in zip(got, (v, w, u, text)))
