"""The stages one by one, against plain versions of their decisions, and the whole."""

import hashlib

import corpus_pipeline
from wardline.llm import op3_toxicity, op4_mixing, op9_substrings, op10_simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    (_, toxic), (_, near), (_, repeats), (_, mixed), (_, encoded) = corpus_pipeline.STAGES
    kept = toxic(spark, docs, SF)
    assert kept.columns == docs.columns
    scores = op3_toxicity.tag(docs, op3_toxicity.fit(docs, corpus_pipeline.table(spark, SF, "labels")))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in scores.where("score < 0.3").collect())
    one = near(spark, docs, SF)
    groups = op10_simhash.similar_documents(docs).collect()
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted({r.component_id for r in groups})
    cut = {r.doc_id: r.text for r in repeats(spark, docs, SF).collect()}
    for r in op9_substrings.remove_repeats(docs).collect():
        if r.n_removed:
            assert cut[r.doc_id] == r.kept
    assert sum(cut[r.doc_id] == r.text for r in docs.collect()) > 0
    mix = mixed(spark, docs, SF)
    assert mix.columns == docs.columns
    copies = {r.doc_id: r.copies for r in op4_mixing.mix(docs).collect()}
    counted = {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert counted == {i: k for i, k in copies.items() if k}
    for r in encoded(spark, docs, SF).join(docs, "doc_id").collect():
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def _rows(df):
    return sorted((repr(tuple(r)) for r in df.select(*corpus_pipeline.COLUMNS).collect()))


def test_odd_input(spark, odd_docs, no_docs):
    (_, toxic), (_, near), (_, repeats), (_, mixed), (_, encoded) = corpus_pipeline.STAGES
    # Nothing here is toxic, nulls, empty texts, rows without an id and repeated rows included.
    assert _rows(toxic(spark, odd_docs, SF)) == _rows(odd_docs)
    one = near(spark, odd_docs, SF).collect()
    # 2, 3, 4 and the null text without an id have no words; 6 repeats 1, 14 repeats 13, 10 is 8's passage in capitals.
    ids = [r.doc_id for r in one]
    assert ids.count(2) == 1 and ids.count(1) == 1 and not {3, 4, 6, 14} & set(ids) and ids.count(None) == 2
    assert [r.text for r in one if r.doc_id == 2] == [None]
    # 8, 9 and 10 share 36 of 42 sets of five words or more.
    assert ids.count(8) == 1 and not {9, 10} & set(ids)
    cut = repeats(spark, odd_docs, SF).collect()
    texts = {r.doc_id: r.text for r in cut}
    assert len(cut) == odd_docs.count() and texts[9] == "own head two" and texts[14] == "" and texts[2] is None and texts[4] == " \t\n "
    assert {r.n_chars for r in cut if r.doc_id == 9} == {len("own head two")}
    mix = mixed(spark, odd_docs, SF)
    copies = {}
    for r in op4_mixing.mix(odd_docs).collect():
        copies.setdefault((r.source, r.doc_id), []).append(r.copies)
    counted = {(r.source, r.doc_id): r["count"] for r in mix.groupBy("source", "doc_id").count().collect()}
    assert counted == {k: sum(v) for k, v in copies.items() if sum(v)}
    out = encoded(spark, odd_docs, SF).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(out) == odd_docs.count() and all(r.n_tokens == 0 and r.ids_sha256 == empty for r in out if r.doc_id in (2, 3))
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, no_docs, SF)
        assert none.count() == 0 and (name == "bpe" or none.columns == list(corpus_pipeline.COLUMNS))


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "ids_sha256" in out.columns
