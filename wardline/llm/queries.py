"""The numbered operators' queries over their whole tables, by name: QUERIES, and ORACLES where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import op1_hpylm, op2_bpe, op3_toxicity, op4_mixing, op5_urls, op6_quality, op7_topk, op8_pivots, op9_substrings, op10_simhash, op11_pieces, op12_merkle, op13_variants
from .tables import table


def op1_hpylm_score(spark, sf_dir):
    return op1_hpylm.score(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark, sf_dir):
    return op2_bpe.digest(table(spark, sf_dir, "documents"))


def op3_toxicity_crf(spark, sf_dir):
    return op3_toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_source_mixing(spark, sf_dir):
    return op4_mixing.mix(table(spark, sf_dir, "documents"))


def op5_url_filter(spark, sf_dir):
    return op5_urls.judge(table(spark, sf_dir, "pages"))


def op6_quality_kneser_ney(spark, sf_dir):
    return op6_quality.filtered(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_topk(spark, sf_dir):
    vectors = op7_topk.whole(table(spark, sf_dir, "embeddings"))
    return op7_topk.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op8_pivot_dedup(spark, sf_dir):
    return op8_pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark, sf_dir):
    return op9_substrings.digest(table(spark, sf_dir, "documents"))


def op10_simhash_dedup(spark, sf_dir):
    return op10_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_piece_bpe(spark, sf_dir):
    return op11_pieces.digest(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark, sf_dir):
    return op12_merkle.digest(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark, sf_dir):
    return op13_variants.grouped(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_hpylm_score,
        op2_byte_bpe,
        op3_toxicity_crf,
        op4_source_mixing,
        op5_url_filter,
        op6_quality_kneser_ney,
        op7_exact_topk,
        op8_pivot_dedup,
        op9_substring_dedup,
        op10_simhash_dedup,
        op11_piece_bpe,
        op12_merkle_manifest,
        op13_spelling_variants,
    )
}

#: The exact search, the links by cosine and the substring rule in plain SQL, over whole tables. The links are all there are; the index of
#: op8 may miss some of them.
ORACLES: dict[str, str] = {
    "op7_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * CAST(e AS DOUBLE))) AS x FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op8_pivot_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings
                             WHERE len(list_filter(embedding, lambda e: isfinite(e))) = len(embedding) AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
        r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings e JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
    """,
    "op9_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
        s AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER h AS g, count(*) OVER h AS k FROM x WINDOW h AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
        m AS (SELECT g, min(doc_id) AS lowest FROM s WHERE k = 13 GROUP BY g),
        f AS (SELECT s.doc_id, i, word, coalesce(lowest < s.doc_id, FALSE) AS hit FROM s LEFT JOIN m ON s.g = m.g AND k = 13),
        c AS (SELECT doc_id, i, word, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM f),
        r AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS cut, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(cut, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
    """,
}
