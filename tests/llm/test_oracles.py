"""The numbered queries that SQL can express, against DuckDB; all of them run and keep their contract's columns."""

import parity
import pytest

from wardline.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op2": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op3": {"doc_id", "held_out", "score", "predicted"},
    "op4": {"doc_id", "size", "source_size", "target", "taken"},
    "op5": {"page_id", "host", "path", "rule", "verdict"},
    "op6": {"doc_id", "perplexity", "threshold", "kept"},
    "op7": {"query_id", "rank", "vec_id", "score"},
    "op8": {"vec_id", "n_links", "component_id", "kept"},
    "op9": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op10": {"doc_id", "fingerprint", "component_id"},
    "op11": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    assert parity.compare(spark, parity.connect(SF), SF, queries.QUERIES[name], queries.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert COLUMNS[name.split("_")[0]] <= set(df.columns) and df.count() > 0
