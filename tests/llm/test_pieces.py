"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from wardline.llm import op11_pieces

PATH = public_tokenizers.path(op11_pieces.MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as file:
        return op11_pieces.Pieces(file.read())


def same(model, library, text):
    ids, want = np.frombuffer(model.encode(text), "<i4"), library.encode(text)
    assert ids.tolist() == want and model.decode(ids) == library.decode(want)


def test_random_characters_and_pieces(model, library):
    r = random.Random(5)
    letters, n = "abcdeéè çß  \u2581\u2581\n\t\u3000①日本の한\0😀٠ nthsing", library.get_piece_size()
    for _ in range(3000):
        same(model, library, "".join(r.choice(letters) for _ in range(r.randint(0, 40))))
        same(model, library, "".join(library.id_to_piece(r.randrange(259, n)) for _ in range(r.randint(1, 6))))


def test_long_and_empty(model, library):
    for text in ("", " ", "x" * 100_000, " " * 10_000, "aaaab " * 10_000, "the" * 30_000, "\n" * 5000, "日本" * 20_000, "a  b "):
        same(model, library, text)
    text = "word \u00e9t\u00e9 " * 300_000
    assert len(text) > op11_pieces._TEXT
    same(model, library, text)


def test_decoding_any_ids(model, library):
    r = random.Random(6)
    for _ in range(3000):
        ids = [r.randrange(32_000) if r.random() < 0.5 else r.randrange(259) for _ in range(r.randint(0, 12))]
        assert model.decode(np.array(ids, np.int32)) == library.decode(ids)


def test_bounded_tables(model, library, monkeypatch):
    monkeypatch.setattr(op11_pieces, "_UNITS", 3)
    monkeypatch.setattr(op11_pieces, "_PAIRS", 3)
    for text in ("one two three four five six", "unbelievably interdependent counterrevolutionaries"):
        same(model, library, text)


def test_another_kind_of_model():
    with pytest.raises(ValueError):
        op11_pieces.read_model(b"\x12\x02\x18\x01")


def test_documents(spark, odd_docs, no_docs, sample, library):
    for df in (odd_docs, sample):
        texts = sorted((repr(r.doc_id), r.text or "") for r in df.collect())
        rows = op11_pieces.digest(df).collect()
        want = []
        for doc_id, text in texts:
            ids = library.encode(text)
            want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
        assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(want)
    assert op11_pieces.digest(no_docs).count() == 0
    whole = {r.doc_id: r for r in op11_pieces.encode(sample).collect()}
    assert all(library.decode(list(r.ids)) == r.decoded for r in list(whole.values())[:50])
