"""SentencePiece encoding and decoding against the library."""

import random

import numpy as np
import pytest

from lexivane.llm import sentence_pieces


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentence_pieces.MODEL))


def texts():
    rng = random.Random(3)
    parts = ["a", "b", "e", "th", "ing", " ", "  ", "\n", "é", "日本", "🙂", "́", "x" * 20, ".", ",", ").", "0", "12", "\t", "<0x0A>", "<s>", "In", "er", "aaaa", "--", "\x00", "ß", "ие"]
    odd = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 5, 40, 300]))) for _ in range(600)]
    return [*odd, "", None, " ", "x" * 5000, "ab" * 3000, "a" * 450]


def test_ids_are_those_of_the_library(library):
    found = sentence_pieces.Pieces(sentence_pieces.MODEL).encode(texts())
    assert [np.frombuffer(x, dtype="<i4").tolist() for x in found] == [library.encode(t or "") for t in texts()]


def test_round_trip(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(0, "again", "x"), (None, "no id", "x"), (9999, "with ▁ inside", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    out = sentence_pieces.round_trip(df).collect()
    assert len(out) == len(rows) and all(r.n_ids == len(r.ids) for r in out)
    assert [r.doc_id for r in out if not r.same] == [9999]
    assert sentence_pieces.round_trip(df.limit(0)).count() == 0


def test_decoding_of_any_ids(spark, library):
    hello, byte = library.piece_to_id("▁Hello"), library.piece_to_id("<0xC3>")
    rows = [(1, [1, hello, 999999, -3]), (2, None), (3, []), (4, [None, hello]), (5, [byte])]
    out = {r.id: r.decoded for r in sentence_pieces.decode(spark.createDataFrame(rows, "id int, ids array<int>")).collect()}
    assert out[2] == out[3] == "" and out[1] == out[4] == "Hello" and out[5] == "�"


def test_suffix_order():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 4, 400).astype(np.uint32)
    order = sentence_pieces.suffix_array(text, 16)
    heads = [tuple(text[i : i + 16]) for i in order.tolist()]
    assert sorted(order.tolist()) == list(range(400)) and heads == sorted(heads)
