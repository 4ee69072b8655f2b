"""Encoding against the reference library, exact round trips, edge cases."""

import os
import random

import numpy as np
import pytest

from storylake.llm import unigram as un

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary file")


@pytest.fixture(scope="module")
def model():
    return un.load_model(MODEL)


def ids(text, model):
    return np.frombuffer(un.Encoder(model).encode([text])[0], np.int32).tolist()


def test_against_the_library_with_the_same_pieces(spark, model):
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto()
    with open(MODEL, "rb") as file:
        spec.ParseFromString(file.read())
    spec.trainer_spec.model_type = 1
    # The library adds scores in single precision; pieces of spaces score -1e9 and would drown the rest.
    for piece in spec.pieces:
        piece.score = max(piece.score, -40_000.0)
    library = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
    ours = un.make_model([p.piece for p in spec.pieces], [p.score for p in spec.pieces], [p.type for p in spec.pieces])
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab é😀\n ▁日thein") for _ in range(50)) for _ in range(200)]
    texts += [line for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect() for line in r.text.split("\n") if len(line) < 800]
    for text in texts:
        assert ids(text, ours) == library.encode(text), text


def test_short_and_long_stretches_agree(model):
    rnd = random.Random(2)
    words = ["▁" + "".join(rnd.choice("thein é日") for _ in range(rnd.randint(1, 9))).replace(" ", "") for _ in range(300)]
    many = un.segment_many([w.encode() for w in words], model)
    assert [np.frombuffer(b, np.int32).tolist() for b in many] == [un.segment_one(w.encode(), model) for w in words]


def test_round_trip_and_edge_cases(spark, model):
    rows = [(1, "plain text"), (2, "  two  spaces \n\n tabs\t and é😀日本 "), (3, ""), (4, None), (5, "x" * 50_000), (6, "word " * 20_000), (None, "no id"), (1, "plain text"), (7, "a▁b")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    coded = un.tokenize(docs, model)
    got = {r.doc_id: r for r in coded.collect()}
    assert coded.count() == len(rows) and got[4].ids is None and got[4].n_tokens == 0 and got[3].ids == []
    assert {i for i, r in got.items() if not r.round_trip} == {7}
    texts = {r.doc_id: r.text for r in un.decode_ids(coded, model, {"doc_id": coded.doc_id}).collect()}
    assert texts == dict(rows) | {7: "a b"}
    assert un.tokenize(docs.limit(0), model).count() == 0
