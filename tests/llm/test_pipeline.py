"""The pipeline against a brute-force version of its decisions, and its edge cases."""

import numpy as np

import corpus_pipeline as cp
from storylake.llm import language_id as li
from storylake.llm import unigram as un
from tests.llm.test_decontamination import tokens
from tests.llm.test_exact_dedup import lowered
from tests.llm.test_near_dedup import brute as near_classes

FOLDER = "/root/testdata/sf0.001"


def test_whole_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = li.fit(docs.where(~li.held_out(docs.doc_id)))
    encoders = li._encoders(model)
    rows = {r.doc_id: r.text for r in docs.collect()}
    told = {i: li.classify(t, model.languages, encoders) for i, t in rows.items()}
    rows = {i: t for i, t in rows.items() if told[i][0] != li.UNKNOWN and told[i][2] >= li.MIN_MARGIN}
    last = {}
    for i, t in rows.items():
        last[lowered(t)] = max(i, last.get(lowered(t), -1))
    rows = {i: t for i, t in rows.items() if last[lowered(t)] == i}
    classes = near_classes(list(rows.items()))
    rows = {i: t for i, t in rows.items() if classes[i] == i}
    windows = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = tokens(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    rows = {i: t for i, t in rows.items() if not hit(tokens(t))}

    got = cp.run(spark, FOLDER)
    assert got.columns == [*docs.columns, "ids", "round_trip"]
    found = {r.doc_id: r for r in got.collect()}
    assert {i: r.text for i, r in found.items()} == rows and all(r.round_trip for r in found.values())
    vocabulary = un.load_model(cp.PIECES)
    some = next(iter(found.values()))
    assert some.ids == np.frombuffer(un.Encoder(vocabulary).encode([some.text])[0], np.int32).tolist()


def test_every_stage_on_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, node int"
    rows = [(None, None, None, None, None, None, None), (1, "", "en", "s", 0, "k", 1), (2, "word " * 20_000, "en", "s", 1, "k", 2), (2, "word " * 20_000, "en", "s", 1, "k", 2)]
    rows += [(3 + i, f"some clean words number {i} of their own", "en", "s", 1, "k", 3) for i in range(4)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, FOLDER)
            assert out.columns[: len(docs.columns)] == docs.columns and out.count() <= docs.count(), name
