"""Forward-backward against enumeration, held-out accuracy, edge cases."""

from itertools import product

import numpy as np
from pyspark.sql import functions as F

from storylake.llm import crf
from storylake.llm import quality_crf as qc

FOLDER = "/root/testdata/sf0.01"


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    lengths, transition = np.array([3, 0, 1, 5]), rng.normal(size=(2, 2))
    scores = rng.normal(size=9)
    got, pairs = crf.marginals(scores, lengths, transition, with_pairs=True)
    want, counts, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        weights = {}
        for path in product((0, 1), repeat=int(n)):
            weights[path] = np.exp(sum(scores[at + i] * y for i, y in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:])))
        total = sum(weights.values())
        want += [sum(w for p, w in weights.items() if p[i]) / total for i in range(n)]
        for p, w in weights.items():
            for a, b in zip(p, p[1:]):
                counts[a, b] += w / total
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, counts)


def test_line_features_do_not_depend_on_the_batch():
    texts = ["Good line.\nAnother one!", "", "A | B | C\nA | B | C\n", "é 😀"]
    own, size, lines = qc.line_features(texts)
    assert lines.tolist() == [2, 1, 3, 1] and size.tolist() == [10, 12, 0, 9, 9, 0, 7]
    at = 0
    for text, n in zip(texts, lines):
        assert np.allclose(qc.line_features([text])[0], own[at : at + n])
        at += n


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    found = qc.quality(docs, labels).join(labels, "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.9


def test_edge_cases(spark):
    rows = [(i, "Plain words in a line.\nMore of them." if i % 2 else "### $$$ ***\n%%% &&& !!!", "s") for i in range(60)]
    rows += [(100, None, "s"), (101, "", "s"), (None, "words", "s"), (102, "a line\n" * 30_000, "s"), (1, "again", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(5, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in qc.quality(docs, labels).collect()}
    assert got[1].held_out is not None and 0 <= got[100].score <= 1 and got[100].score == got[101].score
    assert got[3].predicted == 1 and got[4].predicted == 0 and got[None].held_out is False
    assert qc.quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in qc.quality(docs, labels.limit(0)).collect()} == {0.5}


def test_rows_repeated_under_one_id_add_nothing_to_the_sample(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    seen = []
    monkeypatch.setattr(qc, "learn", lambda texts, labels: seen.append((texts, labels.tolist())))
    hot = docs.where("doc_id = 1").withColumn("text", F.concat("text", F.lit("~"))).crossJoin(spark.range(500)).drop("id")
    qc.fit(docs, labels)
    qc.fit(docs.unionByName(hot), labels)
    assert seen[0] == seen[1] and seen[0][0]
    monkeypatch.setattr(qc, "SAMPLE_DOCS", 20)
    qc.fit(docs, labels)
    assert 0 < len(seen[2][0]) <= 20
