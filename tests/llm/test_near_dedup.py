"""Near duplicates against brute force over all pairs, and the parts of the method."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np

from storylake.llm import dart_minhash
from storylake.llm import near_dedup as nd
from storylake.llm.components import components
from storylake.llm.hashing import U, mix


def bag(text):
    words = [w for w in re.split(r"[^\w]+", (text or "").lower()) if w]
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def brute(rows, threshold=0.8):
    bags, parent = {i: bag(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(bags), 2):
        if bags[a] and bags[b]:
            if sum((bags[a] & bags[b]).values()) >= threshold * sum((bags[a] | bags[b]).values()):
                a, b = sorted((find(a), find(b)))
                parent[b] = a
    return {i: find(i) for i in bags}


def corpus():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(25):
        words = rnd.choices(vocabulary, k=rnd.choice([3, 30, 200, 900]))
        rows.append((n, " ".join(words)))
        n += 1
        for edits in (0, 1, 2, 12):
            changed = list(words)
            for _ in range(edits):
                changed[rnd.randrange(len(changed))] = "changed" + str(rnd.random())
            rows.append((n, " ".join(changed).upper() + "!"))
            n += 1
    line = "one very common line of boiler plate text that many share "
    rows += [(n + i, line + " ".join(rnd.choices(vocabulary, k=12))) for i in range(30)]
    n += 30
    return rows + [(n, None), (n + 1, ""), (n + 2, "?!"), (n + 3, "long " * 30_000), (n + 4, "long " * 30_000)]


def test_classes_against_brute_force(spark):
    rows = corpus()
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got} == brute(rows)


def test_every_pair_of_a_crowded_bucket_is_compared(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(24)]
    rows[15] = (15, rows[7][1] + " more")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = spark.createDataFrame([(i, [1]) for i, _ in rows], "node long, bands array<long>")
    for block in (256, 6):
        monkeypatch.setattr(nd, "BLOCK", block, raising=False)
        roots = nd.node_classes(nodes, docs, 0.8, "doc_id", "text").collect()
        assert {(r.node, r.root) for r in roots} == {(15, 7)}


def test_stage_keeps_one_of_each_class_and_rows_without_id(spark):
    text = "a b c d e f g h"
    rows = [(3, text, 1), (2, text, 2), (None, text, 3), (9, None, 4), (9, None, 5)]
    kept = nd.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, node int"))
    assert kept.columns == ["doc_id", "text", "node"]
    assert sorted(r.node for r in kept.collect()) == [2, 3, 4, 5]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_duplicates(empty).count() == 0 and nd.drop_near_copies(empty).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    elements = mix(np.arange(60, dtype=U))
    a, b = rng.uniform(0.2, 4, 60), rng.uniform(0.2, 4, 60)
    both = dart_minhash.signatures(np.tile(elements, 2), np.concatenate([a, b]), np.repeat([0, 1], 60), 2, 4000)
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((both[0] == both[1]).mean() - truth) < 0.03


def test_signature_does_not_depend_on_the_batch():
    elements = mix(np.arange(500, dtype=U))
    alone = dart_minhash.signatures(elements[:7], np.ones(7), np.zeros(7, int), 1, 125)
    among = dart_minhash.signatures(np.concatenate([elements, elements[:7]]), np.ones(507), np.repeat([0, 1], [500, 7]), 2, 125)
    assert (alone[0] == among[1]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def similar_pairs(rows, threshold=0.8):
    """Every pair of different bags at the threshold, by a prefix filter: two such bags share one of the rarest shingles of each."""
    bags = {}
    for i, text in rows:
        if found := bag(text):
            bags.setdefault(frozenset(found.items()), (i, found))
    places = Counter(s for _, found in bags.values() for s in found)
    by_shingle, pairs = {}, set()
    for i, found in bags.values():
        size, lead = sum(found.values()), 0
        for shingle in sorted(found, key=lambda s: (places[s], s)):
            if lead > (1 - threshold) * size + 1e-9:  # so much weight may be missing from a similar bag
                break
            lead += found[shingle]
            for other, theirs in by_shingle.get(shingle, ()):
                if (other, i) not in pairs and sum((found & theirs).values()) >= threshold * sum((found | theirs).values()) - 1e-9:
                    pairs.add((other, i))
            by_shingle.setdefault(shingle, []).append((i, found))
    return pairs


def test_recall_over_ten_thousand_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    classes = {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()}
    pairs = similar_pairs([(r.doc_id, r.text) for r in docs.collect()])
    kept = sum(classes[a] == classes[b] for a, b in pairs)
    assert len(pairs) > 30 and kept >= 0.99 * len(pairs)


def test_stages_with_awkward_names(spark):
    rows = [(1, "a b c d e f g h", 1, 2), (2, "a b c d e f g h", 3, 4), (2, None, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` long, gone_id long")
    kept = nd.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.gone_id for r in kept.collect()) == [2]
