"""Contamination against brute force, proximity, edge cases."""

import hashlib
import random
import re

from storylake.llm import decontamination as dc


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = {}
    for item_id, text in items:
        w = tokens(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        w, hit, found = tokens(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[key]
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


def corpus():
    rnd = random.Random(4)
    vocabulary = [f"t{i}" for i in range(40)] + ["the", "of"] * 20
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([3, 10, 14, 60])))) for i in range(12)]
    items += [(12, "the the the the the the the the the the the the"), (13, None), (14, "?!"), (None, "unnamed item of words"), (3, items[3][1]), (15, items[5][1])]
    docs = []
    for i in range(60):
        words = rnd.choices(vocabulary, k=rnd.choice([0, 5, 80]))
        item = tokens(rnd.choice(items[:12])[1])
        a = rnd.randrange(len(item))
        docs.append((i, " ".join(words + item[a : a + rnd.choice([2, 9, 10, 11, 60])] + words).upper() + "."))
    docs += [(100, None), (101, ""), (102, "the " * 15_000), (103, "x unnamed item of WORDS y"), (None, items[5][1]), (5, docs[5][1]), (5, "other text")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = corpus()
    got = dc.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).drop("items")
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(docs, items)


def test_stage_drops_what_is_contaminated_only(spark):
    docs, items = corpus()
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, pos int")
    kept = dc.drop_contaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    clean = sum("True" not in row for row in brute(docs, items))
    assert kept.columns == frame.columns and kept.count() == clean


def test_empty_tables(spark):
    docs, items = corpus()
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert dc.contamination(docs.limit(0), items).count() == 0
    assert dc.contamination(docs, items.limit(0)).where("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha beta " + "z " * 30 + "gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    index = dc.build_index(docs, items)
    near = lambda slack: {(r.doc_id, r.item_id) for r in dc.proximity_matches(index, slack, window=3).collect()}
    assert near(0) == {(2, 7)} and near(2) == {(1, 7), (2, 7)} and near(40) == {(1, 7), (2, 7), (3, 7)}
