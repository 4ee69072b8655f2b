"""Suffix arrays against sorting, and removed bytes against brute force over all windows."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storylake.llm import suffix_dedup as sd
from storylake.llm.suffix_array import permuted_prefixes, suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(1, 4))
def test_suffix_array_and_prefixes(symbols, times):
    text = bytes(symbols * times)
    want = sorted(range(len(text)), key=lambda i: text[i:])
    sa = suffix_array(np.frombuffer(text, np.uint8))
    assert sa.tolist() == want
    prefix = permuted_prefixes(np.frombuffer(text, np.uint8), sa, 24)
    for before, at in zip(want, want[1:]):
        n = 0
        while n < 24 and at + n < len(text) and before + n < len(text) and text[at + n] == text[before + n]:
            n += 1
        assert prefix[at] == n


def brute(rows):
    texts = sorted({(sd.LAST if i is None else i, t or "") for i, t in rows}, key=lambda r: (r[0], tags[r[1]]))
    first, covered = {}, {}
    for n, (doc, text) in enumerate(texts):
        raw, cover = text.encode(), set()
        for i in range(len(raw) - sd.LENGTH + 1):
            window = raw[i : i + sd.LENGTH]
            place = (doc, tags[text], i)
            if window in first and first[window] != place:
                cover |= set(range(i, i + sd.LENGTH))
            first.setdefault(window, place)
        covered[doc, text] = cover
    out = []
    for doc, text in rows:
        raw, cover = (text or "").encode(), covered[sd.LAST if doc is None else doc, text or ""]
        runs = sum(i in cover and i - 1 not in cover for i in range(len(raw)))
        kept = bytes(b for i, b in enumerate(raw) if i not in cover)
        out.append((doc, len(raw), len(cover), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


tags: dict[str, int] = {}


def check(spark, rows, **options):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, first string")
    tags.update({r.t: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()})
    got = sd.repeats_digest(docs, **options).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


def test_against_brute_force(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdeé😀") for _ in range(rnd.randint(2, 7)))
    passages = [" ".join(word() for _ in range(rnd.choice([15, 30, 90]))) for _ in range(8)]
    rows = []
    for i in range(70):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 40))), rnd.choice(passages), word(), rnd.choice(passages)[rnd.randint(0, 60) :]]
        rnd.shuffle(parts)
        rows.append((rnd.choice([i, i, i, 1000 - i]), " ".join(parts)))
    base = passages[2] * 3
    for _ in range(25):  # near copies: many different fragments under the same anchors
        at = rnd.randrange(len(base))
        rows.append((2000 + len(rows), base[:at] + word() + base[at:]))
    rows += [(5000, None), (5001, ""), (None, passages[3] * 2), (None, passages[3] * 2), (5002, "a" * 3000), (5003, "ab" * 700 + "a" * 300), (rows[3][0], "short"), (rows[4][0], rows[4][1]), (rows[5][0], rows[6][1] + "!")]
    check(spark, rows)
    check(spark, rows, crowd=1)  # every anchor of several fragments is split
    check(spark, rows, crowd=4)


def test_pieces_of_equal_windows_meet():
    rnd = random.Random(4)
    base = bytes(rnd.choice(b"abcdefgh") for _ in range(600))
    texts = [base] + [base[:at] + b"#" + base[at + rnd.randint(0, 2) :] for at in (rnd.randrange(600) for _ in range(30))]
    anchor, _, text, first, windows = sd.fragments(texts)
    parts = [texts[t][a : a + n + sd.LENGTH - 1] for t, a, n in zip(text, first, windows)]
    second, whole, part, window, count = sd.pieces(parts, anchor.view(np.int64))
    seen, same = {}, {}
    for key, digest, p, w, n in zip(second.tolist(), whole.tolist(), part.tolist(), window.tolist(), count.tolist()):
        assert n <= sd.PIECE and same.setdefault((key, digest), parts[p][w : w + n + sd.LENGTH - 1]) == parts[p][w : w + n + sd.LENGTH - 1]
        for i in range(w, w + n):
            assert seen.setdefault(parts[p][i : i + sd.LENGTH], key) == key
    assert count.sum() == windows.sum()


def test_lengths_around_the_limit(spark):
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(400))
    check(spark, [(1, text[:99]), (2, text[:99]), (3, text[:100]), (4, text[:101]), (5, "x" + text[:100]), (6, text), (7, text[50:160] + text[200:310])])


def test_empty_table(spark):
    assert sd.repeats_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_notice_in_very_many_texts_gathers_nowhere(spark):
    """The anchor in the notice has different fragments in very many texts; no task meets more than a few of them."""
    rnd = random.Random(12)
    notice = b"We use cookies to make this site better for everyone, okay?!"
    text = lambda: bytes(rnd.choices(range(97, 123), k=150)) + notice + bytes(rnd.choices(range(97, 123), k=150))
    rows = [(i, text().decode()) for i in range(20_000)]
    rows[500] = (500, rows[7][1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    described = docs.selectExpr("doc_id AS doc", "xxhash64(text) AS tag", "text").mapInArrow(sd._describe, sd.SCHEMA)
    kinds = {r["kind"]: r["n"] for r in described.groupBy("kind").count().withColumnRenamed("count", "n").collect()}
    assert kinds[sd.FREQUENT] > 1_000  # more than HOT, by an anchor inside the notice
    met = sd._spread(described, sd.HOT)
    largest = met.where(f"kind <> {sd.CROWDED}").groupBy("anchor").count().agg(F.max("count")).first()[0]
    assert largest is None or largest <= sd.HOT
    found = {r.doc_id: (r.n_removed, r.n_spans) for r in sd.repeats_digest(docs).collect()}
    assert found.pop(500) == (360, 1) and set(found.values()) == {(0, 0)}
