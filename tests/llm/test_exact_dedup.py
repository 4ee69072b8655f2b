"""Exact dedup against a brute-force grouping, and its edge cases."""

import hashlib
import random

from pyspark.sql import functions as F

from storylake.llm import exact_dedup as ed

SCHEMA = "doc_id long, text string, kept string"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = {}
    for doc_id, text, _ in rows:
        groups.setdefault(lowered(text), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        best = max(ids, key=lambda i: -1 if i is None else i)
        for n, doc_id in enumerate(sorted(ids, key=lambda i: (i is None, -(i or 0)))):
            out.append((doc_id, best, len(ids), n == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(str, out))


ROWS = [
    (1, "Same Text", "x"), (2, "same text", "x"), (3, "other", None), (3, "other", "again"), (4, None, "x"), (5, "", "x"),
    (6, "É", "x"), (7, "é", "x"), (8, "word " * 20_000, "x"), (9, "WORD " * 20_000, "x"), (10, "word " * 20_000 + "!", "x"), (None, "same text", "x"),
]


def test_against_brute_force(spark):
    got = ed.exact_dedup(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(ROWS)


def test_stage_keeps_one_row_of_each_text_with_all_columns(spark):
    kept = ed.drop_exact_copies(spark.createDataFrame(ROWS, SCHEMA))
    assert kept.columns == ["doc_id", "text", "kept"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted("2 3 5 6 7 9 10".split())


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ed.exact_dedup(empty).count() == 0
    assert ed.drop_exact_copies(empty).count() == 0


def test_chunks_cover_the_text_and_follow_content(spark):
    rnd = random.Random(2)
    text = "".join(rnd.choice("etaoin shrdlu ETAOIN,.") for _ in range(60_000)) + "😀\n" * 3000
    row = spark.createDataFrame([(text, "lead " * 100 + text)], "a string, b string").select(
        ed.chunks(F.col("a")).alias("a"), ed.chunks(F.col("b")).alias("b")
    ).first()
    assert "".join(row.a) == text and max(map(len, row.a)) <= ed.MAX_CHUNK
    assert len(set(row.a) & set(row.b)) > len(row.a) // 2


def test_ambiguous_ids_fall_back_to_digests(spark):
    rows = spark.createDataFrame(
        [(0, 1, "s1", [(7, b"a"), (8, b"b")]), (1, 2, "s2", [(7, b"c"), (8, b"b")]), (2, 3, "s1", [(7, b"a"), (8, b"b")])],
        "rid long, doc_id long, text_sha256 string, chunks array<struct<short:long,digest:binary>>",
    )
    ambiguous = ed.ambiguous_ids(rows)
    assert [r.short for r in ambiguous.collect()] == [7]
    keyed = ed.with_recipe_keys(rows, ambiguous).groupBy("ids", "digests").count()
    assert sorted(r["count"] for r in keyed.collect()) == [1, 2]


def test_stage_with_repeated_rows_and_awkward_names(spark):
    rows = [(1, "abc", 1, 2), (1, "Abc", 3, 4), (1, "abc", 5, 6), (2, "ab", 7, 8), (None, "AB", 9, 10), (None, None, 11, 12), (None, "", 13, 14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` long, sha long")
    kept = ed.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    assert got == [("1", "abc"), ("2", "ab"), ("None", "")]


def test_chunks_follow_content_in_any_script(spark):
    rnd = random.Random(4)
    text = "".join(rnd.choice("абвгдежзиклмнопрстуф ") for _ in range(40_000))
    row = spark.createDataFrame([(text, "x" + text)], "a string, b string").select(
        ed.chunks(ed.as_bytes(F.col("a"))).alias("a"), ed.chunks(ed.as_bytes(F.col("b"))).alias("b")
    ).first()
    assert len(set(row.a) & set(row.b)) > len(row.a) // 2
