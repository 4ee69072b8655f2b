"""Language identification: held-out accuracy, rejection, edge cases."""

import random

from pyspark.sql import functions as F

from storylake.llm import language_id as li

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS)
    found = li.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def test_edge_cases(spark):
    rows = [(i, t, g, g) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    rows += [(100, None, "en", None), (101, "", "en", ""), (102, "123 !!", None, "x"), (None, "the dog", None, None), (103, "der hund " * 20_000, None, "y"), (1, "dup", "en", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    found = li.identify(docs).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert {by_id[i].lang_pred for i in (100, 101, 102)} == {"und"} and by_id[100].score == 0 and by_id[100].rejected
    assert by_id[103].lang_pred == "de" and by_id[None].lang_pred == "en" and not by_id[None].held_out
    assert all(0 <= r.score <= 1 for r in found)
    kept = li.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3


def test_evidence_grows_with_length():
    rnd = random.Random(3)
    common = ["".join(rnd.choices("aeinrst", k=4)) for _ in range(300)]
    words = {g: common + ["".join(rnd.choices(letters, k=rnd.randint(3, 8))) for _ in range(1_500)] for g, letters in (("x", "abdefinorst"), ("y", "aceghilmnou"))}
    text = lambda g, size: " ".join(rnd.choices(words[g], k=size // 6))
    model = li.LanguageModel({g: (text(g, 24_000).encode(),) for g in words}, {g: 0.5 for g in words})
    encoders = li._encoders(model)
    language, _, margin = li.classify(text("x", 4_000_000), model.languages, encoders)
    assert language == "x" and margin > 10 * li.MIN_MARGIN
    assert li.classify(text("y", 20_000) + " " + text("x", 300_000), model.languages, encoders)[0] == "x"


def test_empty_and_unlabelled_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert li.identify(empty).count() == 0 and li.keep_identified(empty).count() == 0
    bare = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert li.identify(bare).first().lang_pred == "und" and li.keep_identified(bare).count() == 0


def test_sizes_and_choice_against_plain_compression(spark):
    """Every text of a table, by a plain restatement of the rule: one compressor made anew for each call."""
    import math

    import zstandard

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = li.fit(docs.where(~li.held_out(F.col("doc_id"))))
    got = {r.doc_id: r for r in li.identify(docs).collect()}

    def size(lang, data):
        def one(content, part):
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(compression_params=zstandard.ZstdCompressionParameters(**li.SETTINGS, **li.FRAME))
            return len(zstandard.ZstdCompressor(dict_data=made, compression_params=zstandard.ZstdCompressionParameters(**li.SETTINGS, **li.FRAME)).compress(part))

        own = model.dictionaries[lang]
        rest = data[li.OPENING_BYTES :]
        total = sum(one(d, data[: li.OPENING_BYTES]) for d in own) / len(own) - math.log2(model.shares[lang]) / 8
        for i in range(math.ceil(len(rest) / li.BLOCK_BYTES)):
            total += one(own[i % len(own)], rest[i * li.BLOCK_BYTES : (i + 1) * li.BLOCK_BYTES])
        return total

    for row in docs.collect():
        if not row.text or not li.LETTER.search(row.text):
            assert got[row.doc_id].lang_pred == li.UNKNOWN
            continue
        sizes = {g: size(g, f" {row.text.lower()} ".encode()) for g in model.languages}
        best, second = sorted(sizes, key=lambda g: (sizes[g], g))[:2]
        assert got[row.doc_id].lang_pred == best
        assert math.isclose(got[row.doc_id].margin, (sizes[second] - sizes[best]) / sizes[second])


def test_languages_of_long_texts_and_repeated_ids_are_learned(spark):
    rows = [(1, f"der hund und die katze {i} laufen " * 2_000, "de") for i in range(30)] + [(1, f"the cat and the dog {i} ran", "en") for i in range(30)]
    rows += [(i, "a b c", f"l{i:03}") for i in range(2, 300)]
    model = li.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {"de", "en"} <= set(model.languages) and max(sum(map(len, d)) for d in model.dictionaries.values()) <= li.DICTIONARIES * li.DICTIONARY_BYTES


def test_stage_with_awkward_names(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", 1, 2), (3, "123", "en", 1, 2)], "doc_id long, text string, lang string, `a.b` long, __text long")
    kept = li.keep_identified(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def test_numbers_that_are_no_digits_are_no_letters():
    model = li.LanguageModel({"x": (b"some words of x " * 9,)}, {"x": 1.0})
    encoders = li._encoders(model)
    for text in ("½", "² ³", "①②", "Ⅷ", "12 !"):
        assert li.classify(text, model.languages, encoders)[0] == "und"
    assert li.classify("½ ª", model.languages, encoders)[0] == "x"
