"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from sample texts.
A text is encoded with every dictionary; the language whose dictionary gives
the smallest encoding wins, because its text repeats what the dictionary holds.
A text's opening bytes are encoded with several dictionaries a language, so that
sizes differ by less than a whole byte even where there is nothing more; the
rest is encoded block by block, each afresh and with one of the dictionaries in
turn, so that evidence grows with length. Narrow margins are rejected.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storylake.llm.common import crc_bucket, numbered_columns

UNKNOWN = "und"
#: The sample: so many texts a language at most, drawn by a hash of id and text; of a longer text a piece of so many characters.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 2_000
DICTIONARY_BYTES, DICTIONARIES = 24_000, 6
#: Bytes of every text's opening, which meets all dictionaries of a language, and of the blocks that cover all the rest.
OPENING_BYTES, BLOCK_BYTES = 384, 8_192
#: Small tables and matches from four bytes on: short texts need the short matches, and small tables are quick to set up.
SETTINGS = {"window_log": 17, "hash_log": 14, "chain_log": 14, "search_log": 2, "min_match": 4, "strategy": zstandard.STRATEGY_LAZY}
FRAME = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
#: Least lead of the winner, as a part of the second-best size.
MIN_MARGIN = 0.001
#: Letters, and numbers that are no digits.
LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries and shares by language; bounded by the constants above, whatever the input."""

    dictionaries: dict[str, tuple[bytes, ...]]
    shares: dict[str, float]

    @property
    def languages(self) -> list[str]:
        return sorted(self.dictionaries)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from the rows of ``docs`` that have a text and a language.

    Every language is learned. What reaches the driver is bounded: at most
    ``SAMPLE_DOCS`` different texts a language, in the order of a hash, and of a
    text longer than ``SAMPLE_CHARS`` a piece of that length from a place that
    the hash names. The same table always gives the same model.
    """
    plain, (doc, text, lang) = numbered_columns(docs, id_col, text_col, lang_col)
    labelled = plain.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.col(doc).alias("id"))
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return LanguageModel({}, {})
    share = F.create_map(*(F.lit(v) for row in counts for v in (row["lang"], min(1.0, 2 * SAMPLE_DOCS / row["count"]))))
    place = F.pmod(F.xxhash64(F.col("id").cast("string"), F.xxhash64("text")), F.lit(1_000_000))
    near = labelled.withColumn("place", place).where(F.col("place") < share[F.col("lang")] * 1_000_000)
    spare = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0))
    pieces = near.select("lang", "place", F.col("text").substr(F.pmod(F.col("place"), spare + 1).cast("int") + 1, F.lit(SAMPLE_CHARS)).alias("text")).distinct()
    first = Window.partitionBy("lang").orderBy("place", "text")
    drawn = pieces.withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE_DOCS).drop("n").collect()
    by_lang: dict[str, list[bytes]] = {}
    for row in sorted(drawn, key=lambda r: (r["lang"], r["place"], r["text"])):
        by_lang.setdefault(row["lang"], []).append(_encoded(row["text"]))
    model = {}
    for lang, texts in by_lang.items():
        whole = b"\n".join(dict.fromkeys(texts))
        each = min(DICTIONARY_BYTES, max(64, len(whole) // DICTIONARIES))
        parts = tuple(whole[i * each : (i + 1) * each] for i in range(DICTIONARIES) if len(whole[i * each : (i + 1) * each]) >= 8)
        if parts:
            model[lang] = parts
    seen = {row["lang"]: row["count"] for row in counts if row["lang"] in model}
    return LanguageModel(model, {lang: n / sum(seen.values()) for lang, n in seen.items()})


def _encoded(text: str) -> bytes:
    return f" {text.lower()} ".encode("utf-8", "replace")


def _encoders(model: LanguageModel) -> list[tuple[float, list[zstandard.ZstdCompressor]]]:
    """For each language the bytes that name it, and its encoders."""
    parameters, made = zstandard.ZstdCompressionParameters(**SETTINGS, **FRAME), []
    for lang in model.languages:
        own = []
        for content in model.dictionaries[lang]:
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=parameters)
            own.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters))
        made.append((-math.log2(model.shares[lang]) / 8, own))
    return made


def classify(text: str | None, languages: list[str], encoders: list) -> tuple[str, float, float]:
    """(language, score, margin) of one text; ``und`` without letters or languages.

    The score is the winner's share if each language weighs 2 to the minus of
    its size in bytes; the margin is its lead over the second size.
    """
    if not text or not languages or not any(m[0].isalpha() for m in LETTER.finditer(text)):
        return UNKNOWN, 0.0, 0.0
    data = _encoded(text)
    opening, blocks = data[:OPENING_BYTES], [data[at : at + BLOCK_BYTES] for at in range(OPENING_BYTES, len(data), BLOCK_BYTES)]
    sizes = [
        named + sum(len(e.compress(opening)) for e in own) / len(own) + sum(len(own[i % len(own)].compress(b)) for i, b in enumerate(blocks))
        for named, own in encoders
    ]
    best = min(range(len(sizes)), key=lambda i: sizes[i])
    total = sum(2.0 ** max(-1000.0, sizes[best] - s) for s in sizes)
    second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
    return languages[best], 1.0 / total, (second - sizes[best]) / second


def predict(docs: DataFrame, model: LanguageModel, carried: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The ``carried`` columns with ``lang_pred, score, margin, rejected`` for every whole text.

    ``rejected`` marks texts without a letter and texts whose margin is under
    ``MIN_MARGIN``; the latter still name their best language.
    """
    kept = docs.select(*(c.alias(n) for n, c in carried.items()), F.col(text_col).alias("__text"))
    names = list(carried)

    def run(batches):
        encoders, languages = _encoders(model), model.languages
        for batch in batches:
            found = [classify(t.as_py(), languages, encoders) for t in batch.column(len(names))]
            langs, scores, margins = zip(*found) if found else ((), (), ())
            columns = [
                *batch.columns[: len(names)],
                pa.array(langs, pa.string()),
                pa.array(scores, pa.float64()),
                pa.array(margins, pa.float64()),
                pa.array([g == UNKNOWN or m < MIN_MARGIN for g, m in zip(langs, margins)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score", "margin", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double, margin double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(crc_bucket(doc_id, 4) == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out and predict all.

    Returns one row per input row: ``doc_id, held_out, lang_pred, score, margin,
    rejected``. A null or letterless text is ``und`` with score 0; so is every
    text where no row has a language to learn. Rows with a null id are not held
    out. An empty table gives an empty result; other columns are ignored.
    """
    model = fit(docs.where(~held_out(F.col(id_col))), id_col, text_col, lang_col)
    carried = {"doc_id": F.col(id_col), "held_out": held_out(F.col(id_col))}
    return predict(docs, model, carried, text_col)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language is rejected; every column as it was.

    Null and letterless texts go. Where no row has a language to learn, nothing
    can be identified and every row goes. Repeated rows stay or go together; an
    empty table stays empty; columns may have any name.
    """
    plain, (doc, text, lang) = numbered_columns(docs, id_col, text_col, lang_col)
    model = fit(plain.where(~held_out(F.col(doc))), doc, text, lang)
    if not model.languages:
        return docs.where(F.lit(False))
    found = predict(plain, model, {c: F.col(c) for c in plain.columns}, text).where("NOT rejected")
    return found.select(*plain.columns).toDF(*docs.columns)
