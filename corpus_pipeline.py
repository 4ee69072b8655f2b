"""A training corpus from raw documents, in five stages.

``STAGES`` lists them; each takes ``(spark, docs, sf_dir)`` and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``documents``. Every stage works on all
that its predecessor kept; see the operators for nulls, ties, repeated rows and
empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storylake.llm.common import written
from storylake.llm.decontamination import drop_contaminated
from storylake.llm.exact_dedup import drop_exact_copies
from storylake.llm.language_id import keep_identified
from storylake.llm.near_dedup import drop_near_copies
from storylake.llm.registry import PIECES
from storylake.llm.unigram import encode, load_model


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with more than a narrow margin."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of least id."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids; ``round_trip`` tells whether these decode to the text."""
    coded = encode(docs, load_model(PIECES), {f"c{i}": F.col(f"`{c}`") for i, c in enumerate(docs.columns)})
    return coded.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)), "ids", "round_trip")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Compression, sketches and Viterbi search can't be stated in SQL; the tests hold a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; the written tables between them cut the lineage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
