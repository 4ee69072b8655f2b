"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storylake.sources.shared import settled as written

__all__ = ["crc_bucket", "lower_ascii", "numbered_columns", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def numbered_columns(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns called ``c0, c1, ...`` in place, and the new names of ``names``.

    Stages work on it, so that no helper column can clash with a column of the
    caller and no name needs quoting; ``toDF(*docs.columns)`` names them back.
    """
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), [f"c{docs.columns.index(n)}" for n in names]


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character left alone; null becomes empty.

    Texts of one byte a character take Spark's own ``lower``, which then does
    the same and is several times faster than ``translate``.
    """
    filled = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(filled) == F.char_length(filled), F.lower(filled)).otherwise(
        F.translate(filled, UPPER, UPPER.lower())
    )


def crc_bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``: the fixed split into held-out and other rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts
