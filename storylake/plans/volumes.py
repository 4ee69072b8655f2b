"""Ordered batching of chapters into volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storylake.operators.volumes import batched, volume_ranges
from storylake.sources.tables import table


def volume_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of a conversation cut into volumes of three, with their file names."""
    return volume_ranges(batched(table(spark, folder, "conversations"), ["conv_id"], "turn", size=3), ["conv_id"], "turn")


QUERIES = {"volume_batches": volume_batches}
ORACLES = {
    "volume_batches": """
        WITH b AS (
          SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 + 1 AS volume
          FROM conversations)
        SELECT conv_id, CAST(volume AS BIGINT) AS volume, min(turn) + 1 AS range_start, max(turn) + 1 AS range_end,
               count(*) AS n_chapters,
               printf('vol-%03d-ch%03d-%03d.json', CAST(volume AS BIGINT), min(turn) + 1, max(turn) + 1) AS file_name
        FROM b GROUP BY conv_id, volume"""
}
