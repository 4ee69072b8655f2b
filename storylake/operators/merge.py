"""Replace-by-key merges, overlays of settings, and set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_by_key(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """``target`` without the rows whose key occurs in ``source``, then all of ``source``; keys are compared trimmed."""
    codes = source.select(F.trim(F.col(key)).alias("__key")).where("__key <> ''").distinct()
    kept = target.join(codes, F.trim(F.col(key)) == F.col("__key"), "left_anti")
    return kept.unionByName(source)


def merge_counts(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """One row: rows removed, added and in total after :func:`replace_by_key`."""
    merged = replace_by_key(target, source, key).agg(F.count("*").alias("total"))
    sizes = target.agg(F.count("*").alias("before")).join(source.agg(F.count("*").alias("added"))).join(merged)
    return sizes.select((F.col("before") + F.col("added") - F.col("total")).alias("removed"), "added", "total")


def overlay(*layers: DataFrame) -> DataFrame:
    """Settings ``scope, key, value``: later layers win; null values count as absent."""
    ranked = None
    for rank, layer in enumerate(layers):
        one = layer.where("value IS NOT NULL").select("scope", "key", "value", F.lit(rank).alias("rank"))
        ranked = one if ranked is None else ranked.unionByName(one)
    return ranked.groupBy("scope", "key").agg(F.max_by("value", "rank").alias("value"))


def with_default(value: Column, default: Column) -> Column:
    """``value`` unless null or empty, else ``default``."""
    return F.coalesce(F.nullif(value, F.lit("")), default)


def parsed_spec(spec: Column) -> Column:
    """``a:x,b`` as a map of names to defaults (null without one); names are split at the first colon."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    name = lambda p: F.trim(F.regexp_extract(p, r"^([^:]*)", 1))
    default = lambda p: F.when(F.contains(p, F.lit(":")), F.regexp_extract(p, r"^[^:]*:(.*)$", 1))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(name(p), default(p))))


def missing_and_orphans(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: ``missing`` are wanted but not present, ``orphan`` the other way."""
    left, right = wanted.select(key).distinct(), present.select(key).distinct()
    missing = left.join(right, key, "left_anti").withColumn("finding", F.lit("missing"))
    return missing.unionByName(right.join(left, key, "left_anti").withColumn("finding", F.lit("orphan")))


def duplicate_keys(rows: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """Keys of several rows with the names in row order."""
    listed = rows.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("v")))), lambda s: s["v"]), ", ").alias("names"))
    return listed.where("n > 1")


def broken_references(rows: DataFrame, key: str, refs: str, valid: DataFrame) -> DataFrame:
    """Comma-separated references of ``rows`` that ``valid`` (one column, ``ref``) lacks."""
    parts = F.filter(F.transform(F.split(refs, ","), lambda r: F.trim(r)), lambda r: r != "")
    return rows.select(key, F.explode(parts).alias("ref")).join(valid.distinct(), "ref", "left_anti").select(key, "ref")
