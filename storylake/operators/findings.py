"""Rule scans: rules by lines give findings, findings roll up to severities and a status."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low")
#: Code points of a line that a finding quotes.
CONTEXT = 100


def rules(spark, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    """A rules frame ``rule_no, pattern, severity, category, title``; users add rows of their own."""
    listed = [F.struct(F.lit(i).alias("rule_no"), *(F.lit(v).alias(n) for v, n in zip(row, ("pattern", "severity", "category", "title")))) for i, row in enumerate(rows)]
    return spark.range(1).select(F.explode(F.array(*listed)).alias("r")).select("r.*")


def required(pattern: str) -> tuple[str, bool]:
    """The longest text that every match of ``pattern`` holds, and whether in any case; empty where none is sure.

    Only plain characters outside groups, classes and repetitions count, so what
    is told is always necessary, if seldom all.
    """
    flags = re.match(r"\(\?([a-z]+)\)", pattern)
    rest, runs, now, at = pattern[flags.end() if flags else 0 :], [], "", 0
    if flags and "x" in flags[1]:
        return "", False
    while at < len(rest):
        c, size, plain = rest[at], 1, ""
        if c == "\\":
            size, plain = 2, "" if rest[at + 1 : at + 2].isalnum() else rest[at + 1 : at + 2]
        elif c in "([":
            size = _closing(rest, at) - at
        elif c == "|":
            return "", False
        elif c not in ".^$?*+{":
            plain = c
        after = rest[at + size : at + size + 1]
        if plain and after not in ("?", "*", "{"):
            now += plain
        if not plain or after in ("?", "*", "{", "+"):
            runs, now = [*runs, now], ""
        at += size
        if rest[at : at + 1] == "{":
            at = rest.index("}", at) + 1
    best = max([*runs, now], key=len)
    return best, bool(flags and "i" in flags[1])


def _closing(pattern: str, at: int) -> int:
    """The place after the bracket that closes the one at ``at``."""
    depth, inside = 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside, at = True, at + (pattern[at + 1 : at + 2] == "^") + (pattern[at + 1 : at + 3].lstrip("^")[:1] == "]")
        else:
            depth += (c == "(") - (c == ")")
        at += 1
        if not depth and not inside:
            break
    return at


def scan(lines: DataFrame, rule_rows: DataFrame, outside_fences: bool = False) -> DataFrame:
    """One finding for every match of every rule in a line: ``doc, line_no, severity, category, title, context``.

    The rules are a few literals, each with a pattern that is compiled once, so
    lines are read once and nothing is shuffled. A pattern is tried only on lines
    that hold the text which all its matches hold, see :func:`required`.
    """
    known = sorted(rule_rows.collect(), key=lambda r: r["rule_no"])
    none = F.array().cast("array<string>")

    def matches(r) -> Column:
        found = F.regexp_extract_all("line", F.lit(r["pattern"]), F.lit(0))
        text, any_case = required(r["pattern"])
        if not text:
            return found.alias("matches")
        near = F.contains("lowered", F.lit(text.lower())) if any_case else F.contains("line", F.lit(text))
        return F.when(near, found).otherwise(none).alias("matches")

    listed = F.array(*(F.struct(*(F.lit(r[n]).alias(n) for n in ("severity", "category", "title")), matches(r)) for r in known))
    lines = lines.where("NOT in_fence AND NOT is_fence") if outside_fences else lines
    if any(required(r["pattern"])[1] for r in known):
        lines = lines.withColumn("lowered", F.lower("line"))
    hits = lines.select("doc", "line_no", F.left(F.col("line"), F.lit(CONTEXT)).alias("context"), F.explode(F.filter(listed, lambda r: F.size(r["matches"]) > 0)).alias("r"))
    return hits.select("doc", "line_no", "r.severity", "r.category", "r.title", "context", F.explode("r.matches").alias("matched"))


def severity_counts() -> list[Column]:
    """Aggregates of the four known severities; others aren't counted, and zeros stay."""
    return [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES]


def roll_up(findings: DataFrame, key: str) -> DataFrame:
    """Findings by key with the four severities."""
    return findings.groupBy(key).agg(F.count("*").alias("total"), *severity_counts())


def open_roll_up(findings: DataFrame) -> DataFrame:
    """Findings by severity: the four known ones, at zero if need be, and any other that occurs."""
    spark = findings.sparkSession
    seeded = spark.range(1).select(F.explode(F.array(*map(F.lit, SEVERITIES))).alias("severity"), F.lit(0).cast("long").alias("n"))
    return seeded.unionByName(findings.groupBy("severity").agg(F.count("*").alias("n"))).groupBy("severity").agg(F.sum("n").alias("n"))


def by_category(findings: DataFrame, key: str, categories: list[str]) -> DataFrame:
    """Counts of a closed set of categories as columns, ``-`` written as ``_``."""
    return findings.groupBy(key).agg(*(F.count_if(F.col("category") == c).alias(c.replace("-", "_")) for c in categories))


def status(kind: str) -> Column:
    """Status from the columns ``total, n_critical, n_high, n_medium``, as each kind of scanner derives it."""
    critical, high, medium = F.col("n_critical") > 0, F.col("n_high") > 0, F.col("n_medium") > 0
    if kind == "path":
        return F.when(F.col("total") == 0, "pass").otherwise("fail")
    if kind == "integrity":
        return F.when(critical, "fail").when(high, "warning").otherwise("pass")
    if kind == "dependencies":
        return F.when(critical, "fail").when(high | medium, "warning").otherwise("pass")
    if kind == "validator":
        return F.when(critical | high, "fail").otherwise("pass")
    raise ValueError(f"no such kind of scanner: {kind}")


def open_categories(findings: DataFrame, key: str) -> DataFrame:
    """``key, counts``: a map of every category that occurs to its number."""
    counted = findings.groupBy(key, "category").agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("counts"))
