"""Reports: one shape for older and newer ones, prompts and figures from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = "struct<title:string,issue:string,message:string,file:string,line:int,severity:string>"
REPORT = f"name string, rank int, status string, finding_count int, findings array<{FINDING}>"


def normalised(reports: DataFrame) -> DataFrame:
    """``name, rank, finding_count, status`` of reports as ``ord`` and the columns of ``REPORT``.

    A given count wins over the list's size, a given rank over the position.
    """
    count = F.coalesce("finding_count", F.when(F.col("findings").isNull(), 0).otherwise(F.size("findings")))
    return reports.select("name", F.coalesce("rank", F.col("ord") + 1).alias("rank"), count.alias("finding_count"), F.coalesce("status", F.when(count == 0, "good").otherwise("needs-attention")).alias("status"))


def prompt(found: Column) -> Column:
    """Numbered text of nested findings; the place is named only if file and line are there."""
    title = lambda f: F.coalesce(f["title"], f["issue"], f["message"], F.lit(""))
    place = lambda f: F.when(f["file"].isNotNull() & f["line"].isNotNull(), F.concat(F.lit(" ("), f["file"], F.lit(":"), f["line"].cast("string"), F.lit(")"))).otherwise("")
    return F.array_join(F.transform(found, lambda f, i: F.concat((i + 1).cast("string"), F.lit(". "), title(f), place(f))), "\n")


def bar_width(rebuilt: Column, original: Column) -> Column:
    """Percent of the original to one decimal, 0 for nothing."""
    return F.when(original == 0, F.lit(0.0)).otherwise(F.round(rebuilt / original * 100, 1))


def ratio(source: Column, result: Column) -> Column:
    """``X:1`` to one decimal."""
    return F.format_string("%.1f:1", source / result)


def stale(updated: Column, generated: Column, now: Column, days: int = 7) -> Column:
    """Whether the last update (or else the generation) is older than ``days``."""
    return F.coalesce(updated, generated) < now - F.expr(f"INTERVAL {days} DAYS")


def write_reports(findings: DataFrame, key: str, path: str) -> None:
    """One JSON report a key: its findings ``line_no, severity, category`` in order, and how many there are."""
    listed = findings.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "severity", "category"))).alias("findings"))
    listed.select(F.to_json(F.struct(F.col(key).cast("string").alias("name"), F.size("findings").alias("finding_count"), "findings")).alias("value")).write.mode("overwrite").text(path)


def read_reports(spark, path: str) -> DataFrame:
    """``name, finding_count, findings`` of the reports; a missing folder is an error."""
    schema = "name string, finding_count int, findings array<struct<line_no:int,severity:string,category:string>>"
    return spark.read.text(path).select(F.from_json("value", schema).alias("r")).select("r.*")


def stamps(at: Column) -> dict[str, Column]:
    """A time as ISO text of UTC, and its date part."""
    shown = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return {"stamp": F.concat(shown, F.lit("+00:00")), "day": F.split(shown, "T")[0]}


def listing(files: DataFrame, key: str, name: str, most: int = 120) -> DataFrame:
    """``key, n, names``: the distinct names of every key in order, each cut at ``most`` code points for display."""
    return files.groupBy(key).agg(F.count_distinct(name).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_set(name)), lambda x: F.left(x, F.lit(most))), ",").alias("names"))
