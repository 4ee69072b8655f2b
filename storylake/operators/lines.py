"""Line facts of text documents: fences, tables, walls of text, sections, metrics.

Facts of single lines come from ``doc_lines``, one row ``doc, line_no, line`` a
line; facts about runs of lines come from ``line_arrays``, in one pass over a
text's array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storylake.functions.text import WHITE, bound, strip_white

# What ends a wall of text, and how long one must be.
WALL_BREAK = r"^\s*$|^\s*#{1,6}\s|^\s*[-*]\s|^\s*\d+\.\s|^\s*```|^\s*\|"
WALL_LINES = 15


def doc_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line with its number from 1; an empty text has one empty line."""
    split = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("at", "line"))
    return split.select("doc", (F.col("at") + 1).alias("line_no"), "line")


def line_arrays(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, lines``: the lines of a text as one array, from which facts about neighbouring lines are told without a shuffle."""
    return docs.select(F.col(id_col).alias("doc"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("lines"))


def _places(lines: Column, test) -> Column:
    """Places, from 0, of the lines that pass."""
    return F.filter(F.transform(lines, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())


def _between(lines: Column, marks: Column, made) -> Column:
    """``made(k, start, end)`` for the stretches before, between and after the marks; ``end`` is the next mark's place."""
    start = lambda k: F.coalesce(F.get(marks, k - 1) + 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.size(marks)), lambda k: made(k, start(k), F.coalesce(F.get(marks, k), F.size(lines))))


def _is_fence(indented: bool):
    return lambda x: F.startswith(strip_white(x) if indented else x, F.lit("```"))


def with_fences(arrays: DataFrame, indented: bool = True) -> DataFrame:
    """``doc, line_no, line, is_fence, in_fence`` (an odd number of fence lines before it) of :func:`line_arrays`.

    ``indented`` fences count as such, or else only those at the start of a line.
    """
    stretches = lambda marks: _between(F.col("lines"), marks, lambda k, a, b: F.struct((k % 2 == 1).alias("in_fence"), a.alias("start"), (b < F.size("lines")).alias("fenced"), F.slice("lines", a + 1, b - a + 1).alias("lines")))
    cut = arrays.select("doc", F.explode(bound(_places(F.col("lines"), _is_fence(indented)), stretches)).alias("s"))
    rows = cut.select("doc", "s.in_fence", "s.start", "s.fenced", F.size("s.lines").alias("n"), F.posexplode("s.lines").alias("at", "line"))
    return rows.select("doc", (F.col("start") + F.col("at") + 1).alias("line_no"), "line", (F.col("fenced") & (F.col("at") == F.col("n") - 1)).alias("is_fence"), "in_fence")


def fence_blocks(arrays: DataFrame) -> DataFrame:
    """Fenced blocks opened and lines inside them, a document; an open block reaches to the end."""
    inside = lambda marks: F.aggregate(_between(F.col("lines"), marks, lambda k, a, b: F.when(k % 2 == 1, b - a).otherwise(0)), F.lit(0).cast("long"), lambda n, x: n + x)
    counts = bound(_places(F.col("lines"), _is_fence(True)), lambda marks: F.struct(F.ceil(F.size(marks) / 2).alias("n_blocks"), inside(marks).alias("n_lines")))
    return arrays.select("doc", counts.alias("c")).select("doc", "c.n_blocks", "c.n_lines")


def table_runs(arrays: DataFrame) -> DataFrame:
    """Runs of consecutive table lines and their lines, a document."""
    rows = _places(F.col("lines"), lambda x: F.rlike(x, F.lit(r"^\s*\|")))
    counts = bound(rows, lambda at: F.struct(F.size(F.filter(at, lambda x, i: (i == 0) | (F.get(at, i - 1) < x - 1))).cast("long").alias("n_tables"), F.size(at).cast("long").alias("n_lines")))
    return arrays.select("doc", counts.alias("c")).select("doc", "c.n_tables", "c.n_lines")


def walls(arrays: DataFrame, least: int = WALL_LINES, breaks: str = WALL_BREAK) -> DataFrame:
    """Runs of at least ``least`` lines without a break: ``doc, line_no`` of the first, ``n_lines``."""
    runs = lambda marks: F.filter(_between(F.col("lines"), marks, lambda k, a, b: F.struct((a + 1).alias("line_no"), (b - a).cast("long").alias("n_lines"))), lambda r: r["n_lines"] >= least)
    found = bound(_places(F.col("lines"), lambda x: F.rlike(x, F.lit(breaks))), runs)
    return arrays.select("doc", F.explode(found).alias("r")).select("doc", "r.line_no", "r.n_lines")


def sections(lines: DataFrame) -> DataFrame:
    """Headings of level 2 and 3: ``doc, line_no, level, title``."""
    heading = lines.withColumn("marks", F.regexp_extract("line", r"^(#{2,3})\s+(.+)$", 1)).where("marks <> ''")
    return heading.select("doc", "line_no", F.length("marks").alias("level"), strip_white(F.regexp_extract("line", r"^(#{2,3})\s+(.+)$", 2)).alias("title"))


def section_extent(arrays: DataFrame, title: str) -> DataFrame:
    """Lines between the first ``## title`` and the next heading of that level, a document that has it."""

    def extent(marks):
        first = F.get(F.filter(marks, lambda i: F.startswith(F.get(F.col("lines"), i), F.lit(f"## {title}"))), F.lit(0))
        return F.coalesce(F.array_min(F.filter(marks, lambda i: i > first)), F.size("lines")) - first - 1

    found = arrays.select("doc", bound(_places(F.col("lines"), lambda x: F.rlike(x, F.lit(r"^##\s"))), extent).cast("long").alias("n_lines"))
    return found.where("n_lines IS NOT NULL")


def metrics(text: Column) -> dict[str, Column]:
    """Lines, words, characters, ``## `` sections and token estimate of a text.

    Lines end at any line separator and a final one adds no line.
    """
    parts = F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085\u2028\u2029]")
    lines = F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    words = F.size(F.filter(F.split(text, f"[{WHITE}\\x1C-\\x1F]+"), lambda w: w != ""))
    return {
        "lines": lines,
        "words": words,
        "chars": F.length(text),
        "sections": F.size(F.filter(parts, lambda p: F.startswith(p, F.lit("## ")))),
        "estimated_tokens": F.floor(words * F.lit(1.3)).cast("long"),
    }


def reduction(old: Column, new: Column) -> Column:
    """``N%`` by which ``new`` is less than ``old``, half to even; ``N/A`` for nothing."""
    return F.when(old == 0, F.lit("N/A")).otherwise(F.concat(F.bround((1 - new / old) * 100).cast("int").cast("string"), F.lit("%")))


def number_gaps(numbers: DataFrame, key: str, number: str) -> DataFrame:
    """Numbers missing from the run of consecutive ones that starts at a key's least and is as long as its set."""
    seen = numbers.groupBy(key).agg(F.collect_set(number).alias("seen"))
    low = F.array_min("seen")
    missing = F.array_except(F.sequence(low, low + F.size("seen") - 1), F.col("seen"))
    return seen.select(key, F.array_sort(missing).alias("missing")).where("size(missing) > 0")
