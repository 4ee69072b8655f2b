"""Text sources of settings and catalogs: front matter, key-value lines, ragged CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storylake.functions.text import bound, strip_white

#: What ``\\s`` takes for white space in patterns.
_SPACE = " \t\n\x0b\f\r"


def front_matter(text: Column) -> Column:
    """The block between two ``---`` lines at the very start, null if there is none."""
    found = F.regexp_extract(text, r"(?s)\A---\s*\n(.*?)\n---\s*\n", 1)
    return F.when(F.rlike(text, F.lit(r"(?s)\A---\s*\n(.*?)\n---\s*\n")), found)


def front_matter_state(text: Column) -> Column:
    """``missing``, ``unclosed`` or ``present``."""
    return F.when(~F.startswith(text, F.lit("---")), "missing").when(front_matter(text).isNull(), "unclosed").otherwise("present")


def unquoted(value: Column) -> Column:
    """``value`` without the double quotes at its ends, then without the single ones."""
    return F.regexp_replace(F.regexp_replace(value, '^"+|"+$', ""), "^'+|'+$", "")


def key_values(block: Column) -> Column:
    """Lines ``key: value`` as a map, split at the first colon, quotes stripped.

    Blank lines, comments, list items and keys without a value (or with one that starts with ``>``, as folded ones do)
    are left out; of repeated keys the last counts.
    """
    lines = F.filter(F.transform(F.split(block, "\n"), strip_white), lambda x: ~F.rlike(x, F.lit("^$|^#|^-")) & F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(strip_white(F.regexp_extract(x, r"^([^:]*):", 1)).alias("key"), unquoted(strip_white(F.regexp_extract(x, r"^[^:]*:(.*)$", 1))).alias("value")))
    kept = F.filter(pairs, lambda p: (p["value"] != "") & ~F.startswith(p["value"], F.lit(">")))
    last = lambda k: F.filter(k, lambda p, i: ~F.exists(F.slice(k, i + 2, F.greatest(F.size(k), F.lit(1))), lambda q: q["key"] == p["key"]))
    return bound(kept, lambda k: F.map_from_entries(last(k)))


def yaml_entries(text: Column) -> Column:
    """``array<struct<path, value>>`` of nested mappings and lists: ``a.b.0.c`` and the scalar that stands there, in the order of the text.

    One fold over the lines with a stack of what they are indented under. A key
    at column c ranks 2c, a list at column c 2c + 1, so that items may stand as
    deep as the key they belong to; a line ends all that ranks as high as itself.
    Quotes around keys and scalars go, comments and document marks are left out,
    keys without a scalar have entries for what stands below them only. Scalars
    in brackets stay text; folded and literal blocks are left out. A file of
    settings is one value of the fold, which copies its entries as it goes;
    for tables of many texts :func:`storylake.sources.nested.yaml_rows` is quicker.
    """
    ends = lambda v, q: F.startswith(v, F.lit(q)) & F.endswith(v, F.lit(q))
    unquoted = lambda v: F.when((ends(v, '"') | ends(v, "'")) & (F.length(v) > 1), F.substring(v, 2, F.length(v) - 2)).otherwise(v)
    first = lambda v, *signs: F.substring(v, 1, 1).isin(*signs)
    kept = lambda x: ~(first(F.ltrim(x, F.lit(_SPACE)), "", "#", "-", ".") & F.rlike(x, F.lit(r"(?s)^\s*(?:#.*)?\z|^---|^\.\.\.")))
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.rtrim(x, F.lit(_SPACE))), kept)

    # Every part is bound before others name it, and a pattern is tried only where a plain test allows it.
    def told(line):
        """Column, dash, column behind it, key and scalar of one line."""
        bare = F.ltrim(line)
        dash = F.when(first(bare, "-"), F.regexp_extract(bare, r"^(-(?: +|\z))", 1)).otherwise("")
        return bound(F.struct((F.length(line) - F.length(bare)).alias("column"), dash.alias("dash"), bare.alias("bare")), keyed)

    def keyed(head):
        rest = F.substring(head["bare"], F.length(head["dash"]) + 1, F.length(head["bare"]))
        key = lambda r: F.when(F.contains(r, F.lit(":")), F.regexp_extract(r, "^(\"[^\"]*\"|'[^']*'|[^\\s:\"'\\[{][^:]*):(?:\\s|\\z)", 1)).otherwise("")
        return bound(rest, lambda r: bound(key(r), lambda k: bound(F.when(k != "", F.substring(r, F.length(k) + 2, F.length(r))).otherwise(r), lambda after: valued(head, k, after))))

    def valued(head, key, after):
        quoted = lambda v: F.when(first(v, '"', "'"), F.regexp_extract(v, "(?s)^(\"[^\"]*\"|'[^']*')\\s*(?:#.*)?\\z", 1)).otherwise("")
        plain = F.trim(F.when(F.contains(after, F.lit("#")), F.regexp_replace(after, r"(?s)(?:^|\s)#.*\z", "")).otherwise(after))
        value = lambda q: F.when(q != "", unquoted(q)).otherwise(plain)
        blocked = lambda q, v: (q == "") & first(v, ">", "|") & F.rlike(v, F.lit(r"^[>|][-+0-9]*\z"))
        return bound(quoted(F.trim(after)), lambda q: bound(value(q), lambda v: F.struct(head["column"].alias("column"), (head["dash"] != "").alias("item"), (head["column"] + F.length(head["dash"])).alias("at"), unquoted(F.trim(key)).alias("key"), v.alias("value"), (q != "").alias("quoted"), blocked(q, v).alias("blocked"))))

    entry, level = "array<struct<path: string, value: string>>", "array<struct<rank: int, name: string>>"
    start = F.struct(F.array().cast(level).alias("under"), F.array().cast(entry).alias("found"), F.lit(-1).alias("block"))

    def step(acc, x):
        rank = 2 * x["column"] + 1
        above = F.filter(acc["under"], lambda u: u["rank"] < F.when(x["item"], rank).otherwise(rank - 1))
        same = F.filter(acc["under"], lambda u: u["rank"] == rank)
        number = lambda s: F.when(F.size(s) > 0, F.get(s, F.lit(0))["name"].cast("int") + 1).otherwise(0).cast("string")
        counted = lambda s: F.concat(above, F.array(F.struct(rank.cast("int").alias("rank"), number(s).alias("name"))))
        base = F.when(x["item"], bound(same, counted)).otherwise(above)
        under = lambda path: F.when(x["key"] != "", F.concat(path, F.array(F.struct((2 * x["at"]).cast("int").alias("rank"), x["key"].alias("name"))))).otherwise(path)

        def moved(under):
            name = F.array_join(F.transform(under, lambda u: u["name"]), ".")
            put = ((x["value"] != "") | x["quoted"]) & ~x["blocked"] & (F.size(under) > 0)
            found = F.when(put, F.concat(acc["found"], F.array(F.struct(name.alias("path"), x["value"].alias("value"))))).otherwise(acc["found"])
            return F.struct(under.alias("under"), found.alias("found"), F.when(x["blocked"], x["column"]).otherwise(-1).alias("block"))

        skipped = (acc["block"] >= 0) & (x["column"] > acc["block"])
        return F.when(skipped, acc).otherwise(bound(bound(base, under), moved))

    return F.aggregate(F.transform(lines, told), start, step, lambda acc: acc["found"])


def content_lines(text: Column) -> Column:
    """Lines that aren't blank, without front matter."""
    body = F.regexp_replace(text, r"(?s)\A---\s*\n(.*?)\n---\s*\n", "")
    return F.size(F.filter(F.split(body, "\n"), lambda x: strip_white(x) != ""))


def read_catalog(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV catalog as strings with ``row_no``; short rows end in nulls, and the text of odd rows is in ``_corrupt_record``."""
    schema = ", ".join(f"`{c}` STRING" for c in [*columns, "_corrupt_record"])
    read = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("enforceSchema", True).csv(path)
    return read.withColumn("row_no", F.monotonically_increasing_id())


def csv_cells(record: Column) -> Column:
    """Cells of one CSV record by position, as many as it has; quotes around a cell go, doubled ones inside stay single.

    Stretches between quotes are outside and inside cells by turns. Commas
    outside become a mark of two characters, which no text holds once its own
    first characters of marks are spelled out.
    """
    stretches = F.split(F.replace(record, F.lit("\x01"), F.lit("\x01a")), '"')
    marked = F.array_join(F.transform(stretches, lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit(","), F.lit("\x01b"))).otherwise(p)), '"')
    bare = lambda c: F.when(F.startswith(c, F.lit('"')), F.replace(F.substring(c, 2, F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.transform(F.split(marked, "\x01b"), lambda c: F.replace(bare(c), F.lit("\x01a"), F.lit("\x01")))


def write_records(rows: DataFrame, path: str, cells: Column) -> None:
    """One CSV record for every row, of as many ``cells`` (an array of strings) as it has; all are quoted, null is empty."""
    quoted = F.transform(cells, lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')))
    rows.select(F.array_join(quoted, ",").alias("value")).write.option("lineSep", "\n").text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, at, cells`` of CSV files whose quoted cells may hold line ends; ``block, at`` order the records of a file.

    Files are read in splits like any text. A line stands inside a cell if the
    quotes before it are odd in number: those of its own split before it, and
    those of the file's earlier splits, of which one number each is added up.
    Lines inside join the last record that began outside, in this split or an
    earlier one; only records of several lines are gathered. Quotes must stand
    around cells or be doubled inside them; a quote that is never closed takes
    the rest of its file. An empty line is a record of one empty cell.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    lines = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value", (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"))
    within = Window.partitionBy("file", "block").orderBy("at")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes")).groupBy("file", "block").agg(F.sum("quotes").alias("quotes"))
    before = splits.select("file", "block", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)).alias("before"))
    placed = lines.withColumn("own", F.coalesce(F.sum("quotes").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(before, ["file", "block"])
    placed = placed.withColumn("inside", (F.col("before") + F.col("own")) % 2 == 1)
    placed = placed.withColumn("start", F.last(F.when(~F.col("inside"), F.struct("block", "at")), True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    whole = placed.where(~F.col("inside") & (F.col("quotes") % 2 == 0)).select("file", "block", "at", "value")
    parts = placed.where(F.col("inside") | (F.col("quotes") % 2 == 1))
    begun = parts.where(~F.col("inside")).groupBy("file", "block").agg(F.max(F.struct("block", "at")).alias("last"))
    opened = begun.unionByName(splits.select("file", "block", F.lit(None).cast(begun.schema["last"].dataType).alias("last"))).groupBy("file", "block").agg(F.max("last").alias("last"))
    carried = opened.select("file", "block", F.last("last", True).over(earlier).alias("carried"))
    several = parts.join(carried, ["file", "block"]).withColumn("start", F.coalesce("start", "carried"))
    several = several.groupBy("file", "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), "\n").alias("value"))
    records = whole.unionByName(several.select("file", "start.block", "start.at", "value"))
    return records.select("file", "block", "at", csv_cells(F.regexp_replace("value", "\r$", "")).alias("cells"))


def write_catalog(rows: DataFrame, path: str) -> None:
    """A catalog as CSV files with a header; quotes are doubled."""
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_settings(settings: DataFrame, path: str, comment: str = "") -> None:
    """Settings ``scope, ord, key, value`` as text files of ``key: value`` lines, a folder a scope, in order, after comment lines."""
    lines = settings.groupBy("scope").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "key", "value"))), lambda s: F.concat(s["key"], F.lit(": "), s["value"])), "\n").alias("value"))
    head = "".join(f"# {line}\n" for line in comment.splitlines())
    lines.select("scope", F.concat(F.lit(head), F.col("value")).alias("value")).write.mode("overwrite").partitionBy("scope").text(path)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """``scope, settings`` of the text files of :func:`write_settings`; comments are left out."""
    read = spark.read.option("wholetext", True).option("basePath", path).text(f"{path}/scope=*")
    return read.select(F.col("scope").cast("string").alias("scope"), key_values(F.col("value")).alias("settings"))
