"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

1. A text's bytes are cut where their own content says so (``CHUNK_PATTERN``),
   in any script, so equal stretches give equal chunks wherever they stand.
2. A chunk is known by a short id (64-bit hash). The dictionary of all chunks
   verifies ids against the 256-bit digest of the chunk: an id that stands for
   two digests is ambiguous.
3. A text's recipe is its ordered list of verified ids; texts that hold an
   ambiguous id list digests instead. Equal recipes are equal texts.

Texts are read once. What moves afterwards is a few dozen bytes a chunk, never
the text, so long documents cost no more than their chunk count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storylake.llm.common import lower_ascii, numbered_columns, written
from storylake.llm.decontamination import if_small

MIN_CHUNK, MAX_CHUNK = 256, 4096


def _residue_class(residue: int, modulus: int) -> str:
    """A regex class of the characters below U+0100 whose code has the given residue."""
    return "[" + "".join(f"\\x{c:02x}" for c in range(32, 256) if c % modulus == residue) + "]"


#: A chunk ends, after its least length, at three characters whose codes have
#: given residues, at the greatest length, or at the end of the text. Every
#: character of a text belongs to exactly one chunk.
CHUNK_PATTERN = (
    f"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 3}}}?{_residue_class(4, 8)}{_residue_class(0, 8)}{_residue_class(1, 8)}"
    f"|.{{1,{MAX_CHUNK}}}"
)


def chunks(text: Column) -> Column:
    """The content-defined chunks of a text, in order; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK_PATTERN), F.lit(0))


def as_bytes(text: Column) -> Column:
    """A string with one character (U+0000 to U+00FF) for each UTF-8 byte of ``text``."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One written row per input row: ``rid, doc_id, text_sha256, chunks``.

    ``rid`` numbers the rows, so that repeated rows stay apart.
    """
    text = lower_ascii(F.col(text_col))
    listed = docs.select(F.col(id_col).alias("doc_id"), text.alias("norm")).select(
        "doc_id",
        F.sha2("norm", 256).alias("text_sha256"),
        F.transform(
            chunks(as_bytes(F.col("norm"))),
            lambda c: F.struct(F.xxhash64(c).alias("short"), F.unhex(F.sha2(c, 256)).alias("digest")),
        ).alias("chunks"),
    )
    return written(listed.withColumn("rid", F.monotonically_increasing_id()), "recipes")


def ambiguous_ids(recipe_rows: DataFrame) -> DataFrame:
    """``short`` ids that more than one chunk digest claims (hardly ever any)."""
    return (
        recipe_rows.select(F.explode("chunks").alias("c"))
        .groupBy(F.col("c.short").alias("short"))
        .agg(F.min("c.digest").alias("lo"), F.max("c.digest").alias("hi"))
        .where("lo <> hi")
        .select("short")
    )


def with_recipe_keys(recipe_rows: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """``rid, doc_id, text_sha256, ids, digests``: the ordered identifier lists to compare.

    ``digests`` is null unless a chunk of the row has an ambiguous id.
    """
    doubtful = (
        recipe_rows.select("rid", F.explode("chunks.short").alias("short"))
        .join(ambiguous, "short", "left_semi")
        .select("rid")
        .distinct()
        .withColumn("doubtful", F.lit(True))
    )
    return recipe_rows.join(doubtful, "rid", "left").select(
        "rid",
        "doc_id",
        "text_sha256",
        F.col("chunks.short").alias("ids"),
        F.when(F.col("doubtful"), F.col("chunks.digest")).alias("digests"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Decide for every row whether it stays.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept,
    text_sha256`` (digest of the lower-cased text). Texts are equal when
    identical after lower-casing A-Z only; null counts as empty, and all empty
    texts are equal. Of equal texts the largest id stays; a null id loses to any
    other. Of repeated rows (same id, equal text) exactly one stays. An empty
    table gives an empty result; other columns of the input are ignored.
    """
    rows = recipes(docs, id_col, text_col)
    keyed = with_recipe_keys(rows, ambiguous_ids(rows))
    # Aggregated before the shuffle, so a group of copies that holds a third of all rows arrives as one row a task.
    groups = (
        keyed.groupBy("ids", "digests")
        .agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select(F.col("ids").alias("g_ids"), F.col("digests").alias("g_digests"), "keep", "group_size")
    )
    same = (F.col("ids") == F.col("g_ids")) & F.col("digests").eqNullSafe(F.col("g_digests"))
    return keyed.join(groups, same, "left").select(
        "doc_id",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("keep").isNull() | (F.col("keep.rid") == F.col("rid"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns.

    Only decisions move: a row is known by its id and digest, and the rows that
    go are taken out where they stand if their list is short enough to broadcast.
    Of repeated rows (same id, equal text) the one whose text as written sorts
    last stays, and of several of those any one. Null texts are empty texts and
    equal to these; a null id loses to any other. Long texts are read where they
    stand. An empty table stays empty; columns may have any name.
    """
    plain, (doc, text) = numbered_columns(docs, id_col, text_col)
    decided = written(exact_dedup(plain, doc, text), "decided").where("NOT kept")
    same_id = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    keys = lambda rows: rows.select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")).distinct()
    gone, repeated = written(keys(decided.where(~same_id)), "gone"), written(keys(decided.where(same_id)), "repeated")
    marked = plain.withColumn("sha", F.sha2(lower_ascii(F.col(text)), 256))
    here = F.col(doc).eqNullSafe(F.col("gone_id")) & (F.col("sha") == F.col("gone_sha"))
    left = marked.join(if_small(gone), here, "left_anti")
    if not repeated.isEmpty():
        one = Window.partitionBy(doc, "sha").orderBy(F.desc(text))
        again = marked.join(if_small(repeated), here, "left_semi").withColumn("n", F.row_number().over(one)).where("n = 1").drop("n")
        left = left.join(if_small(repeated), here, "left_anti").unionByName(again)
    return left.drop("sha").toDF(*docs.columns)
