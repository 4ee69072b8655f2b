"""Benchmark decontamination with a distributed positional inverted index, in DataFrame functions only.

The index stores a posting ``(rid, pos, term_no)`` for every occurrence in the
training texts of a word that some benchmark item has. It is cut by document:
postings are written where the text was read, and never shuffled whole.

Exact phrases: of every window of an item, the rarest terms are looked up. A
posting minus the term's place in the item gives the shift at which the item
would lie on the document; a window that occurs brings all its rarest terms to
the same shift. Only shifts where enough lists meet are compared in full, term
by term, and yield the windows that occur there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from storylake.llm.common import lower_ascii, numbered_columns, written

WINDOW = 10
#: Lists intersected for each window before any comparison in full.
RAREST = 3
#: Rows, and bytes of strings and nested values in them, up to which a table counts as small enough to broadcast; both are measured first. Beyond, Spark shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 64 << 20
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text after lower-casing A-Z: runs of digits, a-z and everything beyond ASCII."""
    return F.filter(F.split(lower_ascii(text), WORD_BREAK), lambda w: w != "")


def if_small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if its rows and the bytes of its strings, counted first, prove it small."""
    wide = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (NumericType, BooleanType))]
    size = F.octet_length(F.to_json(F.struct(*wide))) if wide else F.lit(0)
    seen = df.select(size.cast("long").alias("size")).limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    return F.broadcast(df) if seen["n"] <= BROADCAST_ROWS and (seen["size"] or 0) <= BROADCAST_BYTES else df


@dataclass
class PositionalIndex:
    """Postings of the training texts for the terms of the benchmark, as written tables."""

    items: DataFrame  # item_no, item_id, words
    item_terms: DataFrame  # item_no, item_pos, term_no
    postings: DataFrame  # rid, doc_id, n_words, text_hash, pos, term_no; term_no null in a row that only stands for its document

    def documents(self) -> DataFrame:
        """``rid, doc_id, n_words, text_hash``: one row per document row."""
        return self.postings.where("pos IS NULL OR pos = 0").select("rid", "doc_id", "n_words", "text_hash")


def build_index(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> PositionalIndex:
    """Read every whole text once and write the postings of benchmark terms."""
    listed = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("words")).where("size(words) > 0").distinct()
    items = written(listed.withColumn("item_no", F.monotonically_increasing_id()), "items")
    placed = items.select("item_no", F.posexplode("words").alias("item_pos", "term"))
    vocabulary = written(placed.select("term").distinct().withColumn("term_no", F.monotonically_increasing_id()), "vocabulary")
    item_terms = written(placed.join(vocabulary, "term").select("item_no", "item_pos", "term_no"), "item_terms")
    tokens = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .withColumn("rid", F.monotonically_increasing_id())
        .select("rid", "doc_id", words(F.col("text")).alias("words"), F.xxhash64("text").alias("text_hash"))
        .select("rid", "doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.posexplode_outer("words").alias("pos", "term"))
    )
    postings = tokens.join(if_small(vocabulary), "term", "left").where("term_no IS NOT NULL OR pos IS NULL OR pos = 0").drop("term")
    return PositionalIndex(items, item_terms, written(postings, "postings"))


def _window_terms(index: PositionalIndex, window: int) -> DataFrame:
    """``item_no, first, size, item_pos, term_no, freq`` for every place of every window; absent terms have frequency 0."""
    frequency = index.postings.where("term_no IS NOT NULL").groupBy("term_no").agg(F.count("*").alias("freq"))
    size = F.least(F.size("words"), F.lit(window))
    windows = index.items.select("item_no", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("first"))
    inside = (F.col("item_pos") >= F.col("first")) & (F.col("item_pos") < F.col("first") + F.col("size"))
    ranked = index.item_terms.join(if_small(written(frequency, "frequency")), "term_no", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    # An item's places meet its own windows only: ``window`` rows a place.
    starts = ranked.withColumn("first", F.explode(F.sequence(F.greatest(F.lit(0), F.col("item_pos") - window + 1), F.col("item_pos"))))
    return starts.join(windows, ["item_no", "first"]).where(inside)


def rarest_places(index: PositionalIndex, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """``item_no, item_pos, term_no, needed``: the places whose postings are looked up.

    Of every window whose terms all occur, the ``rarest`` places of least
    frequency; ``needed`` is how many of an item's places must meet at a shift.
    """
    places = (
        _window_terms(index, window)
        .groupBy("item_no", "first", "size")
        .agg(F.sort_array(F.collect_list(F.struct("freq", "item_pos", "term_no"))).alias("places"))
        .where("places[0].freq > 0")
        .select("item_no", "size", F.explode(F.slice("places", 1, rarest)).alias("p"))
    )
    return places.select("item_no", "p.item_pos", "p.term_no", F.least("size", F.lit(rarest)).alias("needed")).distinct()


def phrase_matches(index: PositionalIndex, window: int = WINDOW) -> DataFrame:
    """``rid, item_no, shift, places``: the item places, in order, that lie in windows occurring at that shift."""
    lookup = if_small(written(rarest_places(index, window), "places"))
    postings = index.postings.where("term_no IS NOT NULL").select("rid", "pos", "term_no")
    shifts = (
        postings.join(lookup, "term_no")
        .groupBy("rid", "item_no", (F.col("pos") - F.col("item_pos")).alias("shift"))
        .agg(F.count("*").alias("met"), F.max("needed").alias("needed"))
        .where("met >= needed")
        .select("rid", "item_no", "shift")
    )
    shifts = written(shifts, "shifts")
    expected = shifts.join(if_small(index.item_terms), "item_no").withColumn("pos", F.col("item_pos") + F.col("shift"))
    candidates = postings.join(if_small(shifts.select("rid").distinct()), "rid", "left_semi")
    lengths = index.items.select("item_no", F.least(F.size("words"), F.lit(window)).alias("size"))
    met = (
        candidates.join(expected, ["rid", "pos", "term_no"])
        .groupBy("rid", "item_no", "shift")
        .agg(F.sort_array(F.collect_list("item_pos")).alias("met"))
        .join(if_small(lengths), "item_no")
        .where("size(met) >= size")
    )
    starts = F.expr("filter(sequence(0, size(met) - size), j -> met[j + size - 1] - met[j] = size - 1)")
    covered = F.expr("array_distinct(flatten(transform(starts, j -> slice(met, j + 1, size))))")
    return met.withColumn("starts", starts).where("size(starts) > 0").select("rid", "item_no", "shift", covered.alias("places"))


def proximity_matches(index: PositionalIndex, slack: int, window: int = WINDOW) -> DataFrame:
    """``doc_id, item_id, first, pos``: windows all of whose terms lie near their rarest one.

    Terms may come in any order, each within ``window + slack - 1`` words of the
    occurrence at ``pos`` of the window's rarest term.
    """
    terms = _window_terms(index, window).select("item_no", "first", "term_no", "freq").distinct()
    sizes = terms.groupBy("item_no", "first").agg(F.min(F.struct("freq", "term_no")).alias("rare"), F.count("*").alias("n"))
    sizes = sizes.where("rare.freq > 0").select("item_no", "first", F.col("rare.term_no").alias("term_no"), "n")
    postings = index.postings.where("term_no IS NOT NULL").select("rid", "doc_id", "pos", "term_no")
    anchors = postings.join(if_small(sizes), "term_no").select("rid", "doc_id", F.col("pos").alias("at"), "item_no", "first", "n")
    wanted = anchors.join(if_small(terms.select("item_no", "first", "term_no")), ["item_no", "first"])
    near = wanted.join(postings.drop("doc_id"), ["rid", "term_no"]).where(F.abs(F.col("pos") - F.col("at")) < window + slack)
    found = near.groupBy("rid", "doc_id", "item_no", "first", "at", "n").agg(F.countDistinct("term_no").alias("met")).where("met = n")
    return found.join(index.items, "item_no").select("doc_id", "item_id", "first", F.col("at").alias("pos"))


def _reported(index: PositionalIndex, window: int) -> DataFrame:
    places = phrase_matches(index, window).join(if_small(index.items.select("item_no", F.col("item_id").cast("string").alias("item"))), "item_no")
    hits = places.groupBy("rid").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.expr("transform(places, p -> p + shift)"))))).cast("long").alias("n_hit"),
        F.sort_array(F.collect_set("item")).alias("items"),
    )
    return index.documents().join(hits, "rid", "left")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """What of the benchmark occurs in every document.

    Returns one row per input row: ``doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated, items``. ``n_hit`` counts words inside any
    occurring window; ``items`` are the sorted distinct ids, as strings, of items
    with one. Null and wordless texts have no words and no hits; items without
    words have no windows; an item without an id hits words but isn't listed.
    Repeated rows are reported one by one, repeated items once. An empty table
    of documents gives an empty result, an empty benchmark no hits.
    """
    index = build_index(docs, benchmark, id_col, text_col, item_col)
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return _reported(index, window).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        items.alias("items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark; all columns as they were.

    Null and wordless texts stay. Repeated rows stay or go together, rows of one
    id and different texts each by its own. An empty table stays empty, an empty
    benchmark drops nothing; columns may have any name.
    """
    plain, (doc, text) = numbered_columns(docs, id_col, text_col)
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias(text))
    index = build_index(plain, items, doc, text, "item_id")
    found = _reported(index, window).where("n_hit > 0").select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct()
    same = F.col(doc).eqNullSafe(F.col("hit_id")) & (F.xxhash64(F.col(text)) == F.col("hit_hash"))
    return plain.join(if_small(written(found, "contaminated")), same, "left_anti").toDF(*docs.columns)
