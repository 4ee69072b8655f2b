"""Near-duplicate documents: DartMinHash signatures, banded joining, exact check, classes.

1. A document is the weighted set of its five-word shingles (weight: how often
   it holds them). Documents with the same words in the same order are one node.
2. Nodes meet in the buckets of 25 bands of 5 signature values each: at a
   similarity of 0.8 a pair misses all of them once in 20,000 times.
3. In a bucket nodes are first compared with leaders. The comparison is exact,
   on the shingles.
4. Confirmed pairs make a graph; its connected components are the classes. In
   buckets that still hold several classes, nodes of each are compared again
   with other leaders, as long as that confirms many of the pairs.
5. Buckets that hold several classes even then are finished in full: every two
   of their nodes are compared, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storylake.llm import dart_minhash
from storylake.llm.common import numbered_columns, written
from storylake.llm.components import forest_roots, merge_roots
from storylake.llm.decontamination import if_small
from storylake.llm.hashing import STEP, U, mix

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
#: Words worked on at once in a task; bounds memory, changes no result.
SLICE = 250_000
#: Leaders are asked again while this share of a turn's pairs is confirmed; changes the way, not the result.
WORTH = 0.25
#: About so many nodes, or words, of a bucket make a block, and so many shingles are compared at once; bound memory, change no result.
BLOCK, BLOCK_WORDS, WIDE = 768, 400_000, 8_192


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words (runs of letters, marks, digits and ``_``) of a text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}_]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of several documents and the document of each.

    ``words`` holds the documents' word hashes one after another. A document of
    fewer than five words, but not none, is one shingle.
    """
    owner = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)[owner] if len(owner) else owner
    take = np.minimum(lengths, SHINGLE)[owner]
    start = np.arange(len(words)) + take <= ends
    short = lengths[owner] < SHINGLE
    first = np.zeros(len(words), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    start &= ~short | first
    at = np.flatnonzero(start)
    hashed = np.zeros(len(at), U)
    for i in range(SHINGLE):
        inside = i < take[at]
        hashed[inside] = mix(hashed[inside] * STEP + words[at[inside] + i])
    return hashed, owner[at]


def counted(hashed: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shingle, document) with how often each occurs."""
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return hashed[at], owner[at], np.diff(np.append(at, len(order)))


def _slices(batches):
    """(ids, word hashes, words a document) of a few documents at a time."""
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        offsets = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False).view(U)
        low = 0
        while low < len(ids):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE, "right")) - 1)
            yield ids.slice(low, high - low), flat[offsets[low] : offsets[high]], np.diff(offsets[low : high + 1]).astype(np.int64)
            low = high


def _sketch(batches):
    for ids, words, lengths in _slices(batches):
        hashed, owner = shingles(words, lengths)
        elements, owner, count = counted(hashed, owner)
        signature = dart_minhash.signatures(elements, count.astype(np.float64), owner, len(lengths), BANDS * ROWS)
        keys = dart_minhash.band_keys(signature, BANDS).view(np.int64)
        ends = np.cumsum(lengths)
        digests = [xxhash.xxh3_128_digest(words[e - n : e].tobytes()) for e, n in zip(ends, lengths)]
        lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(digests, pa.binary()), pa.array(lengths), lists], names=["doc_id", "digest", "n_words", "bands"])


def _expanded(batches):
    """Each occurrence of a shingle as an element of its own: weighted similarity becomes that of plain sets."""
    for ids, words, lengths in _slices(batches):
        elements, owner, count = counted(*shingles(words, lengths))
        at = np.repeat(np.arange(len(elements)), count)
        number = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        values = mix(elements[at] + number.astype(U) * STEP).view(np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[at], minlength=len(lengths)))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(values))], names=["node", "elements"])


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table ``doc_id, digest, n_words, bands`` of all documents with an id."""
    hashed = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), word_hashes(F.col(text_col)).alias("words"))
    return written(hashed.mapInArrow(_sketch, "doc_id long, digest binary, n_words long, bands array<long>"), "sketches")


def _buckets(members: DataFrame) -> DataFrame:
    """``key, node, leader`` for the buckets of two or more; the leader is the least node."""
    ends = members.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last").drop("last")
    # Written first, so that Spark can split a bucket of very many nodes between tasks.
    return members.join(if_small(written(ends, "leaders")), "key")


def _first_pairs(met: DataFrame) -> DataFrame:
    """``a < b``: every node with the one leader whom it meets in most buckets."""
    shared = met.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("n"))
    best = shared.groupBy("node").agg(F.max(F.struct("n", (-F.col("leader")).alias("back"))).alias("best"))
    return best.select((-F.col("best.back")).alias("a"), F.col("node").alias("b"))


def _next_pairs(rooted: DataFrame, turn: int) -> DataFrame:
    """``a < b``: in every bucket of several classes, one node of each class with the bucket's leaders.

    Leaders are two nodes of the class that has most nodes in the bucket, and one
    of the least class. Nodes stand for their class by an order of ids under a
    mask; the mask changes with the bucket and the turn, so a class is stood for
    by many of its nodes.
    """
    mask = F.xxhash64("key", F.lit(turn))
    stand = rooted.withColumn("at", F.col("node").bitwiseXOR(mask)).groupBy("key", "root").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n"))
    ends = stand.groupBy("key").agg(F.count("*").alias("classes"), F.max(F.struct("n", "lo", "hi", "root")).alias("most"), F.min(F.struct("lo", "root")).alias("least")).where("classes > 1")
    leader = lambda at, root: F.struct(at.bitwiseXOR(mask).alias("leader"), root.alias("of"))
    leaders = F.array(leader(F.col("most.lo"), F.col("most.root")), leader(F.col("most.hi"), F.col("most.root")), leader(F.col("least.lo"), F.col("least.root")))
    met = stand.join(ends, "key").select("root", F.col("lo").bitwiseXOR(mask).alias("node"), F.inline(leaders)).where("root <> of")
    return met.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def _similar(pairs: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a, b`` whose exact weighted Jaccard similarity reaches the threshold."""
    led = pairs.join(elements.select(F.col("node").alias("a"), F.col("elements").alias("theirs")), "a")
    common = F.size(F.array_intersect("elements", "theirs"))
    union = F.size("elements") + F.size("theirs") - common
    paired = led.join(elements.select(F.col("node").alias("b"), "elements"), "b")
    return paired.where(common >= F.lit(threshold) * union - 1e-9).select("a", "b")


def _blocks(rooted: DataFrame) -> DataFrame:
    """``key, i, j, node, root, block``: every pair of blocks ``i <= j`` of the buckets of several classes, and their nodes.

    Buckets of up to three nodes are left out, since a turn of
    :func:`_next_pairs` compares all their classes' nodes with one another. Of
    buckets with the same nodes one is taken.
    """
    mixed = lambda seed: F.bit_xor(F.xxhash64("node", F.lit(seed)))
    counts = (F.count("*").alias("n"), F.sum("size").alias("words"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    sets = rooted.groupBy("key").agg(*counts, F.min("node").alias("first"), F.max("node").alias("last"), mixed("one").alias("one"), mixed("two").alias("two")).where("n > 3 and lo <> hi")
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("words") / BLOCK_WORDS))
    wanted = sets.groupBy("n", "words", "first", "last", "one", "two").agg(F.min("key").alias("key")).select("key", parts.alias("parts"))
    dealt = rooted.join(if_small(written(wanted, "wanted")), "key").withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("parts")))
    beside = dealt.select("key", "node", "root", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    return beside.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "root", "block")


def _linked(table: pa.Table, threshold: float) -> pa.Table:
    """Links ``a, b`` that join what is similar across classes in one pair of blocks: every node with the least it is joined to."""
    node, root, block = (table.column(c).to_numpy() for c in ("node", "root", "block"))
    lists = table.column("elements").combine_chunks()
    size, values = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    apart = root[:, None] != root[None, :]
    if block.min() != block.max():
        apart &= block[:, None] != block[None, :]
    if apart.any():
        owner = np.repeat(np.arange(len(size)), size)
        _, at, count = np.unique(values, return_inverse=True, return_counts=True)
        place = np.cumsum(count > 1) - 1
        both = count[at] > 1
        owner, at = owner[both], place[at[both]]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        common = np.zeros(apart.shape)
        for low in range(0, int(at[-1]) + 1 if len(at) else 0, WIDE):
            here = slice(*np.searchsorted(at, [low, low + WIDE]))
            held = np.zeros((len(size), WIDE), np.float32)
            held[owner[here], at[here] - low] = 1
            common += held @ held.T
        apart &= common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
    rank = np.argsort(np.argsort(node, kind="stable"), kind="stable")
    least = rank.copy()
    while True:
        now = np.minimum(least, np.where(apart, least[None, :], len(least)).min(axis=1))
        if (now == least).all():
            break
        least = now
    joined = least != rank
    return pa.table({"a": np.sort(node)[least[joined]], "b": node[joined]})


def _block_links(rooted: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """``a <= b``: links that join all similar nodes of different classes in any bucket."""
    met = _blocks(rooted).join(elements.select("node", "elements"), "node")
    return met.groupBy("key", "i", "j").applyInArrow(lambda table: _linked(table, threshold), "a long, b long").distinct()


def node_classes(nodes: DataFrame, docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """``node, root`` for the nodes that are similar to another: the components of all confirmed links.

    First every node is compared with one leader. After that, buckets of several
    classes are taken up again while a turn confirms a fair share (``WORTH``) of
    its pairs. Classes only grow, so a bucket of one class is done with, and each
    turn reads what the last one left. The leaders are a fast path only: what is
    left at the end is compared in full, so no link in any bucket is lost.
    """
    met = written(_buckets(nodes.select("node", F.explode("bands").alias("key"))), "buckets")
    wanted = met.select("node").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).join(wanted, "node", "left_semi")
    # Texts under one id share its node, and a pair is similar if any two of their texts are.
    hashed = texts.select("node", word_hashes(F.col("text")).alias("words")).distinct()
    elements = written(hashed.mapInArrow(_expanded, "node long, elements array<long>").withColumn("size", F.size("elements")), "elements")
    tested = written(_first_pairs(met), "pairs")
    first = _similar(tested, elements, threshold)
    # One smaller leader a node: a forest. (Texts under one id may confirm a pair more than once.)
    roots = forest_roots(first.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")))
    turn = 1
    while True:
        rooted = written(met.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "rooted")
        apart = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        rooted = written(rooted.join(if_small(written(apart, "apart")), "key", "left_semi"), "open")
        # No pair is compared twice.
        pairs = written(_next_pairs(rooted, turn).join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.union(pairs)
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        # Only the paired nodes' elements move.
        paired = elements.join(if_small(written(ends, "ends")), "node", "left_semi")
        links = written(_similar(pairs, paired, threshold), "links")
        roots = merge_roots(roots, links)
        if links.count() <= WORTH * pairs.count():
            break
        met = rooted.drop("root")
        turn += 1
    sizes = elements.groupBy("node").agg(F.max("size").alias("size"))
    rooted = written(rooted.drop("root").join(sizes, "node").join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root")), "rest")
    return merge_roots(roots, written(_block_links(rooted, elements, threshold), "links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Class of near-duplicates of every document: ``doc_id, class_id, n_words``.

    ``class_id`` is the least id of the class; a document alike to no other is
    its own class. Two documents belong together if a chain of pairs with a
    weighted Jaccard similarity of five-word shingles of ``threshold`` or more
    joins them. Null and wordless texts have no shingles and are classes of
    their own; rows without an id get no class (null). Repeated rows are equal
    texts; several texts under one id share a class. An empty table gives an
    empty result; other columns are ignored.
    """
    drawn = sketches(docs, id_col, text_col)
    worded = drawn.where("n_words > 0")
    same = worded.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    nodes = written(same, "nodes")
    roots = node_classes(nodes.select("node", "bands"), docs, threshold, id_col, text_col)
    of_digest = nodes.select("digest", "node").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("class_id"))
    classed = drawn.select("doc_id", "n_words", F.when(F.col("n_words") > 0, F.col("digest")).alias("digest")).join(of_digest, "digest", "left")
    with_id = classed.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "n_words")
    without = docs.where(F.col(id_col).isNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("n_words"))
    return with_id.unionByName(without)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents whose class has a smaller id, with all columns.

    Rows without an id and rows without words stay; repeated rows of a kept id
    stay, and of classes of equal similarity the least id does. An empty table
    stays empty; columns may have any name. Texts of any length are compared whole.
    """
    plain, (doc, text) = numbered_columns(docs, id_col, text_col)
    classes = near_duplicates(plain, doc, text, threshold)
    dropped = classes.groupBy("doc_id").agg(F.min("class_id").alias("least")).where("least < doc_id").select(F.col("doc_id").alias("gone_id"))
    return plain.join(if_small(written(dropped, "dropped")), F.col(doc) == F.col("gone_id"), "left_anti").toDF(*docs.columns)
