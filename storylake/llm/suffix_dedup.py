"""Removal of repeated byte strings (100 bytes or more) with sharded suffix arrays.

Equal 100-byte windows must meet in one shard, yet not all text can be sorted
in one place. So each window is dealt out by its anchor, the least hashed
32-byte gram inside it: equal windows have equal anchors. Consecutive windows of
one anchor form a fragment (at most 168 bytes).

1. Fragments are described by hashes only and gather by anchor. An anchor seen
   once has no repeats. Of fragments equal as a whole only the earliest stays to
   be looked at; the others repeat it in full. Anchors that a task finds frequent
   among its own fragments never gather: they go the way of point 2 at once.
2. Where an anchor has several different fragments, their bytes are fetched and
   gathered into shards. Each shard gets a suffix array by induced sorting;
   permuted common prefixes of 100 or more mark equal windows, of which all but
   the earliest are repeats. Fragments of an anchor with very many different
   ones are dealt out again in pieces of a few windows, by the 93 bytes that
   these windows share.
3. The repeated windows of a document cover the bytes to remove.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storylake.llm.common import written
from storylake.llm.decontamination import if_small
from storylake.llm.hashing import STEP, U, mix
from storylake.llm.suffix_array import permuted_prefixes, suffix_array
from storylake.sources.shared import Rounds, removed

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM  # an anchor starts at most so far behind its window
#: Bytes hashed at once, bytes within whose fragments repeats are met before the shuffle, and bytes of a shard.
SLICE, GATHERED, SHARD = 1 << 20, 1 << 24, 1 << 20
#: Different fragments of an anchor up to which they are compared together, and windows of a piece beyond; change the way, not the result.
HOT, PIECE = 512, 8
#: Different fragments of an anchor among those of ``GATHERED`` bytes (some 500,000) from which it never gathers as a whole.
MANY = 48
#: Place of documents without an id: after all others.
LAST = 2**63 - 1
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 2**64)


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[U(1)], np.full(size, U(_FACTOR))]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[U(1)], np.full(size, U(_INVERSE))]), dtype=np.uint64)
    return up, down


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from every position (those that the data has)."""
    h = mix(data.astype(U) + STEP)
    size = 1
    while size < GRAM:
        h = mix(h[:-size] * STEP + h[size:])
        size *= 2
    return h


def _least_in_reach(h: np.ndarray) -> np.ndarray:
    """Position of the least gram among the ``REACH + 1`` from every position; the leftmost of equal ones.

    Compared by the high bits of the hash; the low bits carry the position.
    """
    bits = U(28)
    low = (h >> bits << bits) | np.arange(len(h), dtype=U)
    size = 1
    while size * 2 <= REACH + 1:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = REACH + 1 - size
    low = np.minimum(low[:-rest], low[rest:]) if rest else low
    return (low & ((U(1) << bits) - U(1))).astype(np.int64)


def fragments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Fragments of several byte strings: anchor hash, fragment hash, string, first window, number of windows."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.view(U), none.view(U), none, none, none
    h = _grams(data)
    least = _least_in_reach(h)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    valid = np.flatnonzero(np.arange(len(least)) + LENGTH <= ends[owner])
    if not len(valid):
        return none.view(U), none.view(U), none, none, none
    anchor = least[valid]
    new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    first = valid[new]
    count = np.diff(np.append(np.flatnonzero(new), len(valid)))
    up, down = _powers(1 << int(np.ceil(np.log2(len(data) + 1))))
    total = np.concatenate([np.zeros(1, U), np.cumsum(h * up[: len(h)])])
    last = first + count - 1 + REACH + 1
    whole = mix((total[last] - total[first]) * down[first] + count.astype(U) * STEP)
    return h[anchor[new]], whole, owner[first], first - (ends - sizes)[owner[first]], count


def _slices(batches, text: int):
    """Batches of a few rows, by the bytes of the text column with that number."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64)
        ends, low = np.cumsum(size), 0
        while low < len(size):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] - size[low] + SLICE, "right")))
            yield batch.slice(low, high - low)
            low = high


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
    """Lists of structs (null: empty) as one array: first element, number of elements, all elements."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets[:-1], np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets)), column.values


def _documents(batches):
    """(ids, tags, UTF-8 bytes) of a few documents at a time."""
    for some in _slices(batches, 2):
        ids, tags = (some.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        yield ids, tags, some.column(2).cast(pa.binary()).to_pylist()


NAMES = ["anchor", "whole", "doc", "tag", "first", "windows", "kind"]
SCHEMA = "anchor long, whole long, doc long, tag long, first int, windows int, kind byte"
#: Kinds of fragments: to be compared, repeating an earlier one as a whole, one of very many of their anchor, and the same as a task tells it of its own.
OPEN, AGAIN, CROWDED, FREQUENT = 0, 1, 2, 3


def _rows(anchor, whole, doc, tag, first, windows, kind):
    arrays = [anchor.view(np.int64), whole.view(np.int64), doc, tag, first.astype(np.int32), windows.astype(np.int32), np.broadcast_to(kind, len(doc)).astype(np.int8)]
    for low in range(0, len(doc), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[low : low + 50_000]) for a in arrays], names=NAMES)


def _in_order(anchor, whole, doc, tag, first):
    """Order by fragment, then earliest first, and which are the first of their fragment.

    A place that comes twice (rows repeated with id and text) is listed once.
    """
    order = np.lexsort((first, tag, doc, whole, anchor))
    differs = lambda *columns: np.concatenate([[True], np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)])[: len(order)]
    once = differs(anchor, whole, doc, tag, first)
    return order[once], differs(anchor, whole)[once]


def _thinned(held):
    """Rows of a task's fragments; of equal ones only the earliest can still be no repeat."""
    anchor, whole, doc, tag, first, windows = (np.concatenate(c) for c in zip(*held))
    order, earliest = _in_order(anchor, whole, doc, tag, first)
    anchor, whole, doc, tag, first, windows = (a[order] for a in (anchor, whole, doc, tag, first, windows))
    # A known repeat needs no meeting: without its anchor it goes anywhere, so no anchor makes a task large.
    anchor = np.where(earliest, anchor, mix(doc.view(U) * STEP + first.astype(U)))
    _, group, times = np.unique(anchor, return_inverse=True, return_counts=True)
    kind = np.where(times[group] >= MANY, FREQUENT, OPEN)
    yield from _rows(anchor, np.where(earliest, whole, U(0)), doc, tag, first, windows, np.where(earliest, kind, AGAIN))


def _describe(batches):
    """Fragments of a task's documents, described by hashes."""
    held, size = [], 0
    for ids, tags, texts in _documents(batches):
        anchor, whole, owner, first, windows = fragments(texts)
        held.append((anchor, whole, ids[owner], tags[owner], first, windows))
        size += sum(map(len, texts))
        if size >= GATHERED:
            yield from _thinned(held)
            held, size = [], 0
    if held:
        yield from _thinned(held)


def _whole_anchors(batches):
    """Tables of a task's rows, sorted by anchor, that part no anchor; about a batch each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = batch.column(0).to_numpy()
        last = int(np.searchsorted(anchor, anchor[-1]))
        if last or (held and held[-1].column(0)[-1].as_py() != anchor[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _meet(batches, crowd: int):
    """Fragments of an anchor together: those that repeat another as a whole, and those to compare byte by byte, crowded if more than ``crowd``."""
    for table in _whole_anchors(batches):
        anchor, whole, doc, tag, first, windows, kind = (c.to_numpy() for c in table.columns)
        anchor, whole = anchor.view(U), whole.view(U)
        rest = np.flatnonzero(kind != AGAIN)
        order, earliest = _in_order(anchor[rest], whole[rest], doc[rest], tag[rest], first[rest])
        order = rest[order]
        late = np.concatenate([np.flatnonzero(kind == AGAIN), order[~earliest]])
        yield from _rows(*(a[late] for a in (anchor, whole, doc, tag, first, windows)), AGAIN)
        lead = order[earliest]
        _, group, times = np.unique(anchor[lead], return_inverse=True, return_counts=True)
        times = times[group]
        several = lead[times > 1]
        yield from _rows(*(a[several] for a in (anchor, whole, doc, tag, first, windows)), np.where(times[times > 1] > crowd, CROWDED, OPEN))


def _parts(batches):
    """(bytes, anchor, doc, tag, first) of the asked fragments of a few documents at a time."""
    for some in _slices(batches, 2):
        low, count, asked = _lists(some.column(3))
        row = np.repeat(np.arange(len(low)), count)
        at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(row))
        anchor, first, windows = (asked.field(n).to_numpy()[at] for n in ("anchor", "first", "windows"))
        texts = some.column(2).cast(pa.binary()).to_pylist()
        parts = [texts[r][a:b] for r, a, b in zip(row.tolist(), first.tolist(), (first + windows + LENGTH - 1).tolist())]
        yield parts, anchor, some.column(0).to_numpy()[row], some.column(1).to_numpy()[row], first


def _cut(batches):
    """Bytes of the asked fragments of each document."""
    for parts, anchor, doc, tag, first in _parts(batches):
        yield pa.RecordBatch.from_arrays([*map(pa.array, (anchor, doc, tag, first)), pa.array(parts, pa.binary())], names=["anchor", "doc", "tag", "first", "bytes"])


def pieces(parts: list[bytes], anchor: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of fragments: second anchor, piece hash, fragment, first window in it, number of windows.

    A piece holds the windows in which the anchor stands at ``PIECE`` neighbouring
    places. All of them share ``LENGTH - PIECE + 1`` bytes around it, which make
    the second anchor; equal windows have it alike.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(parts), np.uint8)
    h = _grams(data)
    owner = np.repeat(np.arange(len(parts)), sizes)[: len(h)]
    hits = np.flatnonzero(h == anchor.view(U)[owner])
    # The anchor is the leftmost gram of its hash in a fragment.
    at = hits[np.unique(owner[hits], return_index=True)[1]]
    n = sizes - LENGTH + 1
    part = np.repeat(np.arange(len(parts)), n)
    window = np.arange(len(part)) - np.repeat(np.cumsum(n) - n, n)
    block = (at[part] - starts[part] - window) // PIECE
    new = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (block[1:] != block[:-1])])[: len(part)])
    count = np.diff(np.append(new, len(part)))
    part, window, block = part[new], window[new], block[new]
    up, down = _powers(1 << int(np.ceil(np.log2(len(data) + 1))))
    total = np.concatenate([np.zeros(1, U), np.cumsum(h * up[: len(h)])])
    first, shared = starts[part] + window, at[part] - PIECE * block
    around = (total[shared + REACH - PIECE + 2] - total[shared]) * down[shared]
    second = mix(anchor.view(U)[part] + mix(around + block.astype(U) * STEP))
    whole = mix((total[first + count + REACH] - total[first]) * down[first] + count.astype(U) * STEP)
    return second, whole, part, window, count


def _refine(batches):
    """Pieces of the asked fragments, described by hashes."""
    held, size = [], 0
    for parts, anchor, doc, tag, first in _parts(batches):
        if not parts:
            continue
        second, whole, part, window, windows = pieces(parts, anchor)
        held.append((second, whole, doc[part], tag[part], first[part] + window, windows))
        size += sum(map(len, parts))
        if size >= GATHERED:
            yield from _thinned(held)
            held, size = [], 0
    if held:
        yield from _thinned(held)


def repeats_in_shard(parts: list[bytes], doc: np.ndarray, tag: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(part, window in it) of all windows of ``LENGTH`` bytes that an earlier place in the shard has too.

    Places are ordered by document, tag and position; the parts of a shard are
    the rows of the arguments.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(parts), np.uint8)
    sa = suffix_array(text)
    prefix = permuted_prefixes(text, sa, LENGTH)[sa]
    run = np.cumsum(prefix < LENGTH)
    part = np.repeat(np.arange(len(parts)), sizes)[sa]
    within = sa - starts[part]
    whole = within + LENGTH <= sizes[part]
    run, part, within = run[whole], part[whole], within[whole]
    # A place as one number: the document's rank, then the position in it.
    by_document = np.lexsort((tag, doc))
    rank = np.zeros(len(parts), np.int64)
    rank[by_document[1:]] = np.cumsum((doc[by_document[1:]] != doc[by_document[:-1]]) | (tag[by_document[1:]] != tag[by_document[:-1]]))
    place = (rank[part] << 32) + first[part] + within
    order = np.lexsort((place, run))
    run, part, within, place = run[order], part[order], within[order], place[order]
    lead = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])[: len(run)])
    # The same place may stand in a shard twice; equal windows at one place are no repeat of each other.
    later = place != np.repeat(place[lead], np.diff(np.append(lead, len(run))))
    return part[later], within[later]


def _sort_shards(batches):
    """Suffix arrays over shards of whole anchors; runs of repeated windows as rows ``doc, tag, first, windows``."""
    for table in _whole_anchors(batches):
        yield from _sort_table(table)


def _sort_table(table):
    anchor, doc, tag, first = (table.column(n).to_numpy() for n in ("anchor", "doc", "tag", "first"))
    parts = table.column("bytes").to_pylist()
    ends = np.cumsum([len(p) for p in parts])
    low = 0
    while low < len(parts):
        high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SHARD, "right"))
        high = max(high, low + 1)
        while high < len(parts) and anchor[high] == anchor[high - 1]:
            high += 1
        part, window = repeats_in_shard(parts[low:high], doc[low:high], tag[low:high], first[low:high])
        order = np.lexsort((window, part))
        part, window = part[order] + low, window[order]
        if len(part):
            new = np.concatenate([[True], (part[1:] != part[:-1]) | (window[1:] != window[:-1] + 1)])
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(part)))
            columns = [doc[part[at]], tag[part[at]], (first[part[at]] + window[at]).astype(np.int32), count.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc", "tag", "first", "windows"])
        low = high


def removed_runs(first: np.ndarray, windows: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows from ``first`` on."""
    runs: list[list[int]] = []
    for start, end in sorted(zip(first.tolist(), (first + windows + LENGTH - 1).tolist())):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return [tuple(r) for r in runs]


def _remove(batches):
    for batch in _slices(batches, 1):
        low, count, spans = _lists(batch.column(2))
        first, windows = spans.field("first").to_numpy(), spans.field("windows").to_numpy()
        out = []
        for doc_id, raw, a, n in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), low.tolist(), count.tolist()):
            raw = raw or b""
            runs = removed_runs(first[a : a + n], windows[a : a + n])
            kept, last = [], 0
            for start, end in runs:
                kept.append(raw[last:start])
                last = end
            kept = b"".join([*kept, raw[last:]])
            out.append((doc_id, len(raw), len(raw) - len(kept), len(runs), kept, [{"start": s, "end": e} for s, e in runs]))
        columns = list(zip(*out)) or [()] * 6
        kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed"])


def _met(described: DataFrame, crowd: int, label: str) -> DataFrame:
    """Written table ``anchor, doc, tag, first, windows, kind`` of the described fragments that are not alone."""
    gathered = described.repartition("anchor").sortWithinPartitions("anchor")
    return written(gathered.mapInArrow(lambda batches: _meet(batches, crowd), SCHEMA).drop("whole"), label)


def _spread(described: DataFrame, crowd: int) -> DataFrame:
    """:func:`_met` without the anchors that some task has found frequent, all of whose fragments are crowded without a meeting.

    Such an anchor may hold a large part of all fragments; one that no task finds
    frequent holds less than one in ten thousand.
    """
    rounds = Rounds(described.sparkSession, "described")
    table = rounds.settled(described)
    frequent = written(table.where(F.col("kind") == FREQUENT).select("anchor").distinct(), "frequent")
    if frequent.isEmpty():
        met = _met(table, crowd, "fragments")
        removed(table.sparkSession, rounds.path)
        return met
    frequent = if_small(frequent)
    known = F.col("kind") == AGAIN
    rest = table.where(known).unionByName(table.where(~known).join(frequent, "anchor", "left_anti"))
    crowded = table.where(~known).join(frequent, "anchor", "left_semi").withColumn("kind", F.lit(CROWDED).cast("byte")).drop("whole")
    met = _met(rest, crowd, "fragments").unionByName(written(crowded.select("anchor", "doc", "tag", "first", "windows", "kind"), "crowded"))
    removed(table.sparkSession, rounds.path)
    return met


def _asked(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc, tag, text, asked``: the documents of the wanted fragments with these."""
    asked = wanted.groupBy("doc", "tag").agg(F.collect_list(F.struct("anchor", "first", "windows")).alias("asked"))
    sources = texts.join(if_small(wanted.select("doc", "tag").distinct()), ["doc", "tag"], "left_semi").dropDuplicates(["doc", "tag"])
    return sources.join(asked, ["doc", "tag"]).select("doc", "tag", "text", "asked")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = HOT) -> DataFrame:
    """Written table ``doc, tag, first, windows``: runs of windows that start earlier somewhere as well.

    ``doc`` is the id (documents without one come last), ``tag`` a hash of the
    text that keeps different texts under one id apart. Anchors of more than
    ``crowd`` different fragments are split; that changes no result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))
    long_enough = placed.where(F.octet_length("text") >= LENGTH)
    met = _spread(long_enough.mapInArrow(_describe, SCHEMA), crowd)
    crowded = met.where(F.col("kind") == CROWDED)
    if not crowded.isEmpty():
        # Pieces that meet here share all but a few bytes, so they need no further split.
        met = met.unionByName(_met(_asked(long_enough, crowded).mapInArrow(_refine, SCHEMA), 2**62, "pieces"))
    cut = _asked(long_enough, met.where(F.col("kind") == OPEN)).mapInArrow(_cut, "anchor long, doc long, tag long, first int, bytes binary")
    partial = cut.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort_shards, "doc long, tag long, first int, windows int")
    return written(met.where(F.col("kind") == AGAIN).select("doc", "tag", "first", "windows").unionByName(partial), "repeats")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = HOT) -> DataFrame:
    """Every document without the bytes of strings that start earlier as well.

    Returns one row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept``
    (the remaining bytes, which may cut characters) and ``removed`` (byte runs).
    A byte goes if a 100-byte string over it also starts earlier: in a document
    of smaller id, or earlier in the same one; strings are judged on the input.
    Null counts as empty. Documents without an id come after all others. Several
    texts under one id are told apart by their content; rows repeated with id
    and text are one document, reported as often as they occur. An empty table
    gives an empty result; other columns are ignored.
    """
    spans = repeated_windows(docs, id_col, text_col, crowd).groupBy("doc", "tag").agg(F.collect_list(F.struct("first", "windows")).alias("spans"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("tag"))
    joined = placed.join(spans, ["doc", "tag"], "left").select("doc_id", "text", "spans")
    kind = placed.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<start:int,end:int>>")


def repeats_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row; see :func:`remove_repeats`."""
    done = remove_repeats(docs, id_col, text_col, crowd)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
