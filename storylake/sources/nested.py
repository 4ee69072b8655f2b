"""Nested settings of tables of many texts, told with Arrow and NumPy for a stretch of texts at a time.

A fold over each text's lines copies its stack and its entries at every line;
here all lines of a stretch go through each step together, and what a line
stands under is its nearest earlier node of less rank.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of texts that a task takes up at a time, beyond those of one text.
BYTES = 1 << 20
_SPACE = " \t\n\x0b\f\r"
_KEY = re.compile(r"""("[^"]*"|'[^']*'):(?=\s|\Z)""", re.ASCII)
_QUOTED = r"""(?s)^(?:"(?P<double>[^"]*)"|'(?P<single>[^']*)')[ \t\n\x0b\f\r]*(?:#.*)?$"""
_COMMENT = r"(?s)(?:^|[ \t\n\x0b\f\r])#.*"


def _byte(strings: pa.Array, at: np.ndarray | int = 0) -> np.ndarray:
    """The byte at a place of every string; 0 beyond its end."""
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    place = ends[:-1] + at
    found, inside = np.zeros(len(strings), np.uint8), place < ends[1:]
    found[inside] = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[place[inside]]
    return found


def _among(found: np.ndarray, signs: str) -> np.ndarray:
    known = np.zeros(256, bool)
    known[list(signs.encode())] = True
    return known[found]


def _size(strings: pa.Array) -> np.ndarray:
    return pc.binary_length(strings).to_numpy(zero_copy_only=False)


def _put(strings: pa.Array, where: np.ndarray, others: pa.Array) -> pa.Array:
    """``strings`` with ``others`` in the places of ``where``."""
    return pc.replace_with_mask(strings, pa.array(where), others) if len(others) else strings


def _kept(lines: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lines without their indentation, its width, and which lines are neither blank, comments nor document marks."""
    bare = pc.ascii_ltrim(lines, " ")
    column, first = _size(lines) - _size(bare), _byte(bare)
    comment = first == ord("#")
    spaced = _among(first, _SPACE)
    comment[spaced] = _byte(pc.ascii_ltrim(bare.filter(pa.array(spaced)), _SPACE)) == ord("#")
    mark = (column == 0) & _among(first, "-.") & (_byte(bare, 1) == first) & (_byte(bare, 2) == first)
    return bare, column, (_size(bare) > 0) & ~comment & ~mark


def _keys(rest: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Keys (empty where a line has none) and what is behind them."""
    first, colon = _byte(rest), pc.find_substring(rest, ":").to_numpy(zero_copy_only=False)
    ends = (colon + 1 == _size(rest)) | _among(_byte(rest, colon + 1), _SPACE)
    plain = (colon > 0) & ends & ~_among(first, _SPACE + "\"'[{")
    parts = pc.split_pattern(rest.filter(pa.array(plain)), ":", max_splits=1).flatten()
    halves = np.arange(0, len(parts), 2)
    keys = _put(pa.repeat("", len(rest)), plain, pc.ascii_rtrim(parts.take(pa.array(halves)), " "))
    after = _put(rest, plain, parts.take(pa.array(halves + 1)))
    quoted = (colon > 0) & _among(first, "\"'")
    told = [(m[1][1:-1], text[m.end() :]) if (m := _KEY.match(text)) else ("", text) for text in rest.filter(pa.array(quoted)).to_pylist()]
    return _put(keys, quoted, pa.array([k for k, _ in told], pa.string())), _put(after, quoted, pa.array([a for _, a in told], pa.string()))


def _values(after: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Scalars without quotes or comments, whether there is one, and whether a folded or literal block begins."""
    value = pc.ascii_ltrim(after, " ")
    quoted = _among(_byte(value), "\"'")
    found = pc.extract_regex(value.filter(pa.array(quoted)), _QUOTED)
    quoted[quoted] = matched = found.is_valid().to_numpy(zero_copy_only=False)
    inner = found.filter(pa.array(matched))
    value = _put(value, quoted, pc.binary_join_element_wise(inner.field("double"), inner.field("single"), ""))
    told = ~quoted & pc.match_substring(value, "#").to_numpy(zero_copy_only=False)
    value = _put(value, told, pc.ascii_trim(pc.replace_substring_regex(value.filter(pa.array(told)), _COMMENT, ""), " "))
    block = ~quoted & _among(_byte(value), ">|")
    block[block] = pc.match_substring_regex(value.filter(pa.array(block)), "^[>|][-+0-9]*$").to_numpy(zero_copy_only=False)
    return value, (quoted | (_size(value) > 0)) & ~block, block


def _inside(block: np.ndarray, column: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Lines of blocks: those behind a block's first line that stand deeper than it."""
    starts = np.flatnonzero(block)
    ends, open_ = starts + 1, np.arange(len(starts))
    while len(open_):
        open_ = open_[ends[open_] < len(column)]
        at, start = ends[open_], starts[open_]
        open_ = open_[(owner[at] == owner[start]) & (column[at] > column[start])]
        ends[open_] += 1
    change, until = np.zeros(len(column) + 1, np.int64), 0
    for start, end in zip(starts.tolist(), ends.tolist()):
        if start >= until:  # what looks like a block inside one is none
            change[start + 1] += 1
            change[end] -= 1
            until = end
    return np.cumsum(change[:-1]) > 0


def _above(rank: np.ndarray) -> np.ndarray:
    """The nearest earlier node of less rank; nodes of rank -1 have none. Nodes between may be jumped over as soon as they know theirs."""
    above, open_ = np.arange(len(rank)) - 1, np.flatnonzero(rank >= 0)
    while len(open_ := open_[rank[above[open_]] >= rank[open_]]):
        above[open_] = above[above[open_]]
    return above


def _numbers(above: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of items among those of the same list."""
    order = np.lexsort((rank, above))
    begins = np.r_[True, (np.diff(above[order]) != 0) | (np.diff(rank[order]) != 0)][: len(order)]
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))
    return number


def _paths(column: np.ndarray, behind: np.ndarray, item: np.ndarray, keys: pa.Array, owner: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Paths, and the place of each line's path among them; place 0 is that of no path.

    Nodes are an item's list (rank 2 * column + 1), a key (rank 2 * its column), and for lines without either
    an end (rank 2 * column) of what stands as deep; a node of rank -1 is before every text.
    """
    keyed, opens = _size(keys) > 0, np.r_[True, owner[1:] != owner[:-1]]
    size = opens + np.maximum(item.astype(np.int64) + keyed, 1)
    first = np.cumsum(size) - size + opens
    last = np.cumsum(size) - 1
    items, named, ended = first[item], (first + item)[keyed], first[~item & ~keyed]
    rank = np.full(size.sum(), -1)
    rank[items], rank[named], rank[ended] = 2 * column[item] + 1, 2 * behind[keyed], 2 * column[~item & ~keyed]
    above = _above(rank)
    names = pa.concat_arrays([pc.cast(pa.array(_numbers(above[items], rank[items])), pa.string()), keys.filter(pa.array(keyed))])
    name = np.zeros(len(rank), np.int64)
    name[items], name[named] = np.arange(len(items)), len(items) + np.arange(len(named))
    end = np.zeros(len(rank), bool)
    end[ended] = True
    while (through := end[above] & (rank >= 0)).any():
        above[through] = above[above[through]]
    known, place, nodes = rank < 0, np.zeros(len(rank), np.int64), np.flatnonzero((rank >= 0) & ~end)
    levels, before, count = [pa.array([""])], 0, 1
    while len(nodes):  # a round for every level
        ready = known[above[nodes]]
        now, nodes = nodes[ready], nodes[~ready]
        own = names.take(pa.array(name[now]))
        levels.append(own if len(levels) == 1 else pc.binary_join_element_wise(levels[-1].take(pa.array(place[above[now]] - before)), own, "."))
        place[now], known[now] = count + np.arange(len(now)), True
        before, count = count, count + len(now)
    return pa.concat_arrays(levels), place[np.where(end[last], above[last], last)]


def entries(ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
    """Ids, paths and values of the entries of texts."""
    split = pc.split_pattern(pc.fill_null(texts.cast(pa.string()), ""), "\n")
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    bare, column, kept = _kept(pc.ascii_rtrim(split.flatten(), _SPACE))
    bare, column, owner = bare.filter(pa.array(kept)), column[kept], owner[kept]
    item = (_byte(bare) == ord("-")) & ((_size(bare) == 1) | (_byte(bare, 1) == ord(" ")))
    rest = _put(bare, item, pc.ascii_ltrim(pc.utf8_slice_codeunits(bare.filter(pa.array(item)), 1), " "))
    keys, after = _keys(rest)
    value, put, block = _values(after)
    behind = column + _size(bare) - _size(rest)
    out = pa.array(~_inside(block, column, owner)) if block.any() else pa.array(np.ones(len(bare), bool))
    rows = out.to_numpy(zero_copy_only=False)
    value, keys, column, behind, item, owner, put = value.filter(out), keys.filter(out), column[rows], behind[rows], item[rows], owner[rows], put[rows]
    if not len(value):
        return [ids.slice(0, 0), pa.array([], pa.string()), pa.array([], pa.string())]
    paths, place = _paths(column, behind, item, keys, owner)
    put &= place > 0
    return [ids.take(pa.array(owner[put])), paths.take(pa.array(place[put])), value.filter(pa.array(put))]


def entry_batches(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of the entries of ``id, text`` batches, stretch by stretch."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        stretch = np.cumsum(sizes, dtype=np.int64) // BYTES
        cuts = [0, *(np.flatnonzero(np.diff(stretch)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            yield pa.RecordBatch.from_arrays(entries(batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start)), names=names)


def yaml_rows(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, path, value``: a row for every entry of :func:`storylake.sources.settings.yaml_entries`, for tables of many texts."""
    kept = texts.select(id_col, text_col)
    names = [id_col, "path", "value"]
    return kept.mapInArrow(lambda batches: entry_batches(batches, names), f"{id_col} {kept.schema[id_col].dataType.simpleString()}, path string, value string")
