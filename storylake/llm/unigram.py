"""SentencePiece encoding and decoding with a unigram model.

Pieces and log scores come from a SentencePiece model file. A text is cut into
stretches that no piece can cross (a run of white space with the word after it);
each distinct stretch is segmented once a task by Viterbi search over a
double-array trie of the pieces, many stretches at a time. Characters without a
piece fall back to byte pieces. Decoding joins the pieces' bytes and turns the
white-space marker back.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storylake.llm import double_array

MARKER = "▁"  # stands for a space
#: A character without a piece scores this much under the least piece.
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)  # piece types of the file format
#: Segmented stretches that a task remembers before it starts over.
REMEMBERED = 100_000
#: Longer stretches (in bytes) are segmented one by one.
TOGETHER = 40


def _fields(data: bytes):
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


@dataclass(frozen=True)
class UnigramModel:
    """Vocabulary, trie and byte pieces; a few MB, bounded by the model file."""

    pieces: list[str]
    scores: np.ndarray
    trie: double_array.DoubleArray
    byte_ids: np.ndarray
    surface: list[bytes]
    unknown_id: int
    unknown_score: float
    crossing: bool
    add_dummy_prefix: bool


def load_model(path: str) -> UnigramModel:
    """Read a SentencePiece model file (on the driver)."""
    with open(path, "rb") as file:
        data = file.read()
    pieces, scores, kinds, dummy = [], [], [], True
    for number, value in _fields(data):
        if number == 1:
            own = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
            pieces.append(own[1].decode())
            scores.append(struct.unpack("<f", own[2])[0])
            kinds.append(own[3])
        elif number == 3:
            dummy = bool(dict(_fields(value)).get(3, 1))
    return make_model(pieces, scores, kinds, dummy)


def make_model(pieces: list[str], scores: list[float], kinds: list[int], add_dummy_prefix: bool = True) -> UnigramModel:
    """A model from its vocabulary."""
    used = [i for i, k in enumerate(kinds) if k in (NORMAL, USER) and pieces[i]]
    byte_ids = np.full(256, -1, np.int32)
    surface = []
    for i, (piece, kind) in enumerate(zip(pieces, kinds)):
        if kind == BYTE:
            byte_ids[int(piece[1:-1], 16)] = i
            surface.append(bytes([int(piece[1:-1], 16)]))
        else:
            surface.append(piece.replace(MARKER, " ").encode() if kind in (NORMAL, USER) else " ⁇ ".encode() if kind == UNKNOWN else b"")
    return UnigramModel(
        pieces,
        np.array(scores, np.float64),
        double_array.build([pieces[i].encode() for i in used], used),
        byte_ids,
        surface,
        next((i for i, k in enumerate(kinds) if k == UNKNOWN), 0),
        min((scores[i] for i in used), default=0.0) - UNKNOWN_PENALTY,
        any(MARKER in pieces[i].lstrip(MARKER) or "\n" in pieces[i] for i in used),
        add_dummy_prefix,
    )


STRETCH = re.compile(" *[^ \n]+|\n| +")


def stretches(text: str, model: UnigramModel) -> list[str]:
    """Parts of a text, in order, that segment independently of one another."""
    if not text:
        return []
    text = text.replace(MARKER, " ")
    text = " " + text if model.add_dummy_prefix else text
    return [text] if model.crossing else STRETCH.findall(text)


def _char_bytes(first: np.ndarray) -> np.ndarray:
    """Bytes of the UTF-8 character that starts with ``first``."""
    return 1 + (first >= 0xC0).astype(np.int64) + (first >= 0xE0) + (first >= 0xF0)


def _fallback(model: UnigramModel, raw: bytes) -> list[int]:
    ids = model.byte_ids[np.frombuffer(raw, np.uint8)]
    return ids.tolist() if (ids >= 0).all() else [model.unknown_id]


def segment_one(data: bytes, model: UnigramModel) -> list[int]:
    """Viterbi over one byte string; the earlier start wins ties, as in the usual lattice search."""
    base, check, value, scores = map(memoryview, (model.trie.base, model.trie.check, model.trie.value, model.scores))
    n = len(data)
    best, came, piece = [None] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for start in range(n):
        if best[start] is None:
            continue
        first = data[start]
        one = start + (1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)
        node, at, single = 0, start, False
        while at < n:
            below = base[node] + data[at]
            if check[below] != node:
                break
            node, at = below, at + 1
            if (found := value[node]) >= 0:
                single |= at == one
                score = best[start] + scores[found]
                if best[at] is None or score > best[at]:
                    best[at], came[at], piece[at] = score, start, found
        if not single:
            score = best[start] + model.unknown_score
            if best[one] is None or score > best[one]:
                best[one], came[one], piece[one] = score, start, -1
    ids, at = [], n
    while at:
        ids += [piece[at]] if piece[at] >= 0 else _fallback(model, data[came[at] : at])[::-1]
        at = came[at]
    return ids[::-1]


def segment_many(words: list[bytes], model: UnigramModel) -> list[bytes]:
    """Viterbi over many short byte strings at once; the ids of each as int32 bytes."""
    base, check, value = model.trie.base, model.trie.check, model.trie.value
    lengths = np.array([len(w) for w in words])
    count, longest = len(words), int(lengths.max())
    text = np.zeros((count, longest + 4), np.uint8)
    inside = np.arange(longest + 4) < lengths[:, None]
    text[inside] = np.frombuffer(b"".join(words), np.uint8)
    best = np.full((count, longest + 5), -np.inf)
    came, piece = np.zeros((count, longest + 5), np.int32), np.full((count, longest + 5), -1, np.int32)
    best[:, 0] = 0.0
    for start in range(longest):
        rows = np.flatnonzero((lengths > start) & np.isfinite(best[:, start]))
        if not len(rows):
            continue
        one = start + _char_bytes(text[rows, start])
        single = np.zeros(count, bool)
        live, node, at = rows, np.zeros(len(rows), np.int32), start
        single_at = np.zeros(count, np.int64)
        single_at[rows] = one
        while len(live):
            below = base[node] + text[live, at]
            ok = (check[below] == node) & (lengths[live] > at)
            live, node, at = live[ok], below[ok], at + 1
            found = value[node]
            ends = found >= 0
            row, found = live[ends], found[ends]
            single[row[single_at[row] == at]] = True
            score = best[row, start] + model.scores[found]
            better = score > best[row, at]
            row, found = row[better], found[better]
            best[row, at], came[row, at], piece[row, at] = score[better], start, found
        bare = ~single[rows]
        row, end = rows[bare], one[bare]
        score = best[row, start] + model.unknown_score
        better = score > best[row, end]
        row, end = row[better], end[better]
        best[row, end], came[row, end], piece[row, end] = score[better], start, -1
    parts, rows, at = [], np.arange(count), lengths.copy()
    while len(rows):
        parts.append((rows, came[rows, at], at, piece[rows, at]))
        at = came[rows, at]
        rows, at = rows[at > 0], at[at > 0]
    row, start, end, ids = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort((start, row))
    row, start, end, ids = row[order], start[order], end[order], ids[order]
    wide = np.where(ids < 0, end - start, 1)  # a fallback character becomes one id a byte
    if (model.byte_ids < 0).any():
        wide[:] = 1
    at = np.repeat(np.arange(len(ids)), wide)
    number = np.arange(len(at)) - np.repeat(np.cumsum(wide) - wide, wide)
    out = ids[at]
    lost = out < 0
    out[lost] = model.byte_ids[text[row[at[lost]], start[at[lost]] + number[lost]]] if not (model.byte_ids < 0).any() else model.unknown_id
    ends = 4 * np.cumsum(np.bincount(row[at], minlength=count))
    raw = out.astype(np.int32).tobytes()
    return [raw[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist())]


class Encoder:
    """Encodes texts, remembering stretches it has segmented."""

    def __init__(self, model: UnigramModel):
        self.model, self.known = model, {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as int32 bytes."""
        cut = [stretches(t or "", self.model) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list({s for part in cut for s in part} - self.known.keys())
        data = [s.replace(" ", MARKER).encode("utf-8", "replace") for s in new]
        short = sorted((i for i in range(len(new)) if len(data[i]) <= TOGETHER), key=lambda i: len(data[i]))
        for low in range(0, len(short), 20_000):
            some = short[low : low + 20_000]
            for i, ids in zip(some, segment_many([data[i] for i in some], self.model)):
                self.known[new[i]] = ids
        for i in set(range(len(new))).difference(short):
            self.known[new[i]] = np.array(segment_one(data[i], self.model), np.int32).tobytes()
        known = self.known
        return [b"".join([known[s] for s in part]) for part in cut]


def decode(ids: list[int], model: UnigramModel) -> str:
    """The text of a list of ids; bytes that aren't UTF-8 become U+FFFD."""
    surface = model.surface
    raw = b"".join([surface[i] for i in ids])
    return raw[1 if model.add_dummy_prefix and raw[:1] == b" " else 0 :].decode("utf-8", "replace")


#: Bytes encoded at once in a task; bounds memory, changes no result.
SLICE = 500_000


def _groups(texts: pa.Array):
    """First row and number of rows of stretches of about ``SLICE`` bytes."""
    first, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        size += n
        if size >= SLICE or i == len(texts) - 1:
            yield first, i + 1 - first
            first, size = i + 1, 0


def encode(docs: DataFrame, model: UnigramModel, carried: dict[str, Column], text_col: str = "text", check: bool = True) -> DataFrame:
    """The ``carried`` columns with ``ids`` of every whole text and, with ``check``, whether decoding gives the text back.

    Null texts have null ids and an empty text no ids; both count as given back.
    Spaces and the marker character encode alike, so decoding returns a space
    for a literal marker.
    """
    kept = docs.select(*(c.alias(n) for n, c in carried.items()), F.col(text_col).alias("__text"))
    names = list(carried)

    def run(batches):
        encoder = Encoder(model)
        for batch in batches:
            for first, rows in _groups(batch.column(len(names))):
                some = batch.slice(first, rows)
                texts = some.column(len(names)).to_pylist()
                coded = encoder.encode(texts)
                offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
                flat = np.frombuffer(b"".join(coded), np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(flat), mask=pa.array([t is None for t in texts]))
                columns = [*some.columns[: len(names)], lists]
                if check:
                    same = [t is None or decode(flat[a:b].tolist(), model) == t for t, a, b in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist())]
                    columns.append(pa.array(same, pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "ids", *["round_trip"] * check])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{schema}, ids array<int>" + ", round_trip boolean" * check)


def decode_ids(coded: DataFrame, model: UnigramModel, carried: dict[str, Column], ids_col: str = "ids") -> DataFrame:
    """The ``carried`` columns with the decoded ``text`` of every list of ids; null ids give null."""
    kept = coded.select(*(c.alias(n) for n, c in carried.items()), F.col(ids_col).alias("__ids"))
    names = list(carried)

    def run(batches):
        for batch in batches:
            texts = [None if v is None else decode(v, model) for v in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string())], names=[*names, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{schema}, text string")


def tokenize(docs: DataFrame, model: UnigramModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, round_trip`` of every row; see :func:`encode`.

    Repeated rows are encoded one by one; an empty table gives an empty result;
    other columns are ignored.
    """
    coded = encode(docs, model, {"doc_id": F.col(id_col)}, text_col)
    return coded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "round_trip")
