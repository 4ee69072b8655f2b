"""Document quality from a linear-chain CRF over lines.

Every line gets format features of itself and of its two neighbours; the CRF
labels it good or bad in the context of the whole document. The probabilities
of the good label (forward-backward marginals), weighted by line length, average
to one figure a document, which a logistic curve turns into a score.

Learning takes a bounded sample of labelled documents (``SAMPLE_DOCS``), chosen
by a hash of the id; every line of it takes its document's label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storylake.llm import crf
from storylake.llm.boosting import _sigmoid, platt
from storylake.llm.common import crc_bucket

#: Bound of the sample to learn from: at most so many documents, of at most so many characters.
SAMPLE_DOCS, SAMPLE_CHARS = 3_000, 20_000
THRESHOLD = 0.3
#: Bytes worked on at once in a task; bounds memory, changes no result.
SLICE = 1_500_000

# Byte classes: 0 other, 1 a-z, 2 A-Z, 3 digits, 4 white space, 5 sentence marks, 6 ! and ?, 7 bars, 8 other ASCII marks, 9 beyond ASCII, 10 line end.
_CLASS = np.zeros(256, np.uint8)
for _chars, _kind in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (" \t\r\v\f", 4), (".,;:'\"()-", 5), ("!?", 6), ("|", 7), ("#$%&*+/<=>@[\\]^_`{}~", 8), ("\n", 10)):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _kind
_CLASS[128:] = 9
N_OWN = 19


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, bytes of every line, lines of every text); lines end at ``\\n``."""
    data = np.frombuffer(("\n".join(texts) + "\n").encode("utf-8", "replace"), np.uint8)
    kind = _CLASS[data]
    ends = np.flatnonzero(kind == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    lines = np.array([t.count("\n") + 1 for t in texts])
    size = ends - starts
    share = 1.0 / np.maximum(size, 1)
    counts = [np.add.reduceat(kind == k, starts, dtype=np.int64) for k in range(1, 10)]
    # words: runs without white space; a word's hash sums its bytes times odd numbers by place
    solid = (kind != 4) & (kind != 10)
    before = np.concatenate([[False], solid[:-1]])
    word_start = np.flatnonzero(solid & ~before)
    word_end = np.flatnonzero(~solid & before)
    place = np.arange(len(data), dtype=np.uint32)
    if len(word_start):
        place -= word_start.astype(np.uint32)[np.maximum(np.cumsum(solid & ~before) - 1, 0)]
    mixed = (data.astype(np.uint64) + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)) * solid
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
    hashed = total[word_end] - total[word_start]
    line_of = np.searchsorted(ends, word_start)
    words = np.bincount(line_of, minlength=len(ends))
    again = np.zeros(len(hashed), bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (line_of[1:] == line_of[:-1])
    caps = np.zeros(len(hashed), bool)
    if len(hashed):
        caps = kind[word_start] == 2
    per_word = 1.0 / np.maximum(words, 1)
    mean_word = np.bincount(line_of, word_end - word_start, len(ends)) * per_word
    last = kind[np.maximum(ends - 1, 0)]
    # equal lines of one text, by a hash of the line
    whole = (total[ends] - total[starts]) * np.uint64(0xD1B54A32D192ED03) + size.astype(np.uint64)
    key = whole + np.repeat(np.arange(len(texts)), lines).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    own = np.stack(
        [
            *(c * share for c in counts),
            np.log1p(size) / 6,
            np.log1p(words) / 5,
            np.minimum(mean_word, 30) / 10,
            np.bincount(line_of, again, len(ends)) * per_word,
            np.bincount(line_of, caps, len(ends)) * per_word,
            (last == 5) * 1.0,
            (size == 0) * 1.0,
            ((times[where] > 1) & (size > 0)) * 1.0,
            (counts[7] + counts[6]) * per_word,
            counts[5] * per_word,
        ],
        axis=1,
    ).astype(np.float32)
    return own, size, lines


def with_neighbours(own: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the line before and after it in its text (zeros at the ends)."""
    ends = np.cumsum(lines)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[(ends - lines)[lines > 0]] = 0
    after[ends[lines > 0] - 1] = 0
    return np.concatenate([own, before, after], axis=1)


@dataclass(frozen=True)
class QualityModel:
    chain: crf.ChainModel
    mean: np.ndarray
    scale: np.ndarray
    curve: tuple[float, float]
    prior: float


def _document_means(chain, x, sizes, lines):
    """Length-weighted mean of the lines' good probabilities, a text; texts without characters give NaN."""
    good = crf.marginals(x @ chain.weights + chain.bias, lines, chain.transition)
    of = np.repeat(np.arange(len(lines)), lines)
    weight = np.bincount(of, sizes, len(lines))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(of, good * sizes, len(lines)) / weight


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def learn(texts: list[str], labels: np.ndarray) -> QualityModel | None:
    """Fit the CRF and the score curve; None without documents of both labels."""
    if not texts or labels.min() == labels.max():
        return None
    own, sizes, lines = line_features(texts)
    x = with_neighbours(own, lines).astype(np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / scale
    y = np.repeat(labels, lines)
    balance = np.where(y == 1, 0.5 / max(1e-3, y.mean()), 0.5 / max(1e-3, 1 - y.mean())) * np.minimum(1.0, sizes / 20 + 0.05)
    chain = crf.fit(x, y, lines, balance)
    means = _document_means(chain, x, sizes, lines)
    some = np.isfinite(means)
    curve = platt(_logit(means[some]), labels[some].astype(float))
    return QualityModel(chain, mean, scale, curve, float(labels.mean()))


def scores(texts: list[str | None], model: QualityModel | None) -> np.ndarray:
    """Scores of whole texts; texts without characters, and all without a model, score the share of good labels (or 0.5)."""
    result = np.full(len(texts), model.prior if model else 0.5)
    if model is None:
        return result
    part, size = [], 0
    for i, text in enumerate(texts):
        if text:
            part.append(i)
            size += len(text)
        if part and (size >= SLICE or i == len(texts) - 1):
            own, sizes, lines = line_features([texts[j] for j in part])
            x = (with_neighbours(own, lines) - model.mean) / model.scale
            means = _document_means(model.chain, x, sizes, lines)
            score = _sigmoid(model.curve[0] * _logit(means) + model.curve[1])
            result[part] = np.where(np.isfinite(means), score, model.prior)
            part, size = [], 0
    return result


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(crc_bucket(doc_id, 5) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel | None:
    """Learn from labelled rows that are not held out.

    The sample is drawn from the labels by a hash of the id, so it is bounded
    and its ids can be broadcast; documents are read once. Repeated labels of
    one id count by their largest, and of several texts under one id the least
    is learned from, so rows repeated under one id add nothing.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    n = usable.count()
    if not n:
        return None
    place = lambda doc_id: F.pmod(F.xxhash64(doc_id.cast("string"), F.lit("quality")), F.lit(1_000_000))
    drawn = usable.where(place(F.col(id_col)) < int(1_000_000 * min(1.0, SAMPLE_DOCS / n))).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__label"))
    drawn = drawn.orderBy(place(F.col("__id")), "__id").limit(SAMPLE_DOCS)
    small = docs.where(F.length(text_col) <= SAMPLE_CHARS).select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))
    found = small.join(F.broadcast(drawn), F.col("__doc") == F.col("__id")).groupBy("__doc").agg(F.min("__text").alias("__text"), F.max("__label").alias("__label"))
    rows = sorted(found.collect(), key=lambda r: r["__doc"])
    return learn([r["__text"] for r in rows], np.array([int(r["__label"] == 1) for r in rows]))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Score every whole text.

    Returns one row per input row: ``doc_id, held_out, score, predicted``
    (1 from ``THRESHOLD`` on). Only the text decides a score. Null and empty
    texts score the share of good labels learned from; without labels of both
    kinds every text scores 0.5. Rows with a null id are not held out. Repeated
    rows score alike; an empty table gives an empty result; other columns are
    ignored.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    kept = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("__text"))

    def run(batches):
        for batch in batches:
            found = scores(batch.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
