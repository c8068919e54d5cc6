"""Quality selection by importance resampling over hashed n-gram models.

Two generative models of a bag of hashed n-grams are counted: one of the target (labelled good documents), one of the raw
corpus (every document). A document's log weight is the log-likelihood ratio of the two over its n-grams. Keeping the k
documents with the largest log weight plus Gumbel noise samples without replacement in proportion to the weights; k is the
share of good documents among the labelled ones, times the number of documents. The noise is drawn from the document's id and
the seed, so a task that runs again draws the same.

n-grams: one and two consecutive tokens, a token being a run of letters, digits and non-ASCII bytes (lower-cased) or a run of
punctuation; and one and two consecutive token shapes (kind, capitals, digits, length of punctuation, repeats the token of the
same kind before it), which see shouting, symbol noise and repetition whatever the words.

Toxicity sits in single words, which a sum over a document's length drowns. So it is judged apart, word by word: of the labelled
documents that hold a word, the share of toxic ones has a beta posterior, and a word is toxic if its lower bound exceeds one half. A
document with such a word has no part in the target: its weight is minus infinity. Copies are no evidence of their own, or every word of a
toxic document with many of them would be toxic: documents that agree in the least hash of their five-word sequences, as near copies do
with the probability of their similarity, count once for each label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .minhash import shingle_sets
from .shared import keep, prepare

#: Buckets for words and word pairs (each), and for shapes and shape pairs (each).
BUCKETS, SHAPES = 1 << 15, 1 << 12
#: Labelled good documents the target model is fitted on at most: those with the least hashed ids.
LABELLED = 20_000
#: Buckets for the words of the toxicity judgement, the weight of its prior in documents, and the bound's deviations.
WORDS, PRIOR, DEVIATIONS = 1 << 20, 2.0, 1.645
_PIECE = 1 << 20
#: What the noise of rows with a null id is drawn from.
_NULL = -(1 << 63)
_KIND = np.full(256, 2, np.uint8)
_KIND[[48 + i for i in range(10)] + [65 + i for i in range(26)] + [97 + i for i in range(26)] + list(range(128, 256))] = 1
_KIND[tk.BLANK] = 0
_UPPER, _DIGIT = np.zeros(256, np.int64), np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT[48:58] = 1


def _runs(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, kinds and document cuts of the tokens."""
    kind = _KIND[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    edges = np.flatnonzero(change)
    start, end = edges[:-1], edges[1:]
    solid = kind[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[solid], end[solid]
    return start, end, kind[start], np.searchsorted(start, offsets)


def features(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all documents and each feature's document (by position)."""
    start, end, kind, first = _runs(offsets, data)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    low = tk.LOWER[data]
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, tk.U64)
        np.cumsum(tk._BYTES[low] * tk.powers(tk.BYTE_BASE, len(data))[: len(data)], dtype=tk.U64, out=total[1:])
        token = tk.mix((total[end] - total[start]) * tk.powers(tk.inverse(tk.BYTE_BASE), len(data))[start])
        pair = tk.mix(token[:-1] * tk.U64(3) + token[1:])
    count = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data])])[np.stack([start, end])], axis=0)[0]
    capitals, digits, size = count(_UPPER), count(_DIGIT), end - start
    again = np.zeros(len(token), bool)
    for k in (1, 2):
        of = np.flatnonzero(kind == k)
        again[of[1:]] = (token[of[1:]] == token[of[:-1]]) & (doc[of[1:]] == doc[of[:-1]])
    case = np.where(capitals == 0, 0, np.where(capitals == 1, 1, np.where(capitals == size, 3, 2)))
    shape = ((np.where(kind == 1, np.minimum(size, 15) // 4, 4 + np.minimum(size, 4) - 1) * 4 + case) * 2 + (digits > 0)) * 2 + again
    pairs = doc[1:] == doc[:-1]
    parts = [
        (token % tk.U64(BUCKETS)).astype(np.int64), BUCKETS + (pair % tk.U64(BUCKETS)).astype(np.int64)[pairs],
        2 * BUCKETS + shape, 2 * BUCKETS + SHAPES + ((shape[:-1] * 128 + shape[1:]) % SHAPES)[pairs],
    ]
    return np.concatenate(parts), np.concatenate([doc, doc[:-1][pairs], doc, doc[:-1][pairs]])


FAMILIES = np.array([0, BUCKETS, 2 * BUCKETS, 2 * BUCKETS + SHAPES, 2 * BUCKETS + 2 * SHAPES])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ma.MaskedArray, np.ndarray, np.ndarray]]:
    """The first column's numbers, masked where they are null, and the texts, about _PIECE bytes at a time."""
    for batch in batches:
        offsets, data = tk.buffers(batch.column(1))
        column = batch.column(0)
        ids = np.ma.array(column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), mask=column.is_null().to_numpy(zero_copy_only=False))
        for a, b in tk.slices(offsets, _PIECE):
            yield ids[a:b], offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all documents, each once for a document, and each word's document (by position)."""
    start, end, kind, first = _runs(offsets, data)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[kind == 1]
    start, end, low = start[kind == 1], end[kind == 1], tk.LOWER[data]
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, tk.U64)
        np.cumsum(tk._BYTES[low] * tk.powers(tk.BYTE_BASE, len(data))[: len(data)], dtype=tk.U64, out=total[1:])
        token = tk.mix((total[end] - total[start]) * tk.powers(tk.inverse(tk.BYTE_BASE), max(len(data), 1))[start])
    each = np.unique(doc * WORDS + (token % tk.U64(WORDS)).astype(np.int64))
    return each % WORDS, each // WORDS


def toxic_words(docs: DataFrame, known: DataFrame, labelled: int) -> np.ndarray:
    """The numbers of the toxic words, ascending. known: (doc_id, toxic), of which at most 2 * ``labelled`` are read: those with the least
    hashed ids, whatever their label, so that toxic ones have the same share among them as among all. The driver gets one row
    for each word that a toxic document holds."""
    some = known.where(F.col("toxic").isin(0, 1)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * labelled)
    marked = docs.join(F.broadcast(some), "doc_id").select("doc_id", "toxic", "text")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = tk.buffers(batch.column(2))
            for a, b in tk.slices(offsets, _PIECE):
                values, cuts = shingle_sets(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]], 5)
                full = np.flatnonzero(np.diff(cuts))
                part = batch.slice(a, b - a).take(pa.array(full))
                yield pa.RecordBatch.from_arrays([pa.array(values[cuts[full]].view(np.int64)), *part.columns], names=["class", "doc_id", "toxic", "text"])

    classes = marked.mapInArrow(place, "class long, doc_id long, toxic long, text string")
    marked = classes.groupBy("class", "toxic").agg(F.min_by("text", "doc_id").alias("text")).select("toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, seen = np.zeros((2, WORDS), np.int64), np.zeros(2, np.int64)
        for toxic, offsets, data in _pieces(batches):
            (word, doc), toxic = words(offsets, data), toxic.filled(-1)
            for t in (0, 1):
                totals[t] += np.bincount(word[toxic[doc] == t], minlength=WORDS)
                seen[t] += np.count_nonzero(toxic == t)
        held = np.flatnonzero(totals.any(axis=0))
        columns = [np.append(held, -1), np.append(totals[0][held], seen[0]), np.append(totals[1][held], seen[1])]
        yield from tk.rebatch(iter([pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["word", "fine", "toxic"])]))

    counted = marked.mapInArrow(count, "word long, fine long, toxic long").groupBy("word").agg(F.sum("fine").alias("fine"), F.sum("toxic").alias("toxic")).where("toxic > 0")
    rows = np.array([(r["word"], r["fine"], r["toxic"]) for r in counted.collect()], np.int64).reshape(-1, 3)
    whole = rows[rows[:, 0] < 0][:, 1:].sum(axis=0)
    rows = rows[rows[:, 0] >= 0]
    if not len(rows):
        return np.zeros(0, np.int64)
    base = whole[1] / whole.sum()
    a, b = rows[:, 2] + PRIOR * base, rows[:, 1] + PRIOR * (1 - base)
    bound = a / (a + b) - DEVIATIONS * np.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    return np.sort(rows[bound > 0.5, 0])


def log_ratio(docs: DataFrame, good_ids: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """The log ratio of both models for every feature. docs: (doc_id, text). The driver gets one row for each feature."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(good_ids))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, FAMILIES[-1]), np.int64)
        for ids, offsets, data in _pieces(batches):
            feature, doc = features(offsets, data)
            good = np.isin(ids.data, shared.value) & ~ids.mask
            totals[0] += np.bincount(feature, minlength=FAMILIES[-1])
            totals[1] += np.bincount(feature[good[doc]], minlength=FAMILIES[-1])
        some = np.flatnonzero(totals[0])
        yield from tk.rebatch(iter([pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[0][some]), pa.array(totals[1][some])], names=["feature", "raw", "target"])]))

    raw, target = np.zeros(FAMILIES[-1]), np.zeros(FAMILIES[-1])
    for r in docs.mapInArrow(count, "feature long, raw long, target long").groupBy("feature").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r["feature"]], target[r["feature"]] = r["raw"], r["target"]
    out = np.zeros(FAMILIES[-1])
    for a, b in zip(FAMILIES, FAMILIES[1:]):
        t, r = target[a:b] + alpha, raw[a:b] + alpha
        out[a:b] = np.log(t / t.sum()) - np.log(r / r.sum())
    return out


def _weigh(ids: np.ma.MaskedArray, offsets: np.ndarray, data: np.ndarray, ratio: np.ndarray, toxic: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    feature, doc = features(offsets, data)
    weight = np.bincount(doc, ratio[feature], len(ids)) if len(doc) else np.zeros(len(ids))
    if len(toxic):
        word, doc = words(offsets, data)
        weight[doc[toxic[np.searchsorted(toxic, word) % len(toxic)] == word]] = -np.inf
    uniform = ((tk.mix(ids.filled(_NULL).view(tk.U64) ^ tk.mix(np.array([seed], tk.U64))) >> tk.U64(11)).astype(float) + 0.5) / (1 << 53)
    return weight, weight - np.log(-np.log(uniform))


def log_weights(docs: DataFrame, ratio: np.ndarray, toxic: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, log_weight, score): score is the weight with its Gumbel noise."""
    shared = docs.sparkSession.sparkContext.broadcast((ratio, toxic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights, scores = [], []
            for ids, offsets, data in _pieces(iter([batch])):
                weight, score = _weigh(ids, offsets, data, *shared.value, seed)
                weights.append(weight)
                scores.append(score)
            if weights:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(weights)), pa.array(np.concatenate(scores))], names=["doc_id", "log_weight", "score"])

    return docs.mapInArrow(run, "doc_id long, log_weight double, score double")


def kth_largest(scores: DataFrame, k: int, column: str = "score", few: int = 10_000) -> float:
    """The exact k-th largest value, by histograms that close in on it until at most ``few`` rows are left, or a range that holds no more than
    some hundred different numbers; their counts reach the driver."""
    low, high, n = scores.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k <= 0:
        return float("inf")
    if k >= n:
        return float(low)
    above = 0  # rows over high
    while True:
        inside = scores.where(F.col(column).between(low, high))
        step = (high - low) / 1000
        if n <= few or not low + step > low:
            for value, count in sorted(map(tuple, inside.groupBy(column).count().collect()), reverse=True):
                above += count
                if above >= k:
                    break
            return float(value)
        bins = inside.groupBy(F.least(F.floor((F.col(column) - low) / step), F.lit(999)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect()
        for r in sorted(bins, key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                low, high, n = r["a"], r["b"], r["n"]
                break
            above += r["n"]
        if low == high:
            return float(low)


def _model(docs: DataFrame, labels: DataFrame, share: float | None, seed: int, labelled: int) -> tuple[DataFrame, np.ndarray, np.ndarray, float]:
    """The scores of docs (doc_id, text), the features' log ratios, the toxic words, and the least score that is kept."""
    known, toxic = labels.where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.min("good").alias("good")), np.zeros(0, np.int64)
    if "toxic" in labels.columns:
        flags = keep(labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("long")).alias("toxic")), "toxic")
        toxic = toxic_words(docs, flags, labelled)
        known = known.join(flags.where("toxic = 1"), "doc_id", "left_anti")
    if share is None:
        found = known.agg(F.avg(F.col("good").cast("double"))).first()[0]
        share = 1.0 if found is None else float(found)
    picked = known.where("good = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).collect()
    good = np.array([r[0] for r in picked], np.int64)
    ratio = log_ratio(docs, good) if len(good) else np.zeros(FAMILIES[-1])
    scores = keep(log_weights(docs, ratio, toxic, seed), "scores")
    among = scores.where(F.col("score") > F.lit(float("-inf")))
    return scores, ratio, toxic, kth_largest(among, round(share * among.count()))


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def select_by_importance(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 7, labelled: int = LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, log_weight, score, kept.

    ``labels`` holds (doc_id, good) with good 0 or 1 (nulls don't count; an id is good if all its labels are). ``share`` of the
    documents is kept, the labels' share of good documents if not given; exactly round(share * rows), but for documents whose score ties
    with the last one kept, which stay as well. Null and empty texts have log weight 0. Without good labels every weight is
    0 and the sample is uniform; without any label everything is kept. With a column ``toxic`` (0 or 1; an id is toxic if one of its
    labels is) toxic documents count neither as good nor in the share, and documents with a toxic word, whose weight and
    score are minus infinity, are never kept; rows are then those without one. Rows with a null id share one draw of noise. An empty
    table gives an empty result. Other columns play no part.
    """
    prepare(docs.sparkSession)
    scores, _, _, cut = _model(_plain(docs, id_col, text_col), labels, share, seed, labelled)
    return scores.withColumn("kept", F.col("score") >= F.lit(cut))


def filter_by_importance(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 7, labelled: int = LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``select_by_importance`` keeps, all columns as they are. Rows are scored where they stand a
    second time, so no text is shuffled."""
    prepare(docs.sparkSession)
    _, ratio, toxic, cut = _model(_plain(docs, id_col, text_col), labels, share, seed, labelled)
    shared, names = docs.sparkSession.sparkContext.broadcast((ratio, toxic)), docs.columns
    at, text = names.index(id_col), names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score for piece in _pieces(iter([pa.RecordBatch.from_arrays([batch.column(at).cast(pa.int64()), batch.column(text).cast(pa.string())], names=["doc_id", "text"])])) for score in _weigh(*piece, *shared.value, seed)[1]]
            yield batch.filter(pa.array(np.array(scores) >= cut)) if scores else batch

    return docs.mapInArrow(run, docs.schema)
