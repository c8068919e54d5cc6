"""Substring deduplication: words of a document that lie in a long passage which an earlier document has too.

Fixed-block anchors. Every document is cut into non-overlapping blocks of half a window; any window of the asked length holds
at least one whole block of the document it comes from. The block hashes are the index; every rolling half-window of every
document probes it. A hit marks a place where a repeat can be; around the hits all full windows are compared, and runs of equal
windows are the maximal exact repeats. No pair of documents is ever made, so a passage that thousands share costs its
occurrences, not their square. Windows are equal if a 64-bit hash and the bucket of a second, independent one agree, that is 64 bits and the
logarithm of the number of buckets, which grows with the input: of w windows compared, at most about w * 4e-14 are expected to agree with
another by chance (a twelfth of one window in a 100 TB corpus of which an eighth is compared).

Layout. Documents are gathered into slices of about 1 MB, compressed, and written once to the shared folder; a slice sends each
distinct hash of its own once to the hash's bucket (pre-aggregation: a hash that occurs everywhere reaches its bucket once a
slice) and gets one bit back for it. Buckets grow in number with the input, so that a task holds a bounded part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import keep, prepare, width

#: Bytes of text in a slice, and words whose hashes a bucket takes on the average.
SLICE, BUCKET_WORDS = 5 << 18, 1_500_000
SLICES = "slice_id long, n_words long, doc_ids binary, offsets binary, texts binary"


def slice_documents(docs: DataFrame, id_col: str, text_col: str, slice_bytes: int = SLICE) -> DataFrame:
    """Documents (null ids out) in slices: ids, offsets and the compressed bytes of their texts, in a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        squeeze = zstandard.ZstdCompressor(level=3).compress
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def row() -> pa.RecordBatch:
            nonlocal number, size
            ids, data = np.concatenate([h[0] for h in held]), np.concatenate([h[2] for h in held])
            offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(h[1]) for h in held]))])
            inside = ~tk.BLANK[data]
            words = int(np.count_nonzero(inside[1:] & ~inside[:-1])) + len(ids)  # an estimate: it only sets the number of buckets
            out = pa.RecordBatch.from_arrays([pa.array([x]) for x in (number, words)] + [pa.array([x], pa.binary()) for x in (ids.tobytes(), offsets.tobytes(), squeeze(data.tobytes()))], names=["slice_id", "n_words", "doc_ids", "offsets", "texts"])
            number += 1
            size = 0
            held.clear()
            return out

        for batch in batches:
            offsets, data = tk.buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in tk.slices(offsets, slice_bytes):
                part = offsets[b] - offsets[a]
                if held and size + part > slice_bytes:
                    yield row()
                held.append((ids[a:b], offsets[a : b + 1], data[offsets[a] : offsets[b]]))
                size += int(part)
        if held:
            yield row()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null").mapInArrow(run, SLICES)


class _Slice:
    """One slice, unpacked: its words, and where a window or half-window of a long enough document can start."""

    def __init__(self, row: dict, window: int):
        self.ids = np.frombuffer(row["doc_ids"], np.int64)
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=int(self.offsets[-1]) + 1), np.uint8)
        self.words, self.window, self.half = tk.Words(self.offsets, self.data), window, window // 2
        self.total = len(self.words.start)
        self.hashes = self.words.hashes()
        self.doc = np.repeat(np.arange(len(self.ids)), self.words.count())

    def anchors(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the half-windows in documents of at least a window, their buckets and keys, and which are blocks."""
        starts = np.flatnonzero(tk.window_starts(self.words.first, self.half, self.total))
        starts = starts[self.words.count()[self.doc[starts]] >= self.window]
        value = tk.windows(self.hashes, self.half)[starts]
        block = (starts - self.words.first[self.doc[starts]]) % self.half == 0
        return starts, ((value >> tk.U64(32)) % tk.U64(buckets)).astype(np.int64), value.astype(np.uint32), block

    def candidates(self, starts: np.ndarray, hit: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the full windows that hold a half-window hit, their buckets and 64-bit keys."""
        near = np.zeros(self.total + 1, np.int64)
        at = starts[hit]
        np.add.at(near, np.maximum(at - (self.window - self.half), 0), 1)
        np.add.at(near, at + 1, -1)
        m = max(self.total - self.window + 1, 0)
        full = np.flatnonzero((np.cumsum(near)[:m] > 0) & tk.window_starts(self.words.first, self.window, self.total))
        if not len(full):
            return full, full, np.zeros(0, tk.U64)
        with np.errstate(over="ignore"):
            other = tk.windows(tk.mix(self.hashes ^ tk.U64(tk.OTHER_BASE)), self.window, tk.OTHER_BASE)[full]
        return full, (other % tk.U64(buckets)).astype(np.int64), tk.windows(self.hashes, self.window)[full]


def _by_bucket(bucket: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (bucket, key) in order: the first row of each, rows sorted by them, and each bucket with its range."""
    order = np.lexsort((key, bucket))
    b, k = bucket[order], key[order]
    new = np.ones(len(order), bool)
    new[1:] = (b[1:] != b[:-1]) | (k[1:] != k[:-1])
    first = np.flatnonzero(new)
    return order, first, b[first], k[first]


def _cuts(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]) if len(values) else np.zeros(1, np.int64)


def _bits(row: dict, replies: str, distinct: np.ndarray) -> np.ndarray:
    """The answers of all buckets to a slice's distinct keys, in the order in which it asked. distinct: their buckets."""
    out = np.zeros(len(distinct), bool)
    for x in row[replies] or ():
        a, b = np.searchsorted(distinct, [x["bucket"], x["bucket"] + 1])
        out[a:b] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a).astype(bool)
    return out


def _anchor_hits(s: _Slice, row: dict, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    starts, bucket, key, _ = s.anchors(buckets)
    order, first, distinct, _ = _by_bucket(bucket, key)
    hit = np.zeros(len(starts), bool)
    hit[order] = np.repeat(_bits(row, "anchored", distinct), np.diff(np.append(first, len(order))))
    return starts, hit


def _asked(slices: DataFrame, make, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from make(batch.slice(i, 1).to_pylist()[0])

    return slices.mapInArrow(run, schema)


def _answered(asked: DataFrame, answer, parts: int) -> DataFrame:
    """Replies by slice: (slice_id, replies array<struct<bucket, bits>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in tk.groups(batches, "bucket"):
            bits = answer(rows.to_pylist())
            ids = rows.column("slice_id").to_pylist()
            some = [i for i, b in enumerate(bits) if b is not None]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in some]), pa.array([bucket] * len(some)), pa.array([bits[i] for i in some], pa.binary())], names=["slice_id", "bucket", "bits"])

    found = asked.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "slice_id long, bucket long, bits binary")
    return found.groupBy("slice_id").agg(F.collect_list(F.struct("bucket", "bits")).alias("replies"))


def _answer_anchors(rows: list[dict]) -> list[bytes | None]:
    """A key counts if it is a block somewhere and occurs at two places at least."""
    keys = [np.frombuffer(r["keys"], np.uint32) for r in rows]
    flags = [np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=2 * len(k)).astype(bool) for r, k in zip(rows, keys)]
    key = np.concatenate(keys)
    block, twice = np.concatenate([f[: len(f) // 2] for f in flags]), np.concatenate([f[len(f) // 2 :] for f in flags])
    order = np.argsort(key, kind="stable")
    k = key[order]
    start = _cuts(k)[:-1]
    good = np.logical_or.reduceat(block[order], start) & (np.logical_or.reduceat(twice[order], start) | (np.diff(np.append(start, len(k))) > 1))
    hit = np.zeros(len(key), bool)
    hit[order] = np.repeat(good, np.diff(np.append(start, len(k))))
    out, a = [], 0
    for x in keys:
        part = hit[a : a + len(x)]
        out.append(np.packbits(part).tobytes() if part.any() else None)
        a += len(x)
    return out


def _answer_windows(rows: list[dict]) -> list[bytes | None]:
    """A key counts for a slice if a smaller document than the slice's least with that key has it too."""
    keys = [np.frombuffer(r["keys"], np.uint64) for r in rows]
    least = np.concatenate([np.frombuffer(r["least"], np.int64) for r in rows])
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    start = _cuts(key[order])[:-1]
    whole = np.minimum.reduceat(least[order], start)
    earlier = np.zeros(len(key), bool)
    earlier[order] = np.repeat(whole, np.diff(np.append(start, len(key)))) < least[order]
    out, a = [], 0
    for x in keys:
        part = earlier[a : a + len(x)]
        out.append(np.packbits(part).tobytes() if part.any() else None)
        a += len(x)
    return out


def _window_rows(s: _Slice, full: np.ndarray, bucket: np.ndarray, key: np.ndarray):
    order, first, distinct, keys = _by_bucket(bucket, key)
    least = np.minimum.reduceat(s.ids[s.doc[full[order]]], first) if len(first) else np.zeros(0, np.int64)
    return order, first, distinct, keys, least


#: Shuffle partitions at most, whatever the number of buckets.
TASKS = 20_000


def dedup_substrings(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Remove each word covered by a ``window``-word sequence that also starts in a document with a smaller id.

    Words are runs of anything but ASCII white space; windows are judged on the input, so what is removed still counts as
    evidence. Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and, with
    ``with_text``, that kept text. A null text has no words; documents shorter than the window lose nothing; rows with a null
    id are left out; repeated rows of one id are one document as evidence (none is earlier than the other), each with its
    own result row. Other columns of ``docs`` play no part.
    """
    if window < 2:
        raise ValueError("window must be 2 words at least")
    spark = prepare(docs.sparkSession)
    slices = keep(slice_documents(docs, id_col, text_col), "slices")
    buckets = max(1, -(-int(slices.agg(F.sum("n_words")).first()[0] or 0) // BUCKET_WORDS))
    parts = max(width(spark), min(TASKS, buckets))  # beyond, a task takes several buckets, one after the other

    def ask_anchors(row: dict) -> Iterator[pa.RecordBatch]:
        _, bucket, key, block = _Slice(row, window).anchors(buckets)
        order, first, distinct, keys = _by_bucket(bucket, key)
        if not len(first):
            return
        is_block, twice = np.logical_or.reduceat(block[order], first), np.diff(np.append(first, len(order))) > 1
        cuts = _cuts(distinct)
        flags = [np.packbits(np.concatenate([is_block[a:b], twice[a:b]])).tobytes() for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(distinct[cuts[:-1]]), pa.array(np.full(len(cuts) - 1, row["slice_id"])), tk.ragged(keys, cuts), pa.array(flags, pa.binary())], names=["bucket", "slice_id", "keys", "flags"])

    anchored = keep(_answered(_asked(slices, ask_anchors, "bucket long, slice_id long, keys binary, flags binary"), _answer_anchors, parts), "anchored").withColumnRenamed("replies", "anchored")

    def ask_windows(row: dict) -> Iterator[pa.RecordBatch]:
        s = _Slice(row, window)
        full, bucket, key = s.candidates(*_anchor_hits(s, row, buckets), buckets)
        _, _, distinct, keys, least = _window_rows(s, full, bucket, key)
        if not len(keys):
            return
        cuts = _cuts(distinct)
        yield pa.RecordBatch.from_arrays([pa.array(distinct[cuts[:-1]]), pa.array(np.full(len(cuts) - 1, row["slice_id"])), tk.ragged(keys, cuts), tk.ragged(least, cuts)], names=["bucket", "slice_id", "keys", "least"])

    hit = slices.join(anchored, "slice_id")
    repeated = keep(_answered(_asked(hit, ask_windows, "bucket long, slice_id long, keys binary, least binary"), _answer_windows, parts), "repeated").withColumnRenamed("replies", "repeated")

    def finish(row: dict) -> Iterator[pa.RecordBatch]:
        s = _Slice(row, window)
        gone = np.zeros(s.total, bool)
        if row["anchored"]:
            full, bucket, key = s.candidates(*_anchor_hits(s, row, buckets), buckets)
            order, first, distinct, _, least = _window_rows(s, full, bucket, key)
            size = np.diff(np.append(first, len(order)))
            # an earlier slice document has the window, or an earlier document of this slice
            drop = np.repeat(_bits(row, "repeated", distinct), size) | (s.ids[s.doc[full[order]]] > np.repeat(least, size))
            cover = np.zeros(s.total + 1, np.int64)
            np.add.at(cover, full[order][drop], 1)
            np.add.at(cover, full[order][drop] + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), s.words.first[:-1])
        removed[s.words.count() == 0] = 0
        raw = s.data.tobytes()
        texts = []
        for i, (a, b) in enumerate(zip(s.offsets.tolist(), s.offsets[1:].tolist())):
            words = raw[a:b].split()
            if removed[i]:
                words = [w for w, x in zip(words, gone[s.words.first[i] : s.words.first[i + 1]].tolist()) if not x]
            texts.append(b" ".join(words))
        columns = [pa.array(s.ids), pa.array(s.words.count().astype(np.int64)), pa.array(removed), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
        out = pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.binary()).cast(pa.string())] * with_text, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)
        yield from tk.rebatch(iter([out]), 2000)

    whole = slices.join(anchored, "slice_id", "left").join(repeated, "slice_id", "left")
    return _asked(whole, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


#: The same in DuckDB's SQL, for windows of 50 words.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
k AS MATERIALIZED (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS k FROM x),
f AS (SELECT k, min(doc_id) AS f FROM k GROUP BY k),
c AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM k JOIN f ON f.k = k.k WHERE f < doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
t AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.j) AS kept FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.j = p.j WHERE c.j IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_removed, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
