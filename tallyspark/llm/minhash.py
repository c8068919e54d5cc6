"""MinHash near-deduplication with circulant signatures and exact verification.

Signatures. A document is the set of its distinct word shingles, hashed. A first permutation scatters the set over a ring of
2**20 places; a second permutation of the ring, shifted by k places, gives the k-th signature coordinate as the least value
over the set. The coordinates of all shifts of one place are neighbours in memory, so a signature is the minimum of one
contiguous stretch per shingle.

Candidates. Signatures are cut into bands; documents that share a band are candidates. Documents with equal sets are one class
before that. In the first round every document of a band's bucket is verified against the least document of the bucket: a
bucket of any size makes as many pairs as it has members. In the second round, only buckets that still hold documents of
different components are taken up again: members of different components whose signatures agree in enough coordinates
(``sketch``; so low that a pair at the threshold fails it about as seldom as it misses all bands) are verified. Large buckets are
cut into chunks for that, which tasks read two by two from the shared folder, and what is left to verify goes out as requests of one
document against a block of others, not as pairs. Documents of one component need no more comparison.

Verification counts shingles on the full sets, by their 64-bit hashes; no link between different sets rests on signatures. Sets count as equal if
their sizes and two independent 64-bit sums agree (chance agreement of any two of n sets: n**2 / 2**129).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .graph import components
from .shared import drop, keep, new_folder, prepare, read_part, width

RING = 1 << 20
BANDS, ROWS = 30, 5
#: Share of signature coordinates that two documents must agree in to be compared in the second round; bucket members a task holds.
SKETCH, CHUNK = 0.65, 1024
#: Requests to a block that a task answers.
PROBES = 4096
#: Shuffle partitions at most, whatever the number of blocks; beyond, a task takes several, one after the other.
TASKS = 20_000
#: Shingles in a block of documents that requests are verified against, on the average.
_BLOCK_SHINGLES = 4_000_000
#: Bytes of text worked on at once.
_PIECE = 1 << 20
_SALTS = (tk.U64(0x2545F4914F6CDD1D), tk.U64(0x9E6C63D0876A9A47))


def shingle_sets(offsets: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, and the cuts between documents.

    A document of fewer words than k, but not none, is one shingle."""
    words = tk.Words(offsets, data, lower=True)
    hashes, n = words.hashes(), words.count()
    starts = np.flatnonzero(tk.window_starts(words.first, k, len(hashes)))
    doc = np.repeat(np.arange(len(n)), n)[starts]
    value = tk.windows(hashes, k)[starts]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        doc = np.concatenate([doc, short])
        value = np.concatenate([value, tk.sequence_hash(hashes, words.first)[short]])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


class Circulant:
    """Signatures of ``size`` coordinates from one permutation of the ring and its shifts."""

    def __init__(self, size: int):
        permutation = np.random.Generator(np.random.PCG64(77)).permutation(RING).astype(np.uint32)
        self.size = size
        self.shifts = np.lib.stride_tricks.sliding_window_view(np.concatenate([permutation[RING - size + 1 :], permutation]), size)

    def signatures(self, values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """One row for each set; an empty set has all coordinates at their largest."""
        out = np.full((len(cuts) - 1, self.size), np.iinfo(np.uint32).max, np.uint32)
        place = (values >> tk.U64(44)).astype(np.int64)
        full = np.flatnonzero(np.diff(cuts))
        for a, b in tk.slices(cuts, 4096):
            own = full[np.searchsorted(full, a) : np.searchsorted(full, b)]
            if not len(own):
                continue
            if b - a == 1:
                for i in range(cuts[a], cuts[b], 4096):
                    np.minimum(out[a], self.shifts[place[i : min(i + 4096, cuts[b])]].min(axis=0), out=out[a])
            else:
                out[own] = np.minimum.reduceat(self.shifts[place[cuts[a] : cuts[b]]], cuts[own] - cuts[a], axis=0)
        return out


def _sketches(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring = Circulant(bands * rows)
        weights = tk.powers(tk.WORD_BASE, rows + 1)[1 : rows + 1]
        for batch in batches:
            offsets, data = tk.buffers(batch.column(1))
            for a, b in tk.slices(offsets, _PIECE):
                values, cuts = shingle_sets(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]], k)
                n = np.diff(cuts)
                at = cuts[:-1][n > 0]
                sums = np.zeros((2, len(n)), tk.U64)
                with np.errstate(over="ignore"):
                    for s, salt in enumerate(_SALTS):
                        if len(at):
                            sums[s, n > 0] = np.add.reduceat(tk.mix(values ^ salt), at)
                    signature = ring.signatures(values, cuts)
                    keys = tk.mix((signature.reshape(len(n), bands, rows).astype(tk.U64) * weights).sum(axis=2, dtype=tk.U64) + np.arange(bands, dtype=tk.U64) * _SALTS[0])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array([r.tobytes() for r in keys], pa.binary()), pa.array([r.tobytes() for r in (signature & 0xFF).astype(np.uint8)], pa.binary())],
                    names=["doc_id", "n", "s1", "s2", "bands", "sketch"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, s1 long, s2 long, bands binary, sketch binary")


def _squeezed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze((t or "").encode()) for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "z"])

    return docs.mapInArrow(run, "id long, z binary")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, z): the compressed texts of the documents in ``ids`` (id), written once for all verification. The join is by merging at every size,
    since both sides grow with the corpus."""
    return keep(_squeezed(docs).join(ids.distinct().hint("merge"), "id", "left_semi"), "texts")


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets share at least ``percent`` in a hundred of their union. texts: (id, z), an id once."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("z").alias("za")), "a").join(texts.select(F.col("id").alias("b"), F.col("z").alias("zb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompressobj
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                linked = np.zeros(part.num_rows, bool)
                sides = []
                for column in ("za", "zb"):
                    sides.append(_sets([open_().decompress(z) for z in part.column(part.schema.get_field_index(column)).to_pylist()], k))
                (va, ca), (vb, cb) = sides
                for r in range(part.num_rows):
                    x, y = va[ca[r] : ca[r + 1]], vb[cb[r] : cb[r + 1]]
                    if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) > 0:
                        spot = np.searchsorted(y, x)
                        shared = int(np.count_nonzero(y[np.minimum(spot, len(y) - 1)] == x))
                        linked[r] = 100 * shared >= percent * (len(x) + len(y) - shared)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)).filter(pa.array(linked)) for c in ("a", "b")], names=["a", "b"])

    return both.select("a", "b", "za", "zb").mapInArrow(run, "a long, b long")


def _banded(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            each = len(keys) // max(1, batch.num_rows)
            out = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), each))], names=["key", "doc"])
            yield from tk.rebatch(iter([out]))

    return reps.select("doc_id", "bands").mapInArrow(run, "key long, doc long")


REQUESTS = "block long, probe long, targets binary, roots binary"


class _Requests:
    """What is left to compare among members of a bucket: for a document and a block of documents, those of the block that sizes and
    signatures leave possible and that are of other components. Each pair comes from the first band that it shares, once."""

    def __init__(self, percent: int, sketch: float, blocks: int):
        self.percent, self.sketch, self.blocks = percent, sketch, blocks
        self.rows: list[tuple] = []
        self.pending = 0

    @staticmethod
    def members(table: pa.Table) -> tuple[np.ndarray, ...]:
        """doc, root, n, sketches and bands."""
        packed = [np.frombuffer(b"".join(table.column(c).to_pylist()), kind).reshape(table.num_rows, -1) for c, kind in (("sketch", np.uint8), ("bands", np.int64))]
        return (*(table.column(c).to_numpy() for c in ("doc", "root", "n")), *packed)

    def compare(self, key: int, left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...] | None) -> Iterator[pa.RecordBatch]:
        """Between two chunks of a bucket, or within one (right: None)."""
        same = right is None
        doc, root, n, sketches, bands = left if same else (np.concatenate(x) for x in zip(left, right))
        band = int(np.argmax(bands[0] == key))
        _, inverse, size = np.unique(root, return_inverse=True, return_counts=True)
        weight = size[inverse]  # members of larger components are targets, not probes: few probes make few rows
        a, b = np.arange(len(left[0])), np.arange(len(left[0]), len(doc))
        if same:
            a = b = a[np.lexsort((doc[a], weight[a]))]
        elif weight[a].sum() > weight[b].sum():
            a, b = b, a
        for at, i in enumerate(a.tolist()):
            other = b[at + 1 :] if same else b
            other = other[(root[other] != root[i]) & (100 * np.minimum(n[other], n[i]) >= self.percent * np.maximum(n[other], n[i]))]
            if len(other):
                other = other[(sketches[other] == sketches[i]).mean(axis=1) >= self.sketch]
            if len(other):
                other = other[(bands[other] == bands[i]).argmax(axis=1) == band]
            if not len(other):
                continue
            block = _block(doc[other], self.blocks)
            for k in np.unique(block).tolist():
                to = other[block == k]
                self.rows.append((k, int(doc[i]), doc[to].tobytes(), root[to].tobytes()))
                self.pending += 16 * len(to) + 100
            if self.pending > 1 << 20:
                yield self.flush()

    def flush(self) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in self.rows], t) for i, t in enumerate(kinds)], names=["block", "probe", "targets", "roots"])
        self.rows, self.pending = [], 0
        return batch


MEMBERS = ["doc", "root", "n", "sketch", "bands"]


def _unsettled(members: DataFrame, percent: int, sketch: float, blocks: int) -> DataFrame:
    """The requests. members: key, chunks (of the key's bucket), doc, root, n, sketch, bands.

    A bucket of one chunk is gathered in a task. The chunks of larger buckets are written once to the shared folder, and a task reads
    the two that it compares, so no member is sent more than once whatever the size of its bucket."""
    spark = members.sparkSession
    rows, cells = members.select(F.count(F.lit(1)), F.sum(F.when(F.col("chunks") > 1, 1).otherwise(0))).first()

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Requests(percent, sketch, blocks)
        for key, table in tk.groups(batches, "key"):
            yield from out.compare(int(key), out.members(table), None)
        yield out.flush()

    parts = max(width(spark), min(TASKS, -(-rows // 200_000)))
    small = members.where("chunks = 1").select("key", *MEMBERS).repartition(parts, "key").sortWithinPartitions("key").mapInArrow(within, REQUESTS)
    if not cells:
        return small
    folder = new_folder(spark, "cells")
    cell = lambda c: F.hex(F.xxhash64("key", c))
    large = members.where("chunks > 1").withColumn("cell", cell(F.pmod(F.xxhash64("doc"), F.col("chunks")).cast("int")))
    large.select("cell", *MEMBERS).repartition(parts, "cell").write.partitionBy("cell").option("compression", "zstd").parquet(folder)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Requests(percent, sketch, blocks)
        for batch in batches:
            for key, one, two in zip(*(c.to_pylist() for c in batch.columns)):
                tables = [read_part(f"{folder}/cell={x}", MEMBERS) for x in dict.fromkeys((one, two))]
                if None not in [t if t is None else 0 for t in tables]:
                    yield from out.compare(key, *(out.members(t) for t in tables), *([None] if one == two else []))
        yield out.flush()

    buckets = members.where("chunks > 1").select("key", "chunks").distinct()
    pairs = buckets.select("key", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("c1")).select("key", "c1", F.explode(F.sequence("c1", F.col("chunks") - 1)).alias("c2"))
    pairs = keep(pairs.select("key", cell("c1").alias("one"), cell("c2").alias("two")), "pairs")
    return small.unionByName(pairs.repartition(max(width(spark), min(TASKS, pairs.count())), "key", "one", "two").mapInArrow(across, REQUESTS))


def _block(docs: np.ndarray, blocks: int) -> np.ndarray:
    return (tk.mix(docs.astype(np.int64).view(tk.U64)) % tk.U64(blocks)).astype(np.int64)


def _sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets`` of many texts, a bounded number of bytes at a time."""
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    values, sizes = [np.zeros(0, tk.U64)], [np.zeros(0, np.int64)]
    for i, j in tk.slices(offsets, _PIECE // 2):
        v, c = shingle_sets(offsets[i : j + 1] - offsets[i], np.frombuffer(b"".join(texts[i:j]), np.uint8), k)
        values.append(v)
        sizes.append(np.diff(c))
    return np.concatenate(values), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def verify_blocks(requests: DataFrame, members: DataFrame, texts: DataFrame, k: int, percent: int, blocks: int, parts: int, probes: int = PROBES) -> DataFrame:
    """Links (a, b) among the requests, the least target of each component that a probe is linked with.

    A block's documents are indexed by shingle, and a probe's shingles are counted against all of them at once, so a document that looks like
    thousands of others costs one row and one pass for each block. A block with more than ``probes`` requests is sent to several tasks,
    which share its requests. members: the documents that requests can name."""
    named = texts.join(members.select(F.col("doc").alias("id")).distinct().hint("merge"), "id", "left_semi")
    splits = keep(requests.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / probes).cast("int").alias("splits")), "splits")
    asked = requests.join(texts.withColumnRenamed("id", "probe").hint("merge"), "probe").join(splits, "block")
    asked = asked.select("block", F.pmod(F.xxhash64("probe"), F.col("splits")).cast("int").alias("split"), F.lit(1).alias("kind"), F.col("probe").alias("id"), "z", "targets", "roots")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = pa.nulls(batch.num_rows, pa.binary())
            block = _block(batch.column(0).to_numpy(), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(np.zeros(batch.num_rows, np.int32)), batch.column(0), batch.column(1), none, none], names=["block", "kind", "id", "z", "targets", "roots"])

    placed = named.mapInArrow(place, "block long, kind int, id long, z binary, targets binary, roots binary").join(splits, "block")
    both = placed.withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).drop("splits").unionByName(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompressobj
        now, fresh, index = None, [], None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for r in batch.to_pylist():
                if (r["block"], r["split"]) != now:
                    now, fresh, index = (r["block"], r["split"]), [], None
                text = open_().decompress(r["z"])
                if r["kind"] == 0:
                    fresh.append((r["id"], text))
                    continue
                if index is None:
                    ids = np.array([x for x, _ in fresh], np.int64)
                    values, cuts = _sets([t for _, t in fresh], k)
                    sizes, order = np.diff(cuts), np.argsort(values, kind="stable")
                    index, fresh = (ids, sizes, values[order], np.repeat(np.arange(len(ids), dtype=np.int32), sizes)[order]), []
                ids, sizes, values, holder = index
                mine, _ = _sets([text], k)
                a, b = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
                spans = b - a
                spots = np.repeat(a - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
                shared = np.bincount(holder[spots], minlength=len(ids))
                linked = ids[100 * shared >= percent * (len(mine) + sizes - shared)]
                targets, roots = np.frombuffer(r["targets"], np.int64), np.frombuffer(r["roots"], np.int64)
                good = np.isin(targets, linked)
                targets, roots = targets[good], roots[good]
                for of in np.unique(roots).tolist():
                    out.append((r["id"], int(targets[roots == of].min())))
            yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in out], pa.int64()), pa.array([max(x) for x in out], pa.int64())], names=["a", "b"])

    count = splits.agg(F.sum("splits")).first()[0] or 0
    return both.repartition(max(parts, min(TASKS, count)), "block", "split").sortWithinPartitions("block", "split", "kind").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, sketch: float = SKETCH, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct ``shingle``-word sequences (A-Z
    lower-cased, words split at ASCII white space; fewer words than that make one shingle). component_id is the least doc_id
    that links reach, kept says that it is the document's own. Documents without words, or with a null text, have an empty set and link with
    nothing. Null ids are left out. Rows that repeat an id are judged each by its own text, with a result row each; where such an id is the least
    of those with an equal set, the links of any of its texts are its links. Other columns play no part.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    sketches = keep(_sketches(docs, shingle, bands, rows), "sketches")
    classes = keep(sketches.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    reps = keep(sketches.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "reps")
    banded = keep(_banded(reps), "bands")

    shared = banded.groupBy("key").agg(F.min("doc").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1")
    stars = banded.join(shared, "key", "left").where("centre != doc").select(F.col("centre").alias("a"), F.col("doc").alias("b")).distinct()
    stars = keep(stars, "stars")
    texts = texts_of(docs, stars.select(F.col("a").alias("id")).unionByName(stars.select(F.col("b").alias("id"))))
    links = keep(verify(stars, texts, shingle, percent), "links")
    drop(stars)
    roots = keep(components(links), "roots")

    # buckets of three and more (all pairs of smaller ones are settled) with documents of different components
    rooted = banded.join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    open_ = rooted.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("size > 2 and low != high")
    open_ = open_.select("key", F.ceil(F.col("size") / chunk).cast("int").alias("chunks"))
    members = keep(rooted.join(open_, "key").join(reps.select(F.col("doc_id").alias("doc"), "n", "sketch", "bands"), "doc"), "open")
    drop(links, banded, reps)
    shingles = members.select("doc", "n").distinct().agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-int(shingles) // _BLOCK_SHINGLES))
    requests = keep(_unsettled(members, percent, sketch, blocks), "requests")
    more = keep(verify_blocks(requests, members, texts, shingle, percent, blocks, width(spark)), "links")
    drop(texts, members, requests)
    named = more.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    joined = components(named.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    drop(more)
    merged = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))

    final = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep")).join(merged, "root", "left")
    final = final.select("s1", "s2", "n", F.coalesce("top", "root").alias("top"))
    out = sketches.select("doc_id", "n", "s1", "s2").join(final, ["s1", "s2", "n"], "left").withColumn("top", F.coalesce("top", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("top").alias("component_id"), (F.col("top") == F.col("doc_id")).alias("kept"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, k FROM (
    SELECT doc_id, w[i] || ' ' || w[i + 1] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) >= 2)
    UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
reach(id, got) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, l.b FROM reach r JOIN l ON l.a = r.got),
c AS (SELECT id, min(got) AS component_id FROM reach GROUP BY id)
SELECT c.id AS doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.id = c.component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.id
"""
