"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are scaled to length 1 and rotated onto the principal axes of the whole table, so that the leading dimensions hold
most of a dot product. Two tiles are compared by their leading dimensions first; what the rest can add is bounded by the
product of the suffix norms, which rides along as one more dimension of the same matrix product. Only pairs whose bound
reaches the threshold go on to more dimensions, and the pairs that are left are settled on the unrotated vectors in double
precision. Blocks whose ranges on the first axis are too far apart for the threshold are never brought together.

Equal vectors are one class with a multiplicity before any comparison. Vectors are dealt into blocks by their place on the first
axis; a range in which more stand than a block takes, however equal their places, is dealt on by hash. Blocks are written once to
the shared folder, so the shuffle is as large as the table; a task reads one block and, one after the other, a few of those in
its reach, and gives back a number of links and a local root for each vector, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .graph import components
from .shared import drop, forget, keep, new_folder, prepare, read_part, width

#: Vectors in a block, rows in a tile of the matrix product, and blocks that a task compares one block with.
BLOCK, TILE, RUN = 4096, 1024, 16
#: Bytes of components that a task holds of each of two blocks: longer vectors make smaller blocks.
HELD = 128 << 20
#: Dimensions after which a pair's bound is looked at.
STEPS = (16, 32)


def _unit(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    some = max(1, HELD // (8 * size))
    for batch in (b.slice(i, some) for b in batches for i in range(0, b.num_rows, some)):
        x = np.zeros((batch.num_rows, size))
        good = np.zeros(batch.num_rows, bool)
        for i, v in enumerate(batch.column(1).to_pylist()):
            if v and None not in v:
                x[i, : len(v)] = v
                good[i] = True
        with np.errstate(over="ignore", invalid="ignore"):
            good &= np.isfinite(x).all(axis=1)
            x[~good] = 0
            top = np.abs(x).max(axis=1, initial=0)
            good &= top > 0
            x /= np.where(good, top, 1)[:, None]  # so that squares neither overflow nor vanish
            x /= np.where(good, np.linalg.norm(x, axis=1), 1)[:, None]
        x[x == 0] = 0.0  # no negative zeros
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() if g else None for r, g in zip(x, good)], pa.binary())], names=["vec_id", "unit"])


def _axes(reps: DataFrame, size: int) -> np.ndarray:
    """The principal axes that pairs are compared along first, the most important one first, as columns.

    A block of directions a little wider is multiplied by the table's matrix of products three times; each time tasks send the block's size, ``size`` rows of at
    most 40 sums, which Spark adds up, and the driver gets one such block. Comparisons are exact whatever the axes."""
    k = min(size, STEPS[-1] + 8)

    def turned(q: np.ndarray) -> np.ndarray:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, some = np.zeros((size, k)), max(1, HELD // (8 * size))
            for batch in batches:
                for i in range(0, batch.num_rows, some):
                    x = np.frombuffer(b"".join(batch.column(0).slice(i, some).to_pylist())).reshape(-1, size)
                    total += x.T @ (x @ q)
            for i in range(0, size, 4096):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, min(size, i + 4096))), pa.array(list(total[i : i + 4096]), pa.list_(pa.float64()))], names=["i", "row"])

        rows = reps.select("unit").mapInArrow(sums, "i long, row array<double>").groupBy("i").agg(*(F.sum(F.get("row", F.lit(j))).alias(f"x{j}") for j in range(k)))
        out = np.zeros((size, k))
        for r in rows.collect():
            out[r["i"]] = r[1:]
        return out

    q = np.linalg.qr(np.random.default_rng(1).standard_normal((size, k)))[0]
    for _ in range(2 if k < size else 0):  # a block of all directions needs no turning
        q = np.linalg.qr(turned(q))[0]
    inner = q.T @ turned(q)
    return (q @ np.linalg.eigh((inner + inner.T) / 2)[1][:, ::-1])[:, : STEPS[-1]]


def _hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the pairs (a, b) in a forest of parents that never exceed their children."""
    while len(a):
        a, b = parent[a], parent[b]
        unlike = a != b
        a, b = np.maximum(a, b)[unlike], np.minimum(a, b)[unlike]
        np.minimum.at(parent, a, b)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _compare(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (of a and b; of one block if same, then each pair once) with cosine >= threshold, tile by tile."""
    steps = [k for k in STEPS if k < a.shape[1]]

    def leading(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        p = x @ axes
        whole = (x**2).sum(axis=1)
        tails = [np.sqrt(np.maximum(0, whole - (p[:, :k] ** 2).sum(axis=1))) for k in steps]
        return p, tails

    pa_, ta = leading(a)
    pb_, tb = (pa_, ta) if same else leading(b)
    first = [np.hstack([p[:, : steps[0]], t[0][:, None]]).astype(np.float32) for p, t in ((pa_, ta), (pb_, tb))] if steps else [a.astype(np.float32), b.astype(np.float32)]
    for i in range(0, len(a), TILE):
        for j in range(i if same else 0, len(b), TILE):
            x, y = np.nonzero(first[0][i : i + TILE] @ first[1][j : j + TILE].T >= np.float32(threshold - 1e-4))
            x, y = x + i, y + j
            if same:
                x, y = x[x < y], y[x < y]
            for n in range(0, len(x), 1 << 16):
                p, q = x[n : n + (1 << 16)], y[n : n + (1 << 16)]
                for k, s, t in list(zip(steps, ta, tb))[1:]:
                    alive = np.einsum("ij,ij->i", pa_[p, :k], pb_[q, :k]) + s[p] * t[q] >= threshold - 1e-6  # a tail is a difference
                    p, q = p[alive], q[alive]
                alive = np.einsum("ij,ij->i", a[p], b[q]) >= threshold
                yield p[alive], q[alive]


def link_embeddings(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors with a cosine of at least ``threshold`` (in double precision) are linked; n_links counts the others that a vector
    is linked with directly, copies included; component_id is the least vec_id that links reach; kept: it is the vector's own.
    Null, empty, zero vectors and those with null or non-finite components link with nothing. A vector shorter than the
    longest is taken with zeros behind it. Rows with a null id are left out; rows that repeat an id are vectors of their own.
    Other columns play no part. Comparisons, and bytes read from the shared folder, grow with the square of the number of distinct
    vectors on overlapping ranges of the first axis; bytes shuffled in proportion to the table. A task holds two blocks, of about ``block`` vectors
    each whatever the vectors are, fewer if these would take more than ``HELD`` bytes; so one very long vector makes the work on all others slow, not large.
    """
    spark = prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where("vec_id is not null")
    size = rows.agg(F.max(F.size("v"))).first()[0] or 0
    size = max(int(size), 1)
    block = max(1, min(block, HELD // (8 * size)))
    unit = keep(rows.mapInArrow(lambda b: _unit(b, size), "vec_id long, unit binary").withColumn("class", F.sha1("unit")), "unit")
    reps = keep(unit.where("unit is not null").groupBy("class").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit")), "vectors")
    axes = _axes(reps, size)
    axis, count = np.ascontiguousarray(axes[:, 0]), reps.count()
    bins = max(1, -(-count // block))

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(0).to_pylist())).reshape(-1, size) @ axis)], names=["x"])

    cuts = np.unique(reps.select("unit").mapInArrow(along, "x double").approxQuantile("x", [k / bins for k in range(1, bins)], 0.1 / bins) if bins > 1 else [])
    gap = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    low, high = np.append(-np.inf, cuts), np.append(cuts, np.inf)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist())).reshape(-1, size) @ axis
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(cuts, x, "right")), *batch.columns], names=["bin", "rep", "copies", "unit"])

    placed = keep(reps.select("rep", "copies", "unit").mapInArrow(place, "bin long, rep long, copies long, unit binary"), "placed")
    # blocks are numbered in the order of the first axis: a bin has as many as it needs
    parts = {r["bin"]: -(-r["count"] // block) for r in placed.groupBy("bin").count().collect()}
    first = np.concatenate([[0], np.cumsum([parts.get(b, 0) for b in range(len(low))])]).tolist()
    reach = [first[int(np.searchsorted(low, high[b] + gap, "right"))] for b in range(len(low))]  # the block after the last in reach
    numbers = spark.createDataFrame([(b, n, first[b]) for b, n in sorted(parts.items())], "bin long, parts long, start long")
    dealt = placed.join(numbers, "bin").select((F.col("start") + F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("block"), "rep", "copies", "unit")
    folder, blocks = new_folder(spark, "blocks"), first[-1]
    dealt.repartition(max(width(spark), min(20_000, blocks)), "block").sortWithinPartitions("block").write.partitionBy("block").option("compression", "zstd").parquet(folder)
    drop(placed)

    def load(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        table = read_part(f"{folder}/block={k}", ["rep", "copies", "unit"])
        if table is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, size))
        return table["rep"].to_numpy(), table["copies"].to_numpy(), np.frombuffer(b"".join(table["unit"].to_pylist())).reshape(-1, size)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                a = load(i)
                for j in range(start, stop):
                    b = a if i == j else load(j)
                    ids, copies = (a[0], a[1]) if i == j else (np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))
                    shift = 0 if i == j else len(a[0])
                    links, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
                    for p, q in _compare(a[2], b[2], axes, threshold, i == j):
                        q = q + shift
                        np.add.at(links, p, copies[q])
                        np.add.at(links, q, copies[p])
                        _hook(parent, p, q)
                    some = np.flatnonzero(links)
                    yield from tk.rebatch(iter([pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[parent[some]])], names=["rep", "links", "root"])]))

    ends = [(k, reach[b]) for b in sorted(parts) for k in range(first[b], first[b + 1])]
    runs = spark.createDataFrame(ends, "i long, stop long").select("i", F.explode(F.sequence("i", F.col("stop") - 1, F.lit(RUN))).alias("start"), "stop")
    runs = runs.select("i", "start", F.least("stop", F.col("start") + RUN).alias("stop"))
    tasks = max(width(spark), min(20_000, sum(-(-(stop - k) // RUN) for k, stop in ends)))
    found = keep(runs.repartition(tasks, "i", "start").mapInArrow(compare, "rep long, links long, root long"), "links")
    forget(spark, folder)
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    classes = reps.select("class", "rep", "copies").join(found.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left").join(roots, "rep", "left")
    classes = classes.select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "rep").alias("root"))
    out = unit.select("vec_id", "class").join(classes, "class", "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(id, got) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN l ON l.a = r.got),
c AS (SELECT id, min(got) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT c.id AS vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.id = c.component_id AS kept FROM c LEFT JOIN n ON n.a = c.id
"""
