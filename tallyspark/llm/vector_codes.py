"""Compression of vectors to short codes: every part of a vector is named by the nearest entry of its own codebook.

Codebooks are improved in rounds, as in k-means, on whole numbers throughout. A round looks for the nearest entry by exponion search: it starts
at the entry that the part had before, at distance u. An entry that is as near or nearer lies within 2u of that one, so of the other
entries, sorted by their distance from it, only those up to 2u are looked at; the radius is part of the claim, not a guess. Squared distances are compared as
whole numbers, so that the least index among equally near entries is found whatever the order.

Vectors are written to the shared folder in blocks, as whole numbers of the fewest bytes that hold them. A round reads the blocks, writes them with their new
entries and, beside them, what they add to each entry's sum; the sums alone are read to move the entries. Nothing but sums is shuffled, and
the driver holds the codebooks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, keep, prepare

#: Bytes of components in a block, vectors in one at most, and labels whose sums are broadcast (others are joined by a shuffle).
BLOCK_BYTES, BLOCK_ROWS, LABELS = 2 << 20, 4096, 100_000


def nearest(x: np.ndarray, book: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x the index of the nearest row of ``book`` (the least one of equally near ones), the squared distance,
    and how many distances were worked out. ``start`` has the entries that the search begins at.

    Both arrays hold whole numbers, in a type in which four times the squared distances are exact."""
    gaps = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(gaps, axis=1, kind="stable")
    reach = np.take_along_axis(gaps, order, axis=1)
    first = ((x - book[start]) ** 2).sum(axis=1)
    found, least, looked = start.copy(), first.copy(), len(x)
    rows = np.arange(len(x))
    for k in range(len(book)):
        rows = rows[reach[start[rows], k] <= 4 * first[rows]]  # the list is sorted: who is out stays out
        if not len(rows):
            break
        entry = order[start[rows], k]
        other = entry != start[rows]
        at, entry = rows[other], entry[other]
        gap = ((x[at] - book[entry]) ** 2).sum(axis=1)
        looked += len(at)
        better = (gap < least[at]) | (gap == least[at]) & (entry < found[at])
        found[at[better]], least[at[better]] = entry[better], gap[better]
    return found, least, looked


def _moved(book: list[list[int]], totals: dict[tuple[int, int], int], counts: dict[int, int]) -> list[list[int]]:
    return [[totals[e, i] // counts[e] for i in range(len(entry))] if counts.get(e) else entry for e, entry in enumerate(book)]


def compress_vectors(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[list[list[int]]]]:
    """(rows, codebooks): one row per vector that is whole - vec_id, code (two hex digits for each part), error, label_error, codebooks_sha256 - and
    the final codebooks (part, entry, component).

    A component x counts as floor(scale * x). Each codebook starts as its part of the vectors with the ``entries`` smallest ids (ties by the vectors;
    null ids come last) and, in each round, every entry moves to the floors of the means of the parts nearest to it; entries without any stay. ``error`` is
    the sum of the squared distances to the final entries, ``label_error`` its sum over the rows of equal labels, nulls together. Vectors that are null or hold null or
    non-finite components are left out. A vector shorter than the longest one, or than the next multiple of ``parts``, has zeros behind it; an empty
    one is all zeros. Fewer vectors than entries give as many entries as there are vectors, an empty table gives an empty result. Rows that repeat
    an id are vectors of their own; other columns play no part. Components so large that an error would not fit into a long raise a ValueError.
    """
    if parts < 1 or not 1 <= entries <= 256 or rounds < 0 or scale < 1:
        raise ValueError("parts, entries (256 at most), rounds and scale must be positive")
    spark = prepare(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    size, top = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    width = max(1, -(-(size or 0) // parts))
    most = int(top or 0) * scale + scale + 1  # no component is further from 0
    if parts * width * (2 * most) ** 2 >= 1 << 61:
        raise ValueError(f"components up to {top} give errors beyond a long's range")
    held = np.dtype(next(t for t in ("<i2", "<i4", "<i8") if most < 1 << (8 * int(t[2]) - 1)))
    work = np.dtype("f8" if 4 * width * (2 * most) ** 2 < 1 << 53 else "i8")
    block = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(1, parts * width * held.itemsize)))
    kind = rows.schema["label"].dataType.simpleString()

    def whole(values: list[list[float]]) -> np.ndarray:
        x = np.zeros((len(values), parts * width), held)
        for i, v in enumerate(values):
            x[i, : len(v)] = np.floor(np.array(v, "f8") * scale)
        return x

    start = whole([r["v"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()])
    books = [[row[p * width : (p + 1) * width].tolist() for row in start] for p in range(parts)]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                part = batch.slice(i, block)
                x = whole(part.column(2).to_pylist())
                row = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), part.column(c)) for c in (0, 1)] + [pa.array([v], pa.binary()) for v in (x.tobytes(), bytes(len(x) * parts))]
                yield pa.RecordBatch.from_arrays(row, names=["ids", "labels", "x", "codes"])

    def assigned(x: bytes, codes: bytes, books: list) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each part: its components, nearest entries and squared distances."""
        all_ = np.frombuffer(x, held).reshape(-1, parts * width)
        before = np.frombuffer(codes, np.uint8).reshape(-1, parts)
        for p in range(parts):
            own = all_[:, p * width : (p + 1) * width].astype(work)
            yield p, own, *nearest(own, np.array(books[p], work).reshape(-1, width), before[:, p].astype(np.int64))[:2]

    def step(books: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row, n = batch.slice(k, 1), len(books[0])
                    x, codes = row.column(2)[0].as_py(), row.column(3)[0].as_py()
                    after = np.empty((len(codes) // parts, parts), np.uint8)
                    sums = np.zeros((parts, n, width + 1), np.int64)  # components, then the count
                    for p, own, found, _ in assigned(x, codes, books):
                        after[:, p] = found
                        np.add.at(sums[p, :, :width], found, own.astype(np.int64))
                        sums[p, :, width] = np.bincount(found, minlength=n)
                    new = [pa.array([after.tobytes()], pa.binary()), pa.array([sums.ravel()], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*row.columns[:3], *new], names=["ids", "labels", "x", "codes", "sums"])

        return run

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for sums in batch.column(0):
                own = sums.values.to_numpy()
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], names=["sums"])

    shape = f"ids array<long>, labels array<{kind}>, x binary, codes binary"
    now = keep(rows.mapInArrow(blocks, shape), "vectors")
    for _ in range(rounds if len(start) else 0):
        after = keep(now.select("ids", "labels", "x", "codes").mapInArrow(step([*books]), shape + ", sums array<long>"), "vectors")
        cells = after.select("sums").mapInArrow(added, "sums array<long>").select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        totals = {r["i"]: int(r["x"]) for r in cells.collect()}
        n = len(start)
        for p in range(parts):
            at = lambda e, i, p=p: totals[(p * n + e) * (width + 1) + i]
            books[p] = _moved(books[p], {(e, i): at(e, i) for e in range(n) for i in range(width)}, {e: at(e, width) for e in range(n)})
        drop(now)
        now = after

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels, x, codes = (batch.column(c)[k] for c in range(4))
                after, error = np.empty((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p, _, found, least in assigned(x.as_py(), codes.as_py(), books):
                    after[:, p] = found
                    error += least.astype(np.int64)
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array([c.tobytes().hex() for c in after]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    out = keep(now.select("ids", "labels", "x", "codes").mapInArrow(last, f"vec_id long, label {kind}, code string, error long"), "codes")
    drop(now)
    sums = keep(out.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label_errors")
    few = sums.count() <= LABELS and kind in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp")
    named = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    rows = out.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of")), "left")
    return rows.select("vec_id", "code", "error", "label_error", F.lit(named).alias("codebooks_sha256")), books


def _sql(rounds: int = 6) -> str:
    """The same with one row per component, round by round."""
    one = """
a{k} AS MATERIALIZED (SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT x.r, x.p, c.e, sum((x.x - c.c) * (x.x - c.c)) AS d FROM x JOIN c{k} c ON c.p = x.p AND c.i = x.i GROUP BY x.r, x.p, c.e) GROUP BY r, p)"""
    move = """,
s{k} AS (SELECT x.p, a.e, x.i, sum(x.x) AS s, count(*) AS n FROM x JOIN a{k} a ON a.r = x.r AND a.p = x.p GROUP BY x.p, a.e, x.i),
c{n} AS MATERIALIZED (SELECT c.p, c.e, c.i, CASE WHEN s.n IS NULL THEN c.c ELSE (s.s - ((s.s % s.n) + s.n) % s.n) // s.n END AS c FROM c{k} c LEFT JOIN s{k} s ON s.p = c.p AND s.e = c.e AND s.i = c.i),"""
    return (
        """
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, [CAST(floor(4096 * CAST(y AS DOUBLE)) AS BIGINT) FOR y IN embedding] AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0),
w AS (SELECT CAST(ceil(max(len(v)) / 8) AS BIGINT) AS w FROM v),
x AS MATERIALIZED (SELECT r, j // w AS p, j % w AS i, coalesce(v[j + 1], 0) AS x FROM (SELECT r, v, w, unnest(range(8 * w)) AS j FROM v, w)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, i, x AS c FROM x WHERE r <= 16),"""
        + "".join((one + move).format(k=k, n=k + 1) for k in range(rounds))
        + one.format(k=rounds)
        + f""",
f AS MATERIALIZED (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT v.vec_id, f.code, f.error, CAST(sum(f.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) FROM c{rounds}) AS codebooks_sha256
FROM v JOIN f ON f.r = v.r
"""
    )


SQL = _sql()
