"""Line deduplication by pairwise alignment.

Overlapping documents are found through the hashes of their lines, taken in runs of a block's length, since a single common line makes
no block. Every document is paired with the first document that has one of its runs. That makes at most one pair for an
occurrence of a run, however many documents share it, and loses nothing against aligning all pairs: a line goes if it lies in a run
that some earlier document has, and the run's first holder is such a document. The two line sequences of a pair are aligned by
patience diff (longest increasing run of lines that are unique on both sides, then the gaps in the same way); what is left of the
later document is matched against the runs of the earlier one, for passages that it repeats more than once or in another order. The
blocks found are deleted from the later document. If asked for, a line of enough words is a block of its own; the lowest bit of a
line's hash tells such lines. Documents with the same lines throughout are one class first: all but the least of a class lose every
line, and only that one takes part in pairs. Lines are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import drop, keep, prepare

BLOCK = 2
#: Words from which the queries take a line for a block of its own.
ALONE = 50
ADDED = ("n_lines", "n_removed", "kept_sha256")


def lines_of(text: str | None) -> tuple[list[str], list[int]]:
    """All lines of a text, and the numbers of those that are not blank."""
    lines = (text or "").split("\n")
    return lines, [i for i, x in enumerate(lines) if x.strip()]


def _hash(line: str, alone: int | None) -> int:
    """The lowest bit is set for a line of at least ``alone`` words."""
    return xxhash.xxh3_64_intdigest(line.strip().encode()) & ~1 | (alone is not None and len(line.split()) >= alone)


def patience(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Aligned places of two sequences, ascending on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        once_a, once_b = Counter(a[i:k]), {}
        seen = Counter(b[j:m])
        for y in range(j, m):
            if seen[b[y]] == 1:
                once_b[b[y]] = y
        pairs = [(x, once_b[a[x]]) for x in range(i, k) if once_a[a[x]] == 1 and a[x] in once_b]
        if not pairs:
            continue
        tails: list[int] = []
        last: list[int] = []
        back: list[int] = []
        for n, (_, y) in enumerate(pairs):
            at = bisect_left(tails, y)
            back.append(last[at - 1] if at else -1)
            if at == len(tails):
                tails.append(y)
                last.append(n)
            else:
                tails[at], last[at] = y, n
        run, n = [], last[-1]
        while n >= 0:
            run.append(pairs[n])
            n = back[n]
        x, y = i, j
        for p, q in [*run[::-1], (k, m)]:
            todo.append((x, p, y, q))
            if (p, q) != (k, m):
                out.append((p, q))
                x, y = p + 1, q + 1
    return sorted(out)


def common_blocks(a: Sequence, b: Sequence, least: int, alone: Callable[[object], bool] | None = None) -> list[tuple[int, int, int]]:
    """Blocks of at least ``least`` lines of a that b has: start in a, start in b, length. First the aligned ones, then the
    runs of a that no alignment reaches, then single lines for which ``alone`` holds."""
    blocks: list[list[int]] = []
    for i, j in patience(a, b):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1][2] += 1
        else:
            blocks.append([i, j, 1])
    out = [tuple(x) for x in blocks if x[2] >= least]
    gone = bytearray(len(a))
    for i, _, n in out:
        gone[i : i + n] = b"\1" * n
    starts: dict[tuple, int] = {}
    if not all(gone):
        for j in range(len(b) - least + 1):
            starts.setdefault(tuple(b[j : j + least]), j)
    i = 0
    while starts and i + least <= len(a):
        j = None if all(gone[i : i + least]) else starts.get(tuple(a[i : i + least]))
        if j is None:
            i += 1
            continue
        n = least
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        out.append((i, j, n))
        gone[i : i + n] = b"\1" * n
        i += n - least + 1
    if alone and not all(gone):
        places = {b[j]: j for j in range(len(b) - 1, -1, -1) if alone(b[j])}
        out += [(i, places[x], 1) for i, x in enumerate(a) if not gone[i] and x in places]
    return out


def _sequences(docs: DataFrame, alone: int | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for text in batch.column(1).to_pylist():
                all_, full = lines_of(text)
                lines.append(np.array([_hash(all_[i], alone) for i in full], np.uint64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 8 for x in lines]), pa.array([hashlib.md5(x).digest() for x in lines], pa.binary()), pa.array(lines, pa.binary())], names=["doc_id", "n_lines", "class", "lines"])

    return docs.mapInArrow(run, "doc_id long, n_lines long, class binary, lines binary")


def _occurrences(reps: DataFrame, block: int) -> DataFrame:
    """A document's runs of ``block`` lines and its lines that are blocks alone, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            parts = [np.unique(np.concatenate([tk.windows(x, block), x[(x & tk.U64(1)) == 1]])).view(np.int64) for x in hashes]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *parts])), pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in parts]))], names=["run", "doc"])

    return reps.select("doc_id", "lines").mapInArrow(run, "run long, doc long")


def _removals(pairs: DataFrame, reps: DataFrame, block: int) -> DataFrame:
    sequences = reps.select("doc_id", "lines")
    both = pairs.join(sequences.withColumnsRenamed({"doc_id": "a", "lines": "la"}), "a").join(sequences.withColumnsRenamed({"doc_id": "b", "lines": "lb"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, masks = [], []
            for doc, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                later, earlier = np.frombuffer(x, np.uint64).tolist(), np.frombuffer(y, np.uint64).tolist()
                gone = np.zeros(len(later), bool)
                for i, _, n in common_blocks(later, earlier, block, lambda x: x & 1):
                    gone[i : i + n] = True
                if gone.any():
                    docs.append(doc)
                    masks.append(np.packbits(gone).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(masks, pa.binary())], names=["doc_id", "mask"])

    return both.select("a", "la", "lb").mapInArrow(run, "doc_id long, mask binary").groupBy("doc_id").agg(F.collect_list("mask").alias("masks"))


def dedup_lines(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", alone: int | None = None) -> DataFrame:
    """``docs`` with the deleted lines gone from its text, and n_lines, n_removed and kept_sha256 (of the new text) added.

    Lines are compared without white space at their ends; blank lines are neither compared nor deleted. n_lines counts the
    lines that are not blank. A block that an earlier document has, wherever and however often it stands, counts from ``block`` lines, and a
    single line if it has at least ``alone`` words (None: never); a document all of whose lines are those of an earlier one
    in the same order loses them all, however few. A null text stays null, without lines, its hash null. Everything is judged
    on the input. Rows with a null id lose nothing. Rows that repeat an id are never compared with each other; each loses what its own lines
    allow, as far as the row that stands for the id in pairs has the same lines. Columns of ``docs`` named like an added one
    give way to it; all others are passed through.
    """
    prepare(docs.sparkSession)
    text = F.col(text_col).cast("string")
    known = keep(_sequences(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")), alone), "lines")
    first = known.where("n_lines > 0").groupBy("class").agg(F.min("doc_id").alias("rep"))
    reps = keep(known.join(first.select(F.col("rep").alias("doc_id"), F.col("class").alias("own")), "doc_id").where("class = own").drop("own").dropDuplicates(["doc_id"]), "reps")
    held = keep(_occurrences(reps, block), "occurrences")
    # written apart from the join, so that adaptive execution can split a run that a great share of all documents has
    shared = keep(held.groupBy("run").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("docs")).where("docs > 1").drop("docs"), "shared")
    pairs = held.join(shared, "run").where("doc != first").select(F.col("doc").alias("a"), F.col("first").alias("b")).distinct()
    removed = keep(_removals(pairs, reps, block).join(reps.select("doc_id", F.col("class").alias("of")), "doc_id"), "removed")
    drop(held, shared, reps)

    names = [c for c in docs.columns if c not in ADDED]
    where = names.index(text_col)
    rows = docs.select(*names, F.col(id_col).cast("long").alias("__id"))
    copies = known.select("doc_id", "class").distinct().join(first, "class").where("doc_id != rep").groupBy("doc_id").agg(F.collect_set("class").alias("copied"))
    facts = removed.join(copies, "doc_id", "full_outer").withColumnsRenamed({"doc_id": "__id", "masks": "__masks", "of": "__of", "copied": "__copied"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("__masks", "__of", "__copied")}
            texts, counts, gone, sums = [], [], [], []
            for value, masks, of, copied in zip(batch.column(where).to_pylist(), columns["__masks"], columns["__of"], columns["__copied"]):
                lines, full = lines_of(value)
                drop = np.zeros(len(full), bool)
                if full and (copied or masks):
                    own = hashlib.md5(np.array([_hash(lines[i], alone) for i in full], np.uint64).tobytes()).digest()
                    if own in (copied or ()):
                        drop[:] = True
                    elif own == of:
                        for m in masks:
                            drop |= np.unpackbits(np.frombuffer(m, np.uint8), count=len(full)).astype(bool)
                if drop.any():
                    out = {full[i] for i in np.flatnonzero(drop).tolist()}
                    value = "\n".join(x for i, x in enumerate(lines) if i not in out)
                texts.append(value)
                counts.append(len(full))
                gone.append(int(drop.sum()))
                sums.append(None if value is None else hashlib.sha256(value.encode()).hexdigest())
            kept = [batch.column(i) for i in range(len(names))]
            kept[where] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())], names=[*names, *ADDED])

    kinds = dict(docs.dtypes) | {text_col: "string"}
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", n_lines long, n_removed long, kept_sha256 string"
    return rows.join(facts, "__id", "left").select(*names, "__masks", "__of", "__copied").mapInArrow(run, schema)


#: The same in DuckDB's SQL, for blocks of 2 lines, or of one line of 50 words.
SQL = r"""
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, i, l[i] AS line, regexp_replace(l[i], '^[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g') AS s
      FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM raw)),
f AS MATERIALIZED (SELECT doc_id, i, s, lead(i) OVER o AS next_i, lead(s) OVER o AS next_s, len(string_split_regex(s, '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) AS n
      FROM p WHERE s <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT s, next_s, min(doc_id) AS first FROM f WHERE next_i IS NOT NULL GROUP BY s, next_s),
alone AS (SELECT s, min(doc_id) AS first FROM f WHERE n >= 50 GROUP BY s),
whole AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY i) AS t FROM f GROUP BY doc_id),
copy AS (SELECT doc_id FROM whole JOIN (SELECT t, min(doc_id) AS first FROM whole GROUP BY t) USING (t) WHERE first < doc_id),
gone AS (SELECT doc_id, i FROM f JOIN runs USING (s, next_s) WHERE first < doc_id
         UNION SELECT doc_id, next_i FROM f JOIN runs USING (s, next_s) WHERE first < doc_id
         UNION SELECT doc_id, i FROM f JOIN alone USING (s) WHERE n >= 50 AND first < doc_id
         UNION SELECT doc_id, i FROM f JOIN copy USING (doc_id)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM p ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n_lines FROM f GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept.t, '')) END AS kept_sha256
FROM documents d LEFT JOIN counts ON counts.doc_id = d.doc_id LEFT JOIN lost ON lost.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
