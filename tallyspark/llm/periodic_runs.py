"""Periodic runs of words, found through Lyndon arrays without suffix structures or hashes.

A run with period q is a stretch in which words q apart are equal and that no neighbouring word extends. Every run has, under one of the
two orders of its words (as they are, or reversed), a root that is the longest Lyndon word where it begins: it ends where the next smaller suffix
starts. So two passes over a document, one for each order, see every run as an edge from a suffix to the next smaller one, together with how
far both agree.

A pass goes from left to right with a stack of suffixes that have found no smaller one yet. A new suffix meets the top of the stack; what
the suffixes under it agree upon is known from their own meeting, so words are compared only where nothing is known yet. The match that reaches
furthest right is kept: two suffixes inside its later copy have met already in the earlier one, and what they agreed upon is taken over
as far as the match goes. Words are therefore found equal only beyond everything matched before, and both passes take time linear in the number of words,
for words that can only be compared.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare

#: Words from which on a document's arrays are held as plain numbers, a little slower and a fifth of the size.
LONG = 1 << 20
RUNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def lyndon_edges(words: list[str], ascending: bool = True) -> tuple[list[int], list[int]]:
    """For each position that of the next smaller suffix (the number of words if there is none) and how many words both agree in.

    A suffix that another one continues is the smaller of both, in either order."""
    n = len(words)
    full = (lambda x: [x] * n) if n < LONG else lambda x: array("q", [x]) * n
    after, agree = full(n), full(0)  # next smaller suffix, words in common with it
    before, common = full(-1), full(0)  # the same for the nearest smaller suffix to the left
    text = [*words, None]
    stack = [0]
    end = shift = first = 0  # the furthest match: words from first on are repeated shift later, up to end
    for k in range(1, n):
        top, same = k - 1, 0
        while True:
            if k + same < end and top - shift >= first:  # both met in the earlier copy
                a, b = top - shift, k - shift
                known = agree[a] if after[a] == b else common[b]
                same = known if k + known < end else max(same, end - k)
            while text[top + same] == text[k + same]:
                same += 1
            if k + same > end:
                end, shift, first = k + same, k - top, top
            if k + same < n and (text[k + same] < text[top + same]) != ascending:
                before[k], common[k] = top, same
                break
            after[top], agree[top] = k, same
            stack.pop()
            under = common[top]
            while stack and same < under:  # all of these agree with the one above beyond the word that decided
                top = stack.pop()
                after[top], agree[top] = k, same
                under = common[top]
            if not stack:
                break
            top = stack[-1]
            if same > under:
                before[k], common[k] = top, under
                break
        stack.append(k)
    return after, agree


def periodic_runs(words: list[str], periods: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of at least ``periods`` (3 or more) periods and ``least`` words, by start, then period."""
    n, found = len(words), []
    for ascending in (True, False):
        after, agree = lyndon_edges(words, ascending)
        for k, same in enumerate(agree):
            if not same:
                continue
            end, period = after[k] + same, after[k] - k
            if same < (periods - 2) * period or end == n and not ascending:
                continue  # too short, or found in the other order too
            if k >= period and after[k - period] == k and agree[k - period] >= period:
                continue  # the root before it belongs to the same run
            start = k
            while start and words[start - 1] == words[start - 1 + period]:
                start -= 1
            if end - start >= max(least, periods * period):
                found.append((start, end - start, period))
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words outside of runs, and of each run those of its first period that no other run drops."""
    kept, done = [], 0
    for a, b in sorted((start + period, start + length) for start, length, period in runs):
        if a > done:
            kept += words[done:a]
        done = max(done, b)
    return kept + words[done:]


def repeated_by_id(doc_id: int | None, words: list[str]) -> list[str]:
    """The words of every tenth document (by the CRC-32 of its id) with a periodic tail in place of their own, as the query's contract has it."""
    seed, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or seed % 10 or not n:
        return words
    spread = seed // 10
    start = spread % n
    period = 1 + (n - start) // (3 + spread % 8)
    root = words[start : start + period]
    return words[:start] + (root * -(-(n - start) // period))[: n - start]


def find_periodic_runs(docs: DataFrame, periods: int = 4, least: int = 6, rewrite: Callable[[int | None, list[str]], list[str]] | None = None, with_text: bool = True, with_runs: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_runs, the longest run (ties: least start, then period; nulls without one) with exponent_milli,
    runs_sha256 (each run's ``start,length,period`` and a line feed, by start, then period) and collapsed_sha256.

    A run has at least ``periods`` (3 or more) periods and ``least`` words; words are what ASCII white space separates. Collapsing drops a word if a
    run holds it behind its first period. With ``with_text`` the words kept, joined by single spaces, follow in ``collapsed``; with
    ``with_runs`` all runs in ``runs``. ``rewrite`` changes a document's words first. A null or empty text has no words and no runs, and collapses to the
    empty text. Rows with a null id, and rows that repeat an id, are documents of their own. An empty table gives an empty result; other
    columns play no part. Nothing is shuffled; a task holds one batch of texts and the arrays of one document, and takes time linear in its words.
    """
    if periods < 3 or least < 1:
        raise ValueError("a run takes at least 3 periods, and 1 word")
    prepare(docs.sparkSession)
    schema = RUNS + (", collapsed string" if with_text else "") + (", runs array<struct<start:long,length:long,period:long>>" if with_runs else "")
    kinds = [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
    kinds += [("collapsed", pa.string())] * with_text + [("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))] * with_runs

    def one(doc_id: int | None, text: str | None) -> tuple:
        words = _words(text or "")
        if rewrite:
            words = rewrite(doc_id, words)
        runs = periodic_runs(words, periods, least)
        start, length, period = min(runs, key=lambda run: (-run[1], run[0], run[2]), default=(None, None, None))
        collapsed = " ".join(collapse(words, runs)) if runs else " ".join(words)
        listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        row = (doc_id, len(runs), start, length, period, 1000 * length // period if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed.encode()).hexdigest())
        return row + (collapsed,) * with_text + ([dict(zip(("start", "length", "period"), r)) for r in runs],) * with_runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(i.as_py(), t.as_py()) for i, t in zip(batch.column(0), batch.column(1))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), kinds)], schema=pa.schema(kinds))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _words(text: str) -> list[str]:
    """Words as ASCII white space separates them; other white space is part of a word."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return [w for w in text.translate(_SPACES).split(" ") if w]


_SPACES = {c: " " for c in range(9, 14)}

#: The same by comparing words ``lag`` apart for every lag up to a quarter of the document that two neighbouring multiples of it speak for:
#: a run of four periods holds three places in a row, all multiples of its period (counted from 0), whose words are equal.
SQL = r"""
WITH w0 AS MATERIALIZED (SELECT row_number() OVER () AS row_id, doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM documents),
c AS (SELECT *, CASE WHEN doc_id IS NULL THEN 1 ELSE list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
        flatten([[CAST(ord(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] FOR ch IN string_split(CAST(doc_id AS VARCHAR), '')])),
        lambda r, e: xor(xor(r, e) >> 1, 3988292384 * (xor(r, e) & 1))) END AS r FROM w0),
h AS (SELECT row_id, doc_id, words, len(words) AS n, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(r, 4294967295) END AS h FROM c),
g AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
d AS MATERIALIZED (SELECT row_id, doc_id, n, CASE WHEN n > 0 AND h % 10 = 0 THEN [words[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] FOR i IN range(n)] ELSE words END AS words FROM p),
lags AS (SELECT row_id, n, words, unnest(range(1, n // 4 + 1)) AS q FROM d WHERE n >= 6),
likely AS MATERIALIZED (SELECT row_id, n, q FROM lags WHERE len([m FOR m IN range(2, n // q + 1) IF m * q < n AND words[1 + (m - 2) * q] = words[1 + (m - 1) * q] AND words[1 + (m - 1) * q] = words[1 + m * q]]) > 0),
e AS (SELECT l.row_id, l.n, l.q, unnest([i FOR i IN range(l.n - l.q + 1) IF i + l.q >= l.n OR d.words[1 + i] <> d.words[1 + i + l.q]]) AS i FROM likely l JOIN d USING (row_id)),
s AS (SELECT row_id, q, coalesce(lag(i) OVER (PARTITION BY row_id, q ORDER BY i) + 1, 0) AS start, i FROM e),
r0 AS MATERIALIZED (SELECT row_id, q, start, i + q - start AS length FROM s WHERE i + q - start >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT a.* FROM r0 a WHERE NOT EXISTS (SELECT 1 FROM r0 b WHERE b.row_id = a.row_id AND b.q < a.q AND b.start <= a.start AND b.start + b.length >= a.start + a.length)),
t AS (SELECT row_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed, arg_min({'start': start, 'length': length, 'period': q}, (-length, start, q)) AS best,
    list({'a': start + q, 'b': start + length}) AS cuts FROM runs GROUP BY row_id),
k AS (SELECT d.row_id, array_to_string([d.words[1 + i] FOR i IN range(d.n) IF len([x FOR x IN t.cuts IF x.a <= i AND i < x.b]) = 0], ' ') AS kept FROM d JOIN t USING (row_id))
SELECT d.doc_id, coalesce(t.n_runs, 0) AS n_runs, t.best.start AS start, t.best.length AS length, t.best.period AS period, 1000 * t.best.length // t.best.period AS exponent_milli,
    sha256(coalesce(t.listed, '')) AS runs_sha256, sha256(CASE WHEN t.row_id IS NULL THEN array_to_string(d.words, ' ') ELSE k.kept END) AS collapsed_sha256
FROM d LEFT JOIN t USING (row_id) LEFT JOIN k USING (row_id)
"""
