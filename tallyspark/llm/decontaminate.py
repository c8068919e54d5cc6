"""Benchmark decontamination with DataFrame operations alone.

A benchmark text becomes its windows of ``n`` consecutive normalised words (one window if it is shorter). Each document's word
array is scanned where the document is: a position stays a candidate if the hash of its first two words (of its only word, for
one-word windows) is in the set of hashes that open a window of that length, which is sent along as a bit set (16 bits or more for
a window, two of them set). Candidates are then joined to the broadcast windows on their whole text, which settles every
hit exactly. Only small rows are shuffled.

What is broadcast is bounded: windows are dealt by hash into passes of a bounded number of rows and bytes. One pass serves most
benchmarks. A larger one takes more passes over the documents' words, which are written once for that, so its cost grows in
proportion to the number of passes, memory doesn't, and the result is the same; positions are never shuffled.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keep

#: Everything that is not part of a word, before and after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows (one for each item that has it), and bytes of windows, that are broadcast in a pass.
BROADCAST_WINDOWS, BROADCAST_BYTES = 200_000, 64 << 20
#: Windows of more bytes than that are compared by their SHA-512.
LONG_WINDOW = 1 << 10


def normalised_words(text: Column) -> Column:
    """Words of letters, digits and anything beyond ASCII, A-Z lower-cased (other capitals stay); null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.filter(F.split(lowered, GAP), lambda w: w != "")


def _opening(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(F.get(words, at)) if length == 1 else F.xxhash64(F.get(words, at), F.get(words, at + 1))


def _key(words: Column, at: Column, length: Column) -> Column:
    text = F.array_join(F.slice(words, at + 1, length), " ")
    return F.when(F.octet_length(text) > LONG_WINDOW, F.sha2(text, 512)).otherwise(text)


def benchmark_windows(benchmark: DataFrame, n: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The windows of each item, each once: len, key (its text, or a digest of a very long one), item, opening (the hash that opens it)."""
    items = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), normalised_words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    placed = items.select("item", "w", size.alias("len"), F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("i"))
    opened = F.when(F.col("len") == 1, _opening(F.col("w"), F.col("i"), 1)).otherwise(_opening(F.col("w"), F.col("i"), 2))
    return placed.select("len", _key(F.col("w"), F.col("i"), F.col("len")).alias("key"), "item", opened.alias("opening")).distinct()


def _bits(opening: Column, length: Column, words: int) -> list[tuple[Column, Column]]:
    """The two places of an opening in a bit set of so many 64-bit words (a power of two): word and bit."""
    mixed = F.xxhash64(opening, length)
    return [(F.shiftrightunsigned(mixed, k + 6).bitwiseAND(F.lit(words - 1)).cast("int"), F.shiftrightunsigned(mixed, k).bitwiseAND(F.lit(63)).cast("int")) for k in (0, 32)]


def _bit_set(windows: DataFrame, words: int) -> Column:
    """The bit set of the windows' openings, as a constant of the plan; the driver gets no more than ``words`` rows."""
    places = F.array(*(F.struct(w.alias("word"), b.alias("bit")) for w, b in _bits(F.col("opening"), F.col("len"), words)))
    ones = windows.select(F.explode(places).alias("p")).select("p.word", F.expr("shiftleft(1L, p.bit)").alias("one"))
    bits = [0] * words
    for r in ones.groupBy("word").agg(F.bit_or("one").alias("bits")).collect():
        bits[r["word"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, bits))), ",").cast("array<long>")


def _candidates(words: Column, pairs: Column, lengths: list[int], bits: Column, size: int) -> Column:
    """Positions and lengths at which a window may occur. pairs: the hash of the two words at each position."""
    def of(length: int) -> Column:
        def opens(i: Column) -> Column:
            one, two = _bits(_opening(words, i, 1) if length == 1 else F.get(pairs, i), F.lit(length), size)
            return (F.getbit(F.get(bits, one[0]), one[1]) == 1) & (F.getbit(F.get(bits, two[0]), two[1]) == 1)

        places = F.when(F.size(words) >= length, F.sequence(F.lit(0), F.size(words) - length)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(places, opens), lambda i: F.struct(i.alias("i"), F.lit(length).alias("len"), _key(words, i, F.lit(length)).alias("key")))

    return F.concat(F.array().cast("array<struct<i:int,len:int,key:string>>"), *map(of, lengths))


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS, broadcast_bytes: int = BROADCAST_BYTES, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted strings) and hits.

    A word is hit if it lies in an occurrence of a benchmark window; ``hits`` holds the occurrences as (position, length).
    contaminated: n_hit > 0 and share * n_hit >= n_words. Null and empty texts have no words and are clean; benchmark rows
    without words or with a null id count for nothing; repeated rows are judged each for itself. With ``with_text`` the text
    follows as ``text``, for ``remove_spans``. An empty benchmark leaves everything clean. A pass broadcasts about ``broadcast_windows``
    windows of ``broadcast_bytes`` at most; the result doesn't depend on the number of passes.
    """
    windows = keep(benchmark_windows(benchmark, n), "windows")
    count, size = windows.agg(F.count(F.lit(1)), F.sum(F.octet_length("key") + F.octet_length("item") + 64)).first()
    passes = max(1, -(-count // broadcast_windows), -(-(size or 0) // broadcast_bytes))
    windows = windows.withColumn("pass", F.pmod(F.xxhash64("key", "item"), F.lit(passes)))
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())
    words = 1 << max(6, (-(-count // passes) // 4).bit_length())

    text = ["text"] if with_text else []
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), *([F.col(text_col).alias("text")] if with_text else []), normalised_words(F.col(text_col)).alias("words"))
    if passes > 1:
        rows = keep(rows, "words")
    rows = rows.withColumn("pairs", F.transform(F.col("words"), lambda w, i: F.xxhash64(w, F.get(F.col("words"), i + 1))))
    facts = ["row", "doc_id", *text, F.size("words").cast("long").alias("n_words")]

    def candidates(known: DataFrame) -> Column:
        return _candidates(F.col("words"), F.col("pairs"), lengths, _bit_set(known, words), words)

    def matched(found: DataFrame, known: DataFrame, how: str) -> DataFrame:
        known = known.select(F.col("len").alias("k_len"), F.col("key").alias("k_key"), "item")
        found = found.join(F.broadcast(known), (F.col("c.len") == F.col("k_len")) & (F.col("c.key") == F.col("k_key")), how)
        hit = F.when(F.col("item").isNotNull(), F.struct(F.col("c.i").alias("i"), F.col("c.len").alias("len"))).alias("hit")
        return found.select("row", *(c for c in ("doc_id", *text, "n_words") if c in found.columns), "item", hit)

    if passes == 1:
        found = matched(rows.select(*facts, F.explode_outer(candidates(windows)).alias("c")), windows, "left")
    else:
        found = rows.select(*facts, F.lit(None).cast("string").alias("item"), F.lit(None).cast("struct<i:int,len:int>").alias("hit"))
        for p in range(passes):
            known = windows.where(F.col("pass") == p)
            found = found.unionByName(keep(matched(rows.select("row", F.explode(candidates(known)).alias("c")), known, "inner"), "hits"), allowMissingColumns=True)
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    grouped = found.groupBy("row").agg(*(first(c) for c in ("doc_id", *text, "n_words")), F.collect_set("hit").alias("hits"), F.collect_set("item").alias("found"))
    ends = lambda acc, h: F.greatest(acc["end"], h["i"] + h["len"])
    covered = F.aggregate("hits", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda acc, h: F.struct(ends(acc, h).alias("end"), (acc["n"] + F.greatest(F.lit(0), h["i"] + h["len"] - F.greatest(acc["end"], h["i"]))).alias("n")), lambda acc: acc["n"].cast("long"))
    out = grouped.withColumn("hits", F.array_sort("hits")).withColumn("items", F.array_sort("found")).withColumn("n_hit", covered)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items", "hits", *text,
    )


def remove_spans(found: DataFrame) -> DataFrame:
    """Texts without the hit words: the other normalised words joined by one space; texts without hits stay as they are.

    ``found`` is the result of ``find_contamination`` with its text."""
    words = normalised_words(F.col("text"))
    hit = lambda i: F.exists("hits", lambda h: (h["i"] <= i) & (i < h["i"] + h["len"]))
    return found.withColumn("text", F.when(F.col("n_hit") == 0, F.col("text")).otherwise(F.array_join(F.filter(words, lambda w, i: ~hit(i)), " ")))


#: The same in DuckDB's SQL, for windows of 13 words and a share of 1 in 20.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bi AS (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM bi),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT p.doc_id, p.i, p.n, win.item FROM pos p JOIN win ON win.n = p.n AND win.k = array_to_string(list_slice(p.w, p.i, p.i + p.n - 1), ' ')),
span AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM hit),
cov AS (SELECT doc_id, count(*) AS n_hit FROM span GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(cov.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
       sha256(coalesce(its.items, '')) AS items_sha256, coalesce(cov.n_hit, 0) > 0 AND 20 * coalesce(cov.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""
