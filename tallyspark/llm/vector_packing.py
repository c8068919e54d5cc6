"""Packing of tokenised documents by vector best fit: tokens, documents and attention cost of a sequence are capacities of their own.

A piece takes its tokens, one document and the square of its length (each token attends to its own document) from what a sequence
has left. Pieces are placed longest first, each in the open sequence that has room for it under all three capacities and that a score prefers: the
``norm`` rule takes the least weighted norm of what would be left, the ``dot`` rule the greatest weighted product of what the piece takes and what the
sequence has left. Shares of the capacities are compared, so that the three can be added. Rules are tried in turn, until one needs no more
sequences than the sums of the pieces call for; the one with the fewest sequences counts.

Texts are tokenised where they are read; only pieces (ids, lengths and checksums, no tokens) are dealt anew, evenly and without a key, to tasks
that place ``ROUND`` of them at a time. So each round loses the rest of its last sequences at most, whatever the number of files.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep, prepare

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces placed together, and tasks that place them at most.
ROUND, TASKS = 40_000, 20_000
#: Rules and weights (of tokens, documents, attention cost) in the order in which they are tried.
RULES = (("norm", (1.0, 0.0, 0.0)), ("norm", (1.0, 0.0, 0.2)), ("dot", (1.0, 0.1, -1.0)))

# Characters whose words can be told apart here as the vocabulary's own rule does: Latin letters (but the capital dotted I), digits, general punctuation.
_OTHER = re.compile("[^\t-\r\x20-\x7e\xa0-įı-ȹ‐-‧‰-⁞€]")
_LETTER, _NUMBER = "a-zªµºß-öø-ʯ", "0-9²³¹¼½¾"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")


#: Different words whose ids a worker holds (about 200 bytes each), and characters from which on a text's words aren't listed first.
KNOWN, LONG = 500_000, 1 << 20


def word_bpe(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Token ids as the ``tokenizers`` file (lower case, white space dropped, words apart) gives them, for a list of texts.

    In texts of Latin letters without special tokens the vocabulary's merges are worked out once for each different word; all others go through ``tokenizers`` as a whole."""
    if path not in _encoders:
        _encoders[path] = _word_bpe(path)
    return _encoders[path]


_encoders: dict[str, Callable[[list[str]], list[np.ndarray]]] = {}


def _word_bpe(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    special = re.compile("|".join(re.escape(t.content) for t in whole.get_added_tokens_decoder().values()) or "(?!)")
    model = whole.model
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the vocabulary spells as themselves; the others follow from 256 on
    spelling = {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*plain}))}

    class Known(dict):
        def __missing__(self, word: str) -> bytes:
            spelt = word if word.isascii() else word.encode().decode("latin-1").translate(spelling)
            ids = array("I", [token.id for token in model.tokenize(spelt)]).tobytes()
            if len(word) <= 32:
                if len(self) >= KNOWN:
                    self.clear()
                self[word] = ids
            return ids

    id_of = Known().__getitem__

    def one(text: str) -> np.ndarray:
        if _OTHER.search(text) or special.search(text):
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4")
        lower = text.lower()
        words = _PIECE.findall(lower) if len(lower) < LONG else (m[0] for m in _PIECE.finditer(lower))
        return np.frombuffer(b"".join(map(id_of, words)), "=u4").astype("<u4", copy=False)

    return lambda texts: [one(t) for t in texts]


def vector_best_fit(sizes: np.ndarray, capacities: tuple[int, ...], rule: str, weights: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset (in the first size) of each item, and the number of sequences. Items come by their first size, the largest first;
    of sequences with equal scores the first one is taken. No item may exceed a capacity."""
    n, kinds = sizes.shape
    where, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.empty((kinds, 1024))  # of the open sequences
    number, used, open_ = np.empty(1024, np.int64), 0, 0
    scale = np.sqrt(np.abs(weights)) / np.array(capacities, float)
    least = sizes.min(axis=0) if n else None
    for placed, i in enumerate(np.argsort(-sizes[:, 0], kind="stable").tolist()):
        size = sizes[i]
        fits = left[0, :open_] >= size[0]
        for k in range(1, kinds):
            fits &= left[k, :open_] >= size[k]
        some = np.flatnonzero(fits)
        if len(some):
            score = np.zeros(len(some))
            for k in range(kinds):
                if weights[k]:
                    rest = left[k, some]
                    score += ((rest - size[k]) * scale[k]) ** 2 if rule == "norm" else -np.sign(weights[k]) * (rest * scale[k]) * (size[k] * scale[k])
            best = int(some[np.argmin(score)])
        else:
            if open_ == left.shape[1]:
                left, number = np.concatenate([left, np.empty_like(left)], axis=1), np.concatenate([number, np.empty_like(number)])
            best, open_ = open_, open_ + 1
            left[:, best], number[best] = capacities, used
            used += 1
        where[i], at[i] = number[best], capacities[0] - int(left[0, best])
        left[:, best] -= size
        if placed % 256 == 255:  # close what not even the least item fits in
            alive = np.flatnonzero((left[:, :open_] >= least[:, None]).all(axis=0))
            if len(alive) < open_:
                left[:, : len(alive)], number[: len(alive)] = left[:, alive], number[alive]
                open_ = len(alive)
    return where, at, used


def fewest(sizes: np.ndarray, capacities: tuple[int, ...], rules=RULES) -> tuple[np.ndarray, np.ndarray, int]:
    """The placement by the first of the rules that needs the fewest sequences; later rules are tried only while fewer are conceivable."""
    bound = max((-(-int(total) // capacity) for total, capacity in zip(sizes.sum(axis=0), capacities)), default=0)
    best = None
    for rule, weights in rules:
        found = vector_best_fit(sizes, capacities, rule, weights)
        best = found if best is None or found[2] < best[2] else best
        if best[2] <= bound:
            break
    return best


def pack_vectors(
    docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[np.ndarray]]], capacity: int = 2048, most_docs: int | None = None, most_attention: int | None = None, rules=RULES, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A sequence holds at most ``capacity`` tokens, ``most_docs`` pieces and an attention cost (the sum of squared lengths) of ``most_attention``; without
    the latter two, what ``capacity`` implies. A document is its ids (``encoder`` is called once in each task and returns a function from texts to arrays of
    ids) and ``end_id``; it is cut only if it is longer than a sequence, or than the root of its attention cost, into pieces of that length and a rest. A null or
    empty text is the separator alone. Rows with a null id, or that repeat an id, are documents of their own. Sequence ids are unique: the task's number times
    2**40 plus a running number. With ``with_ids`` the ids of each piece follow in ``ids`` (and are shuffled). An empty table gives an empty result; other
    columns play no part. Pieces are written to the shared folder once, without their tokens, and counted there.
    """
    most_docs, most_attention = most_docs or capacity, most_attention or capacity**2
    if not 0 < capacity < 1 << 20 or most_docs < 1 or most_attention < 1 or not rules:
        raise ValueError("capacities must be positive, that of tokens below 2**20, and a rule is needed")
    prepare(docs.sparkSession)
    longest, capacities = min(capacity, isqrt(most_attention)), (capacity, most_docs, most_attention)
    fields = PIECES + (", ids array<long>" if with_ids else "")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), []
            for key, ids in zip(keys, chain.from_iterable(encode([t or "" for t in batch.column(1).slice(i, 64).to_pylist()]) for i in range(0, len(keys), 64))):
                ids = np.append(ids, np.array([end_id], "<u4")).astype("<u4", copy=False)
                for k, a in enumerate(range(0, len(ids), longest)):
                    part = ids[a : a + longest]
                    rows.append((key, k, a, len(part), zlib.crc32(part.tobytes())) + (part.tolist(),) * with_ids)
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    pieces = keep(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, fields), "pieces")
    tasks = max(1, min(TASKS, -(-pieces.count() // ROUND)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, held, rows = TaskContext.get().partitionId() << 40, [], 0

        def placed() -> Iterator[pa.RecordBatch]:
            nonlocal base
            table = pa.Table.from_batches(held)
            length = table["length"].to_numpy()
            where, at, used = fewest(np.stack([length, np.ones_like(length), length**2], axis=1), capacities, rules)
            out = table.append_column("sequence_id", pa.array(base + where)).append_column("offset", pa.array(at))
            base += used
            yield from out.to_batches(20_000)

        for batch in batches:
            for i in range(0, batch.num_rows, ROUND):
                part = batch.slice(i, ROUND)
                if rows and rows + part.num_rows > 2 * ROUND:
                    yield from placed()
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield from placed()

    return pieces.repartition(tasks).mapInArrow(place, fields + ", sequence_id long, offset long").select(*names[:5], "sequence_id", "offset", *names[5:])
