"""Packing of tokenised documents into fixed-length sequences by best fit decreasing.

``pack`` tokenises whole texts, ends each document with a separator id, cuts what is longer than a sequence into full
windows and a rest, and places the rests and the short documents, longest first, in the open sequence with the least room
that still holds them. The open sequences are found through a segment tree indexed by remaining capacity: a node says
whether any sequence with a room in its range is open, so the tightest fit takes O(log capacity).

Every task packs the documents of its own partition, in rounds of a bounded number of pieces: nothing is shuffled and no
task holds more than one round's piece list (not its tokens). Padding comes from the last sequences of a round only.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Pieces placed together; bounds the memory of a task whatever the size of its partition.
ROUND = 200_000


class CapacityTree:
    """Counts of open sequences by remaining room, as a segment tree over 0..capacity."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        node = self.size + room
        while node:
            self.any[node] += 1
            node >>= 1

    def tightest(self, need: int) -> int:
        """The least room >= need of an open sequence, or -1."""
        node, least = self.size + need, self.any
        if least[node]:
            return need
        while node > 1:  # climb to the first right sibling that has something open
            if not node & 1 and least[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if least[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return -1

    def take(self, room: int) -> int:
        node = self.size + room
        while node:
            self.any[node] -= 1
            node >>= 1
        return self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece (all of 1..capacity), and the number of sequences. Ties go by position."""
    where, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = CapacityTree(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = tree.tightest(need)
        if room < 0:
            sequence, room = used, capacity
            used += 1
        else:
            sequence = tree.take(room)
        where[i], at[i] = sequence, capacity - room
        if room > need:
            tree.add(room - need, sequence)
    return where, at, used


def byte_bpe(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Token ids as the ``tokenizers`` file gives them, for a list of texts.

    Where the file has a rank table of the same vocabulary beside it (same name, ``.tiktoken``), Latin texts without special
    tokens take that faster encoder, whose ids are the same; every other text goes through ``tokenizers`` itself, and so does a
    text with a thousand white-space characters in a row, which the faster encoder reads recursively.
    """
    import base64
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    beside = re.sub(r"\.json$", ".tiktoken", path)
    fast, other = None, re.compile("[^\x00-ɏ]|\\s{1000}" + "".join(f"|{re.escape(s)}" for s in special))
    if beside != path and os.path.exists(beside):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(beside, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(fast(t) if fast and not other.search(t) else whole.encode(t, add_special_tokens=False).ids, "<u4") for t in texts]

    return encode


def _pieces(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int]]:
    raw = memoryview(ids.astype("<u4", copy=False).tobytes())
    return [(a, min(capacity, len(ids) - a), zlib.crc32(raw[4 * a : 4 * min(a + capacity, len(ids))])) for a in range(0, len(ids), capacity)]


def pack(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[np.ndarray]]], capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: its document's id, start, length, CRC-32 of its ids, the document's tokens, sequence and offset.

    ``encoder`` is called once in each task and returns a function from texts to arrays of ids. A null or empty text is the
    separator alone. Rows with the same id are separate documents. Sequence ids are unique: the partition's number times
    2**40 plus a running number. Pieces of equal length are placed in the order of the rows, open sequences of equal room last opened first. A sequence is to be padded to ``capacity`` by its reader unless its length is a power of two.
    With ``with_ids`` the ids of each piece follow in column ``ids``. An empty table gives an empty result. Other columns of
    ``docs`` play no part.
    """
    if not 0 < capacity < 1 << 20:
        raise ValueError("capacity must be positive and below 2**20")
    prepare(docs.sparkSession)
    schema = PIECES + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        base, encode = (context.partitionId() if context else 0) << 40, encoder()
        rows: list[tuple] = []
        kept: list[list[int]] = []

        def placed() -> Iterator[pa.RecordBatch]:
            nonlocal base
            doc, start, length, crc, tokens = (np.array([v or 0 for v in x], np.int64) for x in zip(*rows))
            where, at, used = best_fit_decreasing(length, capacity)
            columns = [doc, start, length, crc, tokens, base + where, at]
            base += used
            null = np.array([r[0] is None for r in rows]) if any(r[0] is None for r in rows) else None
            arrays = [pa.array(c, mask=null if i == 0 else None) for i, c in enumerate(columns)] + ([pa.array(kept, pa.list_(pa.int64()))] if with_ids else [])
            out = pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids)
            for i in range(0, out.num_rows, 20_000):
                yield out.slice(i, 20_000)
            rows.clear()
            kept.clear()

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i in range(0, len(keys), 256):
                texts = [t or "" for t in batch.column(1).slice(i, 256).to_pylist()]
                for key, ids in zip(keys[i : i + 256], encode(texts)):
                    ids = np.append(ids, np.array([end_id], "<u4"))
                    for a, n, crc in _pieces(ids, capacity):
                        rows.append((key, a, n, crc, len(ids)))
                        if with_ids:
                            kept.append(ids[a : a + n].tolist())
                if len(rows) >= ROUND:
                    yield from placed()
        if rows:
            yield from placed()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
