"""Words, rolling hashes and packed arrays over Arrow buffers, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MASK = (1 << 64) - 1
#: ASCII white space: the separators of words [^\x20\x09-\x0D]+.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTES = np.random.Generator(np.random.PCG64(20240501)).integers(0, 1 << 64, 256, dtype=U64)
_powers: dict[int, np.ndarray] = {}
#: Odd multipliers for bytes in words, for words in windows, and for the second, independent window hash.
BYTE_BASE, WORD_BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base & _MASK, U64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[base] = np.cumprod(steps, dtype=U64)
    return have


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values in which every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(31))
        x *= U64(0x7FB5D329728EA185)
        x ^= x >> U64(27)
        x *= U64(0x81DADEF4BC2DD44D)
        return x ^ (x >> U64(33))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


class Words:
    """The words of some documents: starts and ends in ``data``, and ``first[i]:first[i+1]`` for document i."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, blank: np.ndarray = BLANK, lower: bool = False):
        self.offsets, self.data = offsets, LOWER[data] if lower else data
        n = len(data)
        inside = ~blank[self.data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[edge] = inside[edge]
        edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        ends[edge] = inside[edge]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        assert n == 0 or len(self.start) == len(self.end)

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, U64)
            np.cumsum(_BYTES[self.data] * powers(BYTE_BASE, n)[:n], dtype=U64, out=total[1:])
            return mix((total[self.end] - total[self.start]) * powers(inverse(BYTE_BASE), n)[self.start])


def windows(hashes: np.ndarray, k: int, base: int = WORD_BASE) -> np.ndarray:
    """The hash of each run of k consecutive hashes (one for each place it can start, document borders not looked at)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, U64)
        np.cumsum(hashes * powers(base, n)[:n], dtype=U64, out=total[1:])
        return mix((total[k:] - total[:-k]) * powers(inverse(base), n)[: n - k + 1])


def window_starts(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """True where a window of k words starts that stays within its document; of length max(total - k + 1, 0)."""
    m = max(total - k + 1, 0)
    step = np.zeros(m + 1, np.int64)
    np.add.at(step, np.minimum(np.maximum(first[1:] - k + 1, first[:-1]), m), 1)
    np.add.at(step, np.minimum(first[1:], m), -1)
    return np.cumsum(step)[:m] == 0


def sequence_hash(hashes: np.ndarray, first: np.ndarray, base: int = WORD_BASE) -> np.ndarray:
    """A hash of each document's whole sequence of hashes; its length is part of it."""
    n = len(hashes)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, U64)
        np.cumsum(hashes * powers(base, max(n, 1))[:n], dtype=U64, out=total[1:])
        value = (total[first[1:]] - total[first[:-1]]) * powers(inverse(base), n + 1)[first[:-1]]
        return mix(value ^ mix(np.diff(first).astype(U64) + U64(base & 0xFFFF)))


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes; a longer document stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def ragged(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A binary column whose row i holds the bytes of values[cuts[i]:cuts[i+1]]."""
    raw = np.ascontiguousarray(values).view(np.uint8) if len(values) else np.zeros(0, np.uint8)
    offsets = np.asarray(cuts, np.int64) * values.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(kind or pa.binary())


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """The rows of each run of equal keys in a stream that is sorted by key; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    now: object = None
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(key))
        values = column.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            if held and values[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = values[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def rebatch(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
