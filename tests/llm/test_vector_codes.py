import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.llm import vector_codes as V

KIND = "vec_id long, embedding array<float>, label int"


def by_definition(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(vec_id, code, error, label) by looking at every entry, in plain whole numbers; and the codebooks."""
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    kept = [(i, v + [0] * (parts * width - len(v)), lab) for i, v, lab in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v, p: min(range(len(books[p])), key=lambda e: (gap(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        found = [[best(v, p) for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), f in zip(kept, found) if f[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    out = []
    for i, v, lab in kept:
        codes = [best(v, p) for p in range(parts)]
        out.append((i, bytes(codes).hex(), sum(gap(cut(v, p), books[p][c]) for p, c in enumerate(codes)), lab))
    return out, books


def agree(spark, rows, **options):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    got, books = V.compress_vectors(spark.createDataFrame(rows, KIND).repartition(3).withColumns({c: F.lit("clash") for c in ("code", "error", "x", "of", "ids", "v", "sums")}), **options)
    expected, own = by_definition(rows, **options)
    sums = {}
    for _, _, error, lab in expected:
        sums[lab] = sums.get(lab, 0) + error
    sha = hashlib.sha256(",".join(str(x) for b in own for e in b for x in e).encode()).hexdigest()
    assert books == own
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str((i, c, e, sums[lab], sha)) for i, c, e, lab in expected)


def some(n, size, seed=0, clusters=5):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 0.3) for _ in range(size)] for _ in range(clusters)]
    rows = [(rng.randrange(10**6), [m + rng.gauss(0, 0.05) for m in rng.choice(middle)], rng.choice([None, 1, 2, 3])) for _ in range(n)]
    return rows + rows[:7] + [(rows[3][0], rows[4][1], 1), (None, rows[5][1], None), (5, None, 1), (6, [float("nan")] * size, 1), (7, [0.1, None] + [0.0] * (size - 2), 2), (8, [float("inf")] + [0.0] * (size - 1), 2), (9, [0.0] * size, 2)]


def test_rows(spark):
    agree(spark, some(150, 32))


def test_odd_lengths_and_options(spark):
    agree(spark, some(90, 13) + [(10, [], 1), (11, [0.5], 1)], parts=4, entries=7, rounds=3, scale=100)
    agree(spark, some(60, 8, seed=2, clusters=1), rounds=0)


def test_ties_and_unused_entries(spark):
    agree(spark, [(i, [0.25 * (i % 2)] * 16, i % 3) for i in range(60)])
    agree(spark, [(i, [x / 4096 for x in (i % 5, 0, 0, i % 3)] * 4, None) for i in range(80)], rounds=4)


def test_small_tables(spark):
    agree(spark, some(6, 16)[:3])
    agree(spark, [(1, [], 1), (2, [], None)])
    got, books = V.compress_vectors(spark.createDataFrame([(1, None, 1)], KIND))
    assert got.count() == 0 and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and books == [[]] * 8


def test_large_components(spark):
    agree(spark, [(i, [(-1) ** i * 100.5 * i, 12345.678, -0.0001 * i, 3.0] * 4, 1) for i in range(40)], rounds=2)
    with pytest.raises(ValueError):
        V.compress_vectors(spark.createDataFrame([(1, [1e30], 1)], KIND))


def test_small_blocks_and_many_labels(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 5)
    monkeypatch.setattr(V, "LABELS", 1)
    agree(spark, some(80, 16, seed=4), rounds=2)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 16), st.integers(1, 4), st.integers(1, 6))
def test_search_finds_the_nearest(seed, entries, width, spread):
    rng = np.random.default_rng(seed)
    book, x = rng.integers(-spread, spread + 1, (entries, width)), rng.integers(-2 * spread, 2 * spread + 1, (50, width))
    found, least, looked = V.nearest(x, book, rng.integers(0, entries, 50))
    gaps = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (found == gaps.argmin(axis=1)).all() and (least == gaps.min(axis=1)).all() and looked <= 50 * entries


def test_search_leaves_far_entries_alone():
    rng = np.random.default_rng(1)
    book = rng.integers(-1000, 1000, (16, 8))
    start = rng.integers(0, 16, 1000)
    _, _, looked = V.nearest(book[start] + rng.integers(-20, 21, (1000, 8)), book, start)
    assert looked < 1100
