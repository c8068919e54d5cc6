import numpy as np
import pytest

from tallyspark.llm import embedding_dedup
from tallyspark.llm.embedding_dedup import link_embeddings
from tallyspark.llm.graph import components


def brute(rows, threshold):
    good = {i: np.array(v, float) for i, v in enumerate(r[1] for r in rows) if v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))}
    ids = [r[0] for r in rows]
    near = {i: set() for i in range(len(rows))}
    for i, x in good.items():
        for j, y in good.items():
            if i != j and (x / np.abs(x).max()) @ (y / np.abs(y).max()) / np.linalg.norm(x / np.abs(x).max()) / np.linalg.norm(y / np.abs(y).max()) >= threshold:
                near[i].add(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min(ids[j] for j in seen)
        out.append((ids[i], len(near[i]), least, ids[i] == least))
    return sorted(out)


@pytest.mark.parametrize(("size", "block"), [(3, 40), (24, 64), (40, 4096)])
def test_against_all_pairs(spark, size, block):
    rng = np.random.default_rng(size)
    rows = [(int(i), rng.normal(size=size).tolist()) for i in range(120)]
    centre = rng.normal(size=size)
    rows += [(1000 + i, (centre + rng.normal(size=size) * 0.2).tolist()) for i in range(80)] + [(2000 + i, centre.tolist()) for i in range(60)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * size), (5003, [None] + [1.0] * (size - 1)), (5004, [float("nan")] * size), (5005, [float("inf")] * size), (5006, [1e308] * size), (5007, [1e-308] * size), (-5, centre.tolist())]
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, unit string").repartition(4)
    got = sorted(tuple(r)[:4] for r in link_embeddings(table, 0.9, block=block).collect())
    assert got == brute(rows, 0.9)


def test_long_vectors_need_little_of_the_driver(spark):
    import time

    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4096).tolist()) for i in range(3)] + [(7, [1.0])]
    rows.append((9, rows[0][1]))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    began = time.perf_counter()
    got = sorted(tuple(r) for r in link_embeddings(table).collect())
    assert got == [(0, 1, 0, True), (1, 0, 1, True), (2, 0, 2, True), (7, 0, 7, True), (9, 1, 0, False)]
    assert time.perf_counter() - began < 30


def test_the_axes_are_the_principal_ones(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 60)) * np.geomspace(1, 0.01, 60) @ np.linalg.qr(rng.normal(size=(60, 60)))[0]
    axes = embedding_dedup._axes(spark.createDataFrame([(v.tobytes(),) for v in x], "unit binary"), 60)
    best = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    assert axes.shape == (60, 32) and np.abs(axes.T @ axes - np.eye(32)).max() < 1e-10
    assert all(abs(best[:, i] @ axes[:, i]) > 0.999 for i in range(12))


def test_empty_and_null_ids(spark):
    schema = "vec_id long, embedding array<float>"
    assert link_embeddings(spark.createDataFrame([], schema)).count() == 0
    got = link_embeddings(spark.createDataFrame([(None, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])], schema)).collect()
    assert [tuple(r) for r in got] == [(2, 1, 2, True)] * 2
    assert [tuple(r) for r in link_embeddings(spark.createDataFrame([(1, None)], schema)).collect()] == [(1, 0, 1, True)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(3, 3), (None, 1), (900, 901), (901, 900)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 700)} | {900: 900, 901: 900}


def test_blocks_hold_ties_apart(spark, monkeypatch):
    """Most vectors stand at the same place of the first axis; blocks are no larger for that."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 8)) * np.array([3, 3, 1, 1, 1, 1, 1, 1])
    x[:1400, :2] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    blocks = []
    monkeypatch.setattr(embedding_dedup, "forget", lambda _, folder: blocks.append(folder))  # else the blocks are gone once they are compared
    got = sorted(tuple(r)[:4] for r in link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.97, block=100).collect())
    assert len(blocks) == 1 and spark.read.parquet(blocks[0]).groupBy("block").count().agg({"count": "max"}).first()[0] < 150
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    assert [r[1] for r in got] == ((unit @ unit.T >= 0.97).sum(axis=1) - 1).tolist()
