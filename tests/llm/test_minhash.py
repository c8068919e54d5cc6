import random

import pytest
from corpora import awkward, clashing, documents

from tallyspark.llm.minhash import Circulant, near_duplicates, shingle_sets


def brute(rows, k, percent):
    sets = {}
    for d, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    near = {d: set() for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                near[a].add(b)
                near[b].add(a)
    out = {}
    for d in ids:
        seen, todo = {d}, [d]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[d] = (len(sets[d]), min(seen), d == min(seen))
    return out


@pytest.mark.parametrize(("k", "seed"), [(2, 0), (5, 1), (1, 2)])
def test_against_all_pairs(spark, k, seed):
    rows = awkward(seed)
    found = near_duplicates(clashing(documents(spark, rows)).repartition(4), shingle=k)
    assert {r["doc_id"]: tuple(r)[1:] for r in found.collect()} == brute(rows, k, 80)


def chains(seed=0, groups=4, size=40):
    """Chains of documents, each a few words from the one before, so that many are linked but not with the least."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        words = [f"g{g}w{i}" for i in range(60)]
        for i in range(size):
            rows.append((1000 * g + rng.randrange(10**6) * 10_000, " ".join(words)))
            for _ in range(2):
                words[rng.randrange(60)] = f"g{g}n{i}r{rng.random()}"
    return rows


@pytest.mark.parametrize("chunk", [2048, 16])
def test_links_that_no_star_finds(spark, chunk):
    """With one-row bands whole chains share buckets: most links must come from the second round, in chunks too."""
    rows = chains()
    found = near_duplicates(documents(spark, rows), shingle=1, percent=90, bands=40, rows=2, sketch=0.5, chunk=chunk)
    assert {r["doc_id"]: tuple(r)[1:] for r in found.collect()} == brute(rows, 1, 90)


def test_edges(spark):
    assert near_duplicates(documents(spark, [(1, "a")]).limit(0)).count() == 0
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "A  b\nc"), (3, None), (4, "")]
    got = sorted(tuple(r) for r in near_duplicates(documents(spark, rows)).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_signatures_estimate_jaccard():
    import numpy as np

    rng = np.random.default_rng(0)
    both, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (800, 100, 100))
    values = np.concatenate([both, a, both, b])
    s = Circulant(512).signatures(values, np.array([0, 900, 1800, 1800]))
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.07 and (s[2] == s[2].max()).all()
    v, cuts = shingle_sets(np.array([0, 5, 5, 6]), np.frombuffer(b"a b a", np.uint8).tolist() and np.frombuffer(b"a b ax", np.uint8), 2)
    assert cuts.tolist() == [0, 2, 2, 3] and len(v) == 3
