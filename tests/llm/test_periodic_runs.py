import hashlib
import itertools
import random

import pytest
from corpora import awkward, clashing, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm.periodic_runs import _words, collapse, find_periodic_runs, lyndon_edges, periodic_runs, repeated_by_id


def by_definition(words, periods=4, least=6):
    n, found = len(words), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - a
            smaller = any(all(words[x] == words[x + r] for x in range(a, a + length - r)) for r in range(1, q))
            if i > a and length >= max(least, periods * q) and not smaller:
                found.append((a, length, q))
            i += i == a
    return sorted(found, key=lambda run: (run[0], run[2]))


def test_every_short_text_of_two_words():
    for n in range(13):
        for words in itertools.product("ab", repeat=n):
            assert periodic_runs(list(words)) == by_definition(words)
            assert periodic_runs(list(words), 3, 1) == by_definition(words, 3, 1)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.integers(1, 8), st.lists(st.sampled_from("abc"), max_size=6), st.integers(1, 6), st.lists(st.sampled_from("abc"), max_size=8))
def test_nested_and_overlapping_runs(head, times, root, again, tail):
    words = ((head + root * times) * again + tail)[:120]
    assert periodic_runs(words) == by_definition(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=30), st.booleans())
def test_next_smaller_suffixes(words, ascending):
    suffix = lambda i: [w if ascending else -w for w in words[i:]]
    after, agree = lyndon_edges(words, ascending)
    for i in range(len(words)):
        j = next((j for j in range(i + 1, len(words)) if suffix(j) < suffix(i)), len(words))
        assert after[i] == j
        assert agree[i] == next((x for x in range(len(words) - j) if words[i + x] != words[j + x]), len(words) - j)


def test_plain_numbers_for_long_documents(monkeypatch):
    from tallyspark.llm import periodic_runs as P

    rng = random.Random(7)
    texts = [[rng.choice("ab") for _ in range(rng.randint(0, 60))] for _ in range(300)]
    expected = [periodic_runs(t) for t in texts]
    monkeypatch.setattr(P, "LONG", 0)
    assert [periodic_runs(t) for t in texts] == expected


class Counted(str):
    """A word that counts how often it is compared and that can't be hashed."""

    compared = 0
    __hash__ = None

    def __eq__(self, other):
        Counted.compared += 1
        return other is not None and str.__eq__(self, other)


@pytest.mark.parametrize("size", [1_000, 30_000])
def test_comparisons_grow_with_the_words(size):
    def fibonacci():
        a, b = ["x"], ["x", "y"]
        while len(b) < size:
            a, b = b, b + a
        return b[:size]

    def nested():
        words = ["x"]
        for level in itertools.count():
            if len(words) >= size:
                return words[:size]
            words = words * 4 + [f"w{level}"]

    for words in (["x"] * size, ["x", "y"] * (size // 2), fibonacci(), nested(), [w for i in range(1, int((2 * size) ** 0.5)) for w in ["x"] * i + ["y"]]):
        for ascending in (True, False):
            Counted.compared = 0
            lyndon_edges([Counted(w) for w in words], ascending)
            assert Counted.compared <= 4 * len(words)


def test_words_and_texts():
    import re

    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0 é") for _ in range(rng.randint(0, 30)))
        assert _words(text) == re.findall(r"[^\x20\x09-\x0D]+", text)


def test_documents(spark):
    rows = awkward(5) + [(6, "again and again"), (None, "no id " * 9), (700, "a b " * 3 + "a b c " * 7 + "c " * 9), (701, "x " * 200_000 + "y z " * 40_000), (20, "one two three four five six seven eight nine ten " * 3)]
    got = find_periodic_runs(clashing(documents(spark, rows)).repartition(3), rewrite=repeated_by_id, with_runs=True).collect()
    assert len(got) == len(rows)
    expected = []
    for i, text in rows:
        words = repeated_by_id(i, _words(text or ""))
        runs = by_definition(words) if len(words) < 3000 else periodic_runs(words)
        kept = [w for k, w in enumerate(words) if not any(a + q <= k < a + n for a, n, q in runs)] if len(runs) * len(words) < 10**6 else collapse(words, runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        expected.append((str(i), len(runs), *best, best[2] and 1000 * best[1] // best[2], " ".join(kept), runs))
    for r in got:
        assert r["collapsed_sha256"] == hashlib.sha256(r["collapsed"].encode()).hexdigest()
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{x['start']},{x['length']},{x['period']}\n" for x in r["runs"]).encode()).hexdigest()
    plain = [(str(r["doc_id"]), r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["collapsed"], [tuple(x) for x in r["runs"]]) for r in got]
    assert sorted(plain, key=str) == sorted(expected, key=str)
    assert {r["doc_id"] for r in got if r["n_runs"]} >= {700, 701, 604}


def test_edges(spark):
    assert find_periodic_runs(documents(spark, [(1, "a")]).limit(0)).count() == 0
    one = find_periodic_runs(documents(spark, [(1, None)])).first()
    assert (one["n_runs"], one["start"], one["collapsed"]) == (0, None, "")
    with pytest.raises(ValueError):
        find_periodic_runs(documents(spark, [(1, "a")]), periods=2)
