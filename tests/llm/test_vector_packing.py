import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from corpora import awkward, clashing, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyspark.llm import vector_packing as V
from tallyspark.llm.queries import word_encoder

WHOLE = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def test_words_have_the_ids_of_the_whole_text():
    rng, encode = random.Random(3), word_encoder()
    letters = [chr(c) for c in [*range(1, 128), *range(0x80, 0x23F), *range(0x250, 0x2B0), *range(0x2000, 0x2060), 0x20AC, 0x3C2, 0x301, 0x1E9E, 0x2C65, 0x6771]]
    texts = ["".join(rng.choices([rng.choice(letters) for _ in range(6)] + ["'s", "'LL", "I'd", " ", "é", "a", "  "], k=rng.randint(0, 14))) for _ in range(6000)]
    texts += [t or "" for _, t in awkward(0)] + ["<|endoftext|> in a text", "<|ENDOFTEXT|>", "日本 東京", "", " \n\t ", "x" + " " * 1_000_000 + "y", "\n" * 1_000_000, "a" * 50_000, "it's 12.5% of 'quoted' text" * 20_000]
    for text, found in zip(texts, encode(texts)):
        assert found.tolist() == ids(text), text[:80]


def test_more_words_than_are_held(monkeypatch):
    monkeypatch.setattr(V, "KNOWN", 50)
    monkeypatch.setattr(V, "LONG", 40)
    encode = V._word_bpe(public_tokenizers.path("word_bpe_49k.json"))
    texts = [t or "" for _, t in awkward(2)]
    assert [x.tolist() for x in encode(texts)] == [ids(t) for t in texts]


def by_definition(sizes, capacities, rule, weights):
    """The same by looking at every sequence for each piece, in exact order."""
    left, where = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i][0]):
        best = None
        for s, rest in enumerate(left):
            if all(r >= x for r, x in zip(rest, sizes[i])):
                if rule == "norm":
                    score = sum(abs(w) * ((r - x) / c) ** 2 for w, r, x, c in zip(weights, rest, sizes[i], capacities))
                else:
                    score = -sum(w * r / c * x / c for w, r, x, c in zip(weights, rest, sizes[i], capacities))
                if best is None or score < best[0] - 1e-12:
                    best = score, s
        if best is None:
            left.append(list(capacities))
            best = 0, len(left) - 1
        where[i] = best[1]
        left[best[1]] = [r - x for r, x in zip(left[best[1]], sizes[i])]
    return where


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 32), min_size=1, max_size=60), st.integers(1, 6), st.integers(300, 1024), st.sampled_from(V.RULES + (("dot", (1.0, 1.0, 1.0)), ("norm", (0.5, 1.0, 2.0)))))
def test_vector_best_fit(lengths, most_docs, most_attention, rule):
    lengths = [min(n, int(most_attention**0.5)) for n in lengths]
    sizes, capacities = np.array([(n, 1, n * n) for n in lengths]), (32, most_docs, most_attention)
    where, at, used = V.vector_best_fit(sizes, capacities, *rule)
    totals, ends = {}, {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        s = int(where[i])
        assert at[i] == ends.get(s, 0)
        ends[s] = ends.get(s, 0) + lengths[i]
        totals[s] = totals.get(s, 0) + sizes[i]
    assert all((t <= capacities).all() for t in totals.values()) and sorted(totals) == list(range(used))
    rooms = by_definition(sizes.tolist(), capacities, *rule)
    assert len(set(rooms)) == used
    assert V.fewest(sizes, capacities)[2] <= V.vector_best_fit(sizes, capacities, *V.RULES[0])[2]


@pytest.mark.parametrize("limits", [{}, {"most_docs": 3}, {"most_attention": 900_000}, {"capacity": 64, "most_docs": 4, "most_attention": 2500}])
def test_pieces_make_the_documents_again(spark, limits):
    rows = awkward(1) + [(6, "again and again"), (None, "no id")]
    got = V.pack_vectors(clashing(documents(spark, rows)).repartition(3), word_encoder, with_ids=True, **limits).collect()
    capacity = limits.get("capacity", 2048)
    longest = min(capacity, int(limits.get("most_attention", capacity**2) ** 0.5))
    expected = []
    for d, t in rows:
        own = ids(t) + [0]
        expected += [(str(d), k, a, tuple(own[a : a + longest])) for k, a in enumerate(range(0, len(own), longest))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], tuple(r["ids"])) for r in got) == sorted(expected)
    sequences = {}
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity and len(pieces) <= limits.get("most_docs", capacity) and sum(n * n for _, n in pieces) <= limits.get("most_attention", capacity**2)
    if not limits:  # nothing is lost but the last sequence's rest
        assert len(sequences) == -(-sum(r["length"] for r in got) // capacity)


def test_rounds(spark, monkeypatch):
    monkeypatch.setattr(V, "ROUND", 25)
    monkeypatch.setattr(V, "TASKS", 2)
    rows = awkward(4)
    got = V.pack_vectors(documents(spark, rows).repartition(4), word_encoder, capacity=256).collect()
    fill = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert sum(fill.values()) == sum(len(ids(t)) + 1 for _, t in rows) and max(fill.values()) <= 256


def test_edges(spark):
    assert V.pack_vectors(documents(spark, [(1, "a")]).limit(0), word_encoder).count() == 0
    assert [tuple(r)[:4] for r in V.pack_vectors(documents(spark, [(1, None)]), word_encoder).collect()] == [(1, 0, 0, 1)]
    for wrong in ({"capacity": 0}, {"rules": ()}, {"most_docs": -1}):
        with pytest.raises(ValueError):
            V.pack_vectors(documents(spark, [(1, "a")]), word_encoder, **wrong)
