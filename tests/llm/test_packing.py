import zlib

import numpy as np
import public_tokenizers
import pytest
from corpora import awkward, clashing, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm.packing import best_fit_decreasing, byte_bpe, pack
from tallyspark.llm.queries import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80))
def test_best_fit(lengths):
    where, at, used = best_fit_decreasing(np.array(lengths, np.int64), 32)
    rooms: list[int] = []  # the same by looking at every open sequence
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in rooms if r >= lengths[i]]
        room = min(fits, default=32)
        if fits:
            rooms.remove(room)
        if room > lengths[i]:
            rooms.append(room - lengths[i])
        assert at[i] == 32 - room
    filled: dict[int, list] = {}
    for w, a, n in zip(where.tolist(), at.tolist(), lengths):
        filled.setdefault(w, []).append((a, n))
    assert sorted(filled) == list(range(used))
    for pieces in filled.values():
        end = 0
        for a, n in sorted(pieces):
            assert a == end
            end += n
        assert end <= 32


def test_both_encoders_agree():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    texts = [t or "" for _, t in awkward(0)] + ["<|endoftext|> in a text", "emoji 😀 日本語", "it's  two\n\n spaces ", "ÀÉîõü ñ ß 123,456.7", "\x00\x01\x7f", "a" * 5000]
    assert [x.tolist() for x in byte_bpe(PATH)(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("blank", [" ", "\n", "\t", "\r\n", "\x0b\x0c", "\x85\xa0", " \n\t"])
def test_long_white_space(blank):
    from tokenizers import Tokenizer

    whole, encode = Tokenizer.from_file(PATH), byte_bpe(PATH)
    for n in (999, 1000, 1_000_000):
        text = "x" + blank * (n // len(blank)) + "y"
        assert encode([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_documents_with_long_white_space(spark):
    rows = [(1, "x" + " " * 1_000_000 + "y"), (2, "x" + "\n" * 1_000_000 + "y"), (3, "a b")]
    got = pack(documents(spark, rows), encoder).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in got} == {i: len(e) + 1 for (i, t), e in zip(rows, byte_bpe(PATH)([t for _, t in rows]))}


@pytest.mark.parametrize("capacity", [1024, 16])
def test_pieces_make_the_documents_again(spark, capacity):
    rows = awkward(1) + [(6, "again and again"), (None, "no id")]
    got = pack(clashing(documents(spark, rows)).repartition(3), encoder, capacity=capacity, with_ids=True).collect()
    ids = {(d, tuple(e.tolist() + [0])) for (d, _), e in zip(rows, byte_bpe(PATH)([t or "" for _, t in rows]))}
    docs, sequences = {}, {}
    for r in got:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {(k[0], tuple(x for _, part in sorted(v) for x in part)) for k, v in docs.items()} == ids
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(r["length"] for r in got)
    assert len(sequences) * capacity <= 1.15 * total + 3 * capacity


def test_edges(spark):
    assert pack(documents(spark, [(1, "a")]).limit(0), encoder).count() == 0
    assert [tuple(r)[:3] for r in pack(documents(spark, [(1, None)]), encoder).collect()] == [(1, 0, 1)]
    with pytest.raises(ValueError):
        pack(documents(spark, [(1, "a")]), encoder, capacity=0)
