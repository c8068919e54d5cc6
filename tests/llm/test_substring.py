import hashlib

import pytest
from corpora import awkward, clashing, documents

from tallyspark.llm.substring_dedup import dedup_substrings


def brute(rows, window):
    first, out = {}, {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first.setdefault(tuple(words[i : i + window]), doc) < doc:
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[doc] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


@pytest.mark.parametrize(("window", "seed"), [(50, 0), (6, 1), (5, 2), (2, 3)])
def test_against_all_windows(spark, window, seed):
    rows = awkward(seed)
    got = {r["doc_id"]: tuple(r)[1:] for r in dedup_substrings(clashing(documents(spark, rows).repartition(5)), window).collect()}
    assert got == brute(rows, window) and any(v[1] for v in got.values())


def test_edges(spark):
    assert dedup_substrings(documents(spark, [(1, "a")]).limit(0), 5).count() == 0
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text), (1, text), (None, text), (2, text)]  # rows of one id are not earlier than each other
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in dedup_substrings(documents(spark, rows), 5).collect())
    assert got == [(1, 20, 0), (1, 20, 0), (2, 20, 20)]
    with pytest.raises(ValueError):
        dedup_substrings(documents(spark, rows), 1)
