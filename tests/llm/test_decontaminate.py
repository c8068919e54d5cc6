import hashlib
import re

import pytest
from corpora import awkward, clashing, documents

from tallyspark.llm.decontaminate import find_contamination, remove_spans

GAP = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in GAP.split(low) if w]


def brute(rows, items, n):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = {}
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[tuple(w[i : i + k])]
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("bound", [200_000, 150])  # one pass, and several
def test_against_plain_python(spark, bound):
    rows = awkward(4)
    source = {d: t for d, t in rows}
    long = source[603].split()
    items = [(1, " ".join(long[40:60]).upper()), (2, source[300]), (10, "Word"), (11, "NAÏVE café"), (12, "naïve, CAFÉ!"), (13, None), (14, "..."), (15, source[500][:30]), (9, " ".join(long[45:58])), (9, "same same"), (16, "nowhere to be found in any of these documents at all, not one of them")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = find_contamination(clashing(documents(spark, rows)).repartition(3), benchmark, broadcast_windows=bound, with_text=True)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found.collect()}
    assert got == brute(rows, items, 13) and sum(v[4] for v in got.values()) > 3
    cleaned = {r["doc_id"]: r["text"] for r in remove_spans(found).collect()}
    assert cleaned[6] == "" and cleaned[4] == "" and cleaned[3] is None and all(len(words(cleaned[d])) == v[0] - v[1] for d, v in got.items())


def test_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark, [(1, "a b"), (1, "a b"), (2, None)])
    assert [r["contaminated"] for r in find_contamination(docs, none).collect()] == [False] * 3
    assert find_contamination(docs.limit(0), none).count() == 0


def test_no_python_in_the_plan(spark):
    found = find_contamination(documents(spark, [(1, "a b")]), spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
