import math
import os
import random
import re
from collections import Counter

import pytest
from corpora import awkward, clashing, documents
from pyspark.sql import functions as F

from tallyspark.llm import quality as Q
from tallyspark.llm import textkit as tk


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 1) for _ in range(3000)] + [0.25] * 500 + [-1e9, 1e9]
    table = spark.createDataFrame([(v,) for v in values], "score double")
    for k in (1, 2, 900, 1700, 3400, 3502, 9999):
        assert Q.kth_largest(table, k, few=20) == sorted(values, reverse=True)[min(k, len(values)) - 1]
    assert Q.kth_largest(table, 0) == float("inf") and Q.kth_largest(table.limit(0), 5) == float("inf")


def test_selection(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(("ordinary", "words", "make", "up", "plain", "prose", "here")) for _ in range(40))
    bad = lambda: " ".join(rng.choice(("BUY!!", "NOW!!", "%%%", "###")) for _ in range(40))
    rows = [(i, bad() if i % 5 == 0 else good()) for i in range(500)]
    docs, labels = documents(spark, rows), spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 500, 3)] + [(None, 1), (4, None)], "doc_id long, good int")
    got = {r["doc_id"]: r["kept"] for r in Q.select_by_importance(clashing(docs), labels, share=0.8).collect()}
    assert sum(got.values()) == 400 and all(got[i] == (i % 5 > 0) for i in got)
    again = {r["doc_id"]: r["kept"] for r in Q.select_by_importance(docs.repartition(7), labels, share=0.8).collect()}
    assert got == again
    kept = {r["doc_id"] for r in Q.filter_by_importance(docs, labels, share=0.8).collect()}
    assert kept == {i for i in got if got[i]}


def plain_features(text):
    """The features of a text, token by token, in whole numbers."""
    mask = (1 << 64) - 1

    def mix(x):
        x ^= x >> 31
        x = x * 0x7FB5D329728EA185 & mask
        x ^= x >> 27
        x = x * 0x81DADEF4BC2DD44D & mask
        return x ^ x >> 33

    tokens, last = [], {}
    for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\t-\r ]+", (text or "").encode()):
        raw, kind = m[0], 1 if re.match(rb"[0-9A-Za-z\x80-\xff]", m[0]) else 2
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
        code = mix(sum(int(tk._BYTES[b]) * pow(tk.BYTE_BASE, i, 1 << 64) for i, b in enumerate(low)) & mask)
        capitals, size = sum(65 <= b <= 90 for b in raw), len(raw)
        case = 0 if not capitals else 1 if capitals == 1 else 3 if capitals == size else 2
        place = min(size, 15) // 4 if kind == 1 else 4 + min(size, 4) - 1
        tokens.append((code, ((place * 4 + case) * 2 + any(48 <= b <= 57 for b in raw)) * 2 + (last.get(kind) == code)))
        last[kind] = code
    out = [c % Q.BUCKETS for c, _ in tokens] + [2 * Q.BUCKETS + s for _, s in tokens]
    for (c, s), (d, t) in zip(tokens, tokens[1:]):
        out += [Q.BUCKETS + mix((c * 3 + d) & mask) % Q.BUCKETS, 2 * Q.BUCKETS + Q.SHAPES + (s * 128 + t) % Q.SHAPES]
    return out


def test_weights_against_plain_python(spark):
    """Counts, log ratios and weights, computed one document and one feature at a time; a null id is no id, -1 is one."""
    rows = awkward(6)[:140] + [(None, "Null ID words, words words!"), (-1, "minus one, 2 words WORDS"), (-2, "unlabelled text")]
    good = {100, 7, -1, 500, 501, 502, 300}
    labels = [(i, 1) for i in good] + [(503, 0), (-1, 1), (504, 0), (504, 1), (None, 1)]
    found = Q.select_by_importance(documents(spark, rows).repartition(5), spark.createDataFrame(labels, "doc_id long, good int")).collect()
    raw, target = Counter(), Counter()
    for d, text in rows:
        raw.update(plain_features(text))
        if d in good:
            target.update(plain_features(text))
    ratio = {}
    for a, b in zip(Q.FAMILIES.tolist(), Q.FAMILIES.tolist()[1:]):
        r, t = (sum(n for f, n in c.items() if a <= f < b) + b - a for c in (raw, target))
        ratio |= {f: math.log((target[f] + 1) / t) - math.log((raw[f] + 1) / r) for f in raw if a <= f < b}
    want = sorted((str(d), round(sum(ratio[f] for f in plain_features(text)), 6)) for d, text in rows)
    got = sorted((str(r["doc_id"]), round(r["log_weight"], 6)) for r in found)
    assert [d for d, _ in got] == [d for d, _ in want] and all(abs(x - y) < 1e-4 for (_, x), (_, y) in zip(got, want))
    noise = [r["score"] - r["log_weight"] for r in found]
    assert len({round(x, 9) for x in noise}) == len({r["doc_id"] for r in found}) and abs(sum(noise) / len(noise) - 0.577) < 0.5
    share = sum(r[1] for r in {(i, min(g for j, g in labels if j == i)) for i, _ in labels if i is not None}) / len({i for i, _ in labels if i is not None})
    scores = sorted((r["score"] for r in found), reverse=True)
    assert {r["score"] for r in found if r["kept"]} == set(scores[: round(share * len(scores))])


def test_many_equal_scores(spark):
    table = spark.range(30_000).selectExpr("CASE WHEN id < 12000 THEN 1.0 WHEN id < 12001 THEN 1.0000000000000002 ELSE 1.0000000000000004 END AS score")
    for k, value in ((1, 1.0000000000000004), (17_999, 1.0000000000000004), (18_000, 1.0000000000000002), (18_001, 1.0), (29_999, 1.0)):
        assert Q.kth_largest(table.selectExpr("cast(score as double) as score"), k, few=5) == value


def test_edges(spark):
    docs, none = documents(spark, awkward(3) + [(None, "null id"), (6, "word")]), spark.createDataFrame([], "doc_id long, good int")
    assert Q.select_by_importance(docs, none).where("not kept").count() == 0
    assert Q.select_by_importance(docs.limit(0), none).count() == 0 and Q.filter_by_importance(docs.limit(0), none).count() == 0
    weights = {r["doc_id"]: r["log_weight"] for r in Q.select_by_importance(docs, spark.createDataFrame([(100, 1), (7, 0)], "doc_id long, good int")).collect()}
    assert weights[3] == 0 and weights[4] == 0 and weights[5] == 0 and weights[100] == weights[7] != 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out_labels(spark):
    """Fitted on the labels of even ids: the odd ones' junk is rejected, their good documents stay."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    found = Q.select_by_importance(spark.read.parquet(f"{d}/documents.parquet"), labels.where("doc_id % 2 = 0").select("doc_id", F.col("quality").alias("good")))
    odd = found.join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in odd}
    assert kept[1] > 0.98 and kept[0] < 0.1


def test_toxic_words(spark):
    """One insult in a long text decides; toxic labels leave the target and the share."""
    rng = random.Random(4)
    prose = lambda: " ".join(rng.choice(("ordinary", "words", "make", "up", "plain", "prose", "here")) for _ in range(300))
    rows = [(i, prose() + (" you Idiot! " if i % 6 == 0 else " ") + prose()) for i in range(300)] + [(300, None), (301, ""), (None, "an idiot")]
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(0, 300, 2)] + [(1, 1, None), (None, 1, 1)], "doc_id long, good int, toxic int")
    found = Q.select_by_importance(documents(spark, rows), labels).collect()
    assert {r["doc_id"] for r in found if not r["kept"]} == {None, *range(0, 300, 6)} and len(found) == 303
    assert {r["doc_id"] for r in found if r["log_weight"] == float("-inf")} == {None, *range(0, 300, 6)}
    assert {r["doc_id"] for r in Q.filter_by_importance(documents(spark, rows), labels).collect()} == {r["doc_id"] for r in found if r["kept"]}
    assert Q.select_by_importance(documents(spark, rows).limit(0), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_held_out_toxic_labels(spark):
    """Fitted on the labels of even ids: English toxic documents of odd ids are rejected, clean ones stay."""
    d = "/root/testdata/sf0.1"
    labels, docs = spark.read.parquet(f"{d}/labels.parquet"), spark.read.parquet(f"{d}/documents.parquet")
    found = Q.select_by_importance(docs, labels.where("doc_id % 2 = 0").select("doc_id", F.col("quality").alias("good"), "toxic"))
    odd = found.join(labels.where("doc_id % 2 = 1 and quality = 1"), "doc_id").join(docs.select("doc_id", F.expr("lang = 'en'").alias("english")), "doc_id")
    kept = {(r["toxic"], r["english"]): (r["kept"], r["n"]) for r in odd.groupBy("toxic", "english").agg(F.avg(F.col("kept").cast("double")).alias("kept"), F.count("*").alias("n")).collect()}
    clean = [kept[0, e] for e in (True, False)]
    assert kept[1, True][0] < 0.1 and kept[1, False][0] < 0.5 and sum(r * n for r, n in clean) / sum(n for _, n in clean) > 0.98
