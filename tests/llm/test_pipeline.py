import os

import corpus_pipeline as P
import pytest
from corpora import DOCS, clashing, documents

from test_decontaminate import brute as contaminated
from test_line_dedup import brute as lines
from test_minhash import brute as near

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def rows_of(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    first = P.select_quality(spark, docs, DIR)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    kept, all_ = dict(rows_of(first)), dict(rows_of(docs))
    assert first.columns == docs.columns and set(kept.items()) <= set(all_.items())
    assert sum(i in kept for i, q in labels.items() if q == 1) >= 0.9 * sum(q == 1 for q in labels.values())

    second = P.drop_repeated_lines(spark, first, DIR)
    expected = lines(list(kept.items()), 2, 50)
    assert dict(rows_of(second)) == {d: v[3] for d, v in expected.items() if not v[1] or v[1] < v[0]}
    assert second.columns == docs.columns and second.where("n_chars != length(text)").count() == 0

    third = P.drop_near_duplicates(spark, second, DIR)
    now = rows_of(second)
    assert rows_of(third) == [x for x in now if near(now, 5, 80)[x[0]][2]]

    fourth = P.drop_contaminated(spark, third, DIR)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    found = contaminated(rows_of(third), items, 13)
    assert rows_of(fourth) == [x for x in rows_of(third) if not found[x[0]][4]]

    last = P.pack_sequences(spark, fourth, DIR)
    assert {r["doc_id"] for r in last.collect()} == {x[0] for x in rows_of(fourth)}
    whole = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert whole(P.run(spark, DIR)) == whole(last)


def test_awkward_and_empty_input(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "a b c"), (3, "a b c")])
    for rows in (docs, docs.limit(0), spark.createDataFrame([], DOCS)):
        for _, stage in P.STAGES[:-1]:
            rows = stage(spark, rows, DIR)
            assert rows.columns == docs.columns
        P.pack_sequences(spark, rows, DIR).collect()


def test_what_each_stage_keeps_of_odd_rows(spark):
    """Rows without an id stay, rows that repeat one stand or fall together, columns of any name pass through."""
    item = spark.read.parquet(f"{DIR}/benchmark.parquet").where("length(text) > 100").first()["text"]
    plain = " ".join(f"word{i}" for i in range(60))
    rows = [(None, plain), (None, plain), (5, plain), (6, plain + " and one more"), (6, "another text of id 6"), (7, plain), (7, plain), (8, None), (9, ""), (10, item), (None, item)]
    docs = clashing(documents(spark, rows))
    kept = lambda df: sorted((r["doc_id"] or 0, r["text"] or "") for r in df.collect())
    near = P.drop_near_duplicates(spark, docs, DIR)
    assert near.columns == docs.columns and kept(near) == sorted((i or 0, t or "") for i, t in rows if i not in (6, 7))
    clean = P.drop_contaminated(spark, docs, DIR)
    assert clean.columns == docs.columns and kept(clean) == sorted((i or 0, t or "") for i, t in rows if i != 10)
    lines = P.drop_repeated_lines(spark, docs, DIR)
    assert lines.columns == docs.columns and {i for i, _ in kept(lines)} >= {0, 5, 6, 8, 9, 10} and 7 not in {i for i, _ in kept(lines)}
