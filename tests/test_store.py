import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import merge as M
from tallyspark.operators import receipts as R
from tallyspark.sources import store
from tallyspark.streaming import changes as C

SHARDS = "ord long, id string, _schema string, owner_email string, shard_index string, receipt_metadata string"
PARTS = 8


def files(path):
    return {f.removeprefix(path + "/") for f in glob.glob(f"{path}/part=*/*.parquet")}


def tables(spark, n=40):
    shards = [(i, f"s{i}", "receipt_shard", "o", str(i), json.dumps({f"r{i}-{k}": {"vendor": f"v{k}", "total": k, "category": "c", "purchase_date": "2026-01-02", "subtotal": 1, "tax": 0} for k in range(3)})) for i in range(n)]
    details = [(f"s{i}", f"r{i}-{k}", json.dumps({"vendor": "d", "extracted_text": f"text {i}"})) for i in range(n) for k in range(2)]
    return spark.createDataFrame(shards, SHARDS), spark.createDataFrame(details, "shard_doc_id string, receipt_id string, data string")


EDITS = "shard_doc_id string, receipt_id string, ord long, field string, value string"


def test_edits_leave_other_files_alone(spark, tmp_path):
    shards, details = tables(spark)
    a, b = str(tmp_path / "shards"), str(tmp_path / "details")
    store.write_table(shards, a, ["id"], PARTS)
    store.write_table(details, b, ["shard_doc_id"], PARTS)
    edits = spark.createDataFrame([("s3", "r3-0", 1, "vendor", '"first"'), ("s3", "r3-0", 2, "vendor", '"new"'), ("s3", "r3-2", 1, "items", "[]"), ("s9", "r9-1", 1, "invoice_id", '"I"')], EDITS)
    expected = [{tuple(r) for r in t.select(*c.columns).collect()} for t, c in zip(M.write_edits(shards, details, edits), (shards, details))]
    old = files(a), files(b)
    touched = M.store_edits(a, b, edits, PARTS, batch=4)
    assert [{tuple(r) for r in store.read_table(spark, p).select(*t.columns).collect()} for p, t in ((a, shards), (b, details))] == expected
    for path, was, parts in ((a, old[0], touched[0]), (b, old[1], touched[1])):
        kept = {f for f in was if int(f.split("/")[0][5:]) not in parts}
        assert 0 < len(parts) < PARTS and kept <= files(path) and not (was - kept) & files(path)
    now = files(a) | files(b)
    assert M.store_edits(a, b, edits, PARTS, batch=4) == ([], []) and files(a) | files(b) == now  # the same batch again
    M.store_edits(a, b, spark.createDataFrame([("s99", "new", 1, "tax", "1")], EDITS), PARTS, batch=5)
    assert store.lookup(spark, b, PARTS, shard_doc_id="s99").first()["data"] == '{"tax":1}'


def test_a_change_that_is_cut_off_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = spark.range(100).select(F.col("id").cast("string").alias("k"), F.lit(0).alias("v"))
    store.write_table(rows, path, ["k"], PARTS)
    keys = rows.where("k in ('1', '2', '3', '4', '5')")
    up = lambda t: t.withColumn("v", F.when(F.col("k").isin("1", "2", "3", "4", "5"), F.col("v") + 1).otherwise(F.col("v")))
    real, calls = store._hadoop, []

    def fails(spark, target):
        calls.append(target)
        if len([c for c in calls if "/_next-" not in c and "/part=" in c]) == 3:
            raise OSError("lost")
        return real(spark, target)

    monkeypatch.setattr(store, "_hadoop", fails)
    with pytest.raises(OSError):
        store.change_parts(spark, path, ["k"], PARTS, keys, up, batch=1)
    monkeypatch.setattr(store, "_hadoop", real)
    assert store.change_parts(spark, path, ["k"], PARTS, keys, up, batch=1) == []  # it was finished, not applied twice
    got = {r["k"]: r["v"] for r in store.read_table(spark, path).collect()}
    assert got == {str(i): int(1 <= i <= 5) for i in range(100)} and not glob.glob(f"{path}/_next-*")
    os.makedirs(f"{path}/_next-x/part=0")  # one that never got ready
    store.recover(spark, path)
    assert not glob.glob(f"{path}/_next-*")


def test_parts_can_be_emptied_but_not_left(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    store.write_table(rows, path, ["k"], PARTS)
    a = rows.where("k = 'a'")
    with pytest.raises(ValueError, match="moved"):
        store.change_parts(spark, path, ["k"], PARTS, a, lambda t: t.withColumn("k", F.concat("k", F.lit("xyz-moved"))).unionByName(spark.range(50).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v"))))
    store.change_parts(spark, path, ["k"], PARTS, a, lambda t: t.where("k <> 'a'"))
    assert [tuple(r) for r in store.read_table(spark, path).collect()] == [("b", 2)]
    store.change_parts(spark, path, ["k"], PARTS, rows, lambda t: t.limit(0))
    assert store.read_table(spark, path).count() == 0 and store.lookup(spark, path, PARTS, k="b").count() == 0
    store.change_parts(spark, path, ["k"], PARTS, rows, lambda t: t.unionByName(rows))
    assert store.read_table(spark, path).count() == 2
    store.write_table(rows.limit(0), path, ["k"], PARTS)
    assert store.read_table(spark, path).columns == ["k", "v"] and store.read_table(spark, path).count() == 0
    with pytest.raises(ValueError, match="part"):
        store.write_table(rows.withColumnRenamed("v", "part"), path, ["k"])


def test_index(spark, tmp_path):
    shards, details = tables(spark)
    path = str(tmp_path / "index")
    R.write_index(shards, details, path, PARTS)
    for wanted in ("r7-1", "r7-2", "none", "r'\"\\"):
        found = R.find_indexed(spark, path, wanted, PARTS)
        assert found.collect() == R.find_receipt(shards, details, wanted).collect()
    rows = store.lookup(spark, path, PARTS, receipt_id="r7-1")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(receipt_id,r7-1)" in plan and "PartitionFilters: [isnotnull(part" in plan
    opened = rows.select(F.input_file_name()).distinct().count()
    assert opened == 1 < len(files(path))
    old = files(path)
    moved = shards.withColumn("receipt_metadata", F.when(F.col("id") == "s7", '{"r7-1":{"vendor":"changed"},"fresh":{"vendor":"f"}}').otherwise(F.col("receipt_metadata")))
    touched = R.refresh_index(moved, details, path, shards.where("id = 's7'"), PARTS, batch=1)
    assert {f for f in old if int(f.split("/")[0][5:]) not in touched} <= files(path)
    for wanted in ("r7-0", "r7-1", "fresh", "r8-0"):
        assert R.find_indexed(spark, path, wanted, PARTS).collect() == R.find_receipt(moved, details, wanted).collect()


def test_upsert_stream_rewrites_touched_parts(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id string, ord long, vendor string, status string, batch long"
    store.write_table(spark.createDataFrame([(f"r{i}", i, "old", "error", -1) for i in range(60)], schema), path, ["id"], PARTS)
    old = files(path)
    new = spark.createDataFrame([("r5", 0, "new", "x", None), ("r5", 1, "later", "x", None), ("n", 2, "new", "x", None)], schema).drop("batch")
    new.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second query finds nothing new
        C.upsert_parts(spark.readStream.schema(new.schema).parquet(str(tmp_path / "in")), path, PARTS, str(tmp_path / "cp")).awaitTermination()
        got = {r["id"]: (r["vendor"], r["status"], r["batch"]) for r in store.read_table(spark, path).collect()}
        assert len(got) == 61 and got["r5"] == ("new", "success", 0) and got["n"] == ("new", "x", 0) and got["r6"] == ("old", "error", -1)
    assert len(old & files(path)) >= PARTS - 2
    ordered = store.read_table(spark, path).orderBy(F.col("batch").desc(), "ord").select("id").limit(3).collect()
    assert [r["id"] for r in ordered] == ["r5", "n", "r0"]


def test_stored_days_reach_the_scan(spark, tmp_path):
    rows = spark.createDataFrame([(f"r{i}", f"v{i}", f"2026-{i % 12 + 1:02d}-05") for i in range(200)] + [("x", "v", "bad"), ("y", "v", None)], "id string, vendor string, purchase_date string").withColumn("category", F.lit("c"))
    R.with_purchase_day(rows).repartitionByRange(6, "purchase_day").write.parquet(str(tmp_path / "days"))
    wanted = R.ReceiptFilter("2026-03-01", "Apr 30, 2026")
    stored = R.filter_receipts(spark.read.parquet(str(tmp_path / "days")), wanted)
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(purchase_day,2026-03-01)" in plan and "LessThanOrEqual(purchase_d" in plan
    assert {r["id"] for r in stored.collect()} == {r["id"] for r in R.filter_receipts(rows, wanted).collect()} != set()


def test_settings(spark, tmp_path):
    from tallyspark.functions import scalars as S
    from tallyspark.sources import documents as D

    path, ids = str(tmp_path / "t"), ["a b", "Ü@x.org", "!'()*-._~", "a+b&c=%", ""]
    rows = spark.createDataFrame([(i, n, f"first {n}", None) for i in ids for n in (1, 2)] + [(None, 1, "x", "y")], "identity string, ord int, first_name string, last_name string")
    assert [r[0] for r in rows.where("ord = 1").select(S.storage_key_of("p:", F.col("identity"))).collect()] == [*(S.storage_key("p:", i) for i in ids), None]
    store.write_table(spark.createDataFrame([("other", "{}")], "key string, value string"), path, ["key"], PARTS)
    M.store_names(path, rows, "p:", PARTS)
    got = {r["key"]: tuple(r["n"]) for r in store.read_table(spark, path).select("key", D.name_settings(F.col("value")).alias("n")).collect()}
    assert got == {"other": ("", "")} | {S.storage_key("p:", i): ("first 2", "") for i in ids}
