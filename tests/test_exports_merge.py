import glob
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import exports as X
from tallyspark.operators import merge as M
from tallyspark.sources import sinks

ITEMS = "array<struct<name:string,quantity:double,price:double>>"


def rows(spark):
    data = [
        (0, "a", 'Say "hi", Inc', "06/21/26", "I-1", 2.15, [(" Milk ", 2.0, 1.005), ("", None, 3.0), (None, 1.5, None)]),
        (1, "b", "Two\nlines", "bad", None, 0.0, None),
        (2, "c", 'Say "hi", Inc', "2026-06-21", "", float("nan"), []),
    ]
    return spark.createDataFrame(data, f"ord long, id string, vendor string, purchase_date string, invoice_id string, tax double, items {ITEMS}").withColumn("category", F.lit("c"))


LINES = ['"2026-06-21","I-1","Say ""hi"", Inc","Milk x2 ($1.00); ($3.00); x1.5","2.15"', '"","","Two\nlines","","0"', '"2026-06-21","","Say ""hi"", Inc","",""']


def test_csv_bytes(spark, tmp_path):
    lines = X.receipt_lines(rows(spark))
    assert [r["line"] for r in lines.orderBy("ord").collect()] == LINES
    sinks.write_csv(lines, X.RECEIPT_HEADER, str(tmp_path / "csv"), ["ord"])
    (file,) = glob.glob(str(tmp_path / "csv" / "part-*"))
    head = '"Date","Invoice ID","Merchant Name","Items Purchased","Total GST/HST"'
    assert open(file, "rb").read() == ("\r\n".join([head, *LINES]) + "\r\n").encode()


def test_numbered_names(spark):
    names = [r["name"] for r in X.image_names(rows(spark)).orderBy("ord").collect()]
    assert names == ["2026-06-21 - Say -hi-, Inc.jpg", "unknown-date - Two-lines.jpg", "2026-06-21 - Say -hi-, Inc (2).jpg"]


def test_names_are_numbered_across_slices(spark, monkeypatch):
    monkeypatch.setattr(X, "SLICE", 10)
    many = spark.range(35).select(F.col("id").cast("string").alias("id"), F.col("id").alias("ord"), F.lit("").alias("purchase_date"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("vendor"))
    names = [r["name"] for r in X.image_names(many).orderBy("ord").collect()]
    assert names == [f"unknown-date - {'odd' if i % 2 else 'even'}{f' ({i // 2 + 1})' if i > 1 else ''}.jpg" for i in range(35)]
    nested = many.withColumn("ord", F.struct(F.floor(F.col("ord") / 7).alias("shard_ord"), F.col("ord").alias("pos")))
    assert [r["name"] for r in X.image_names(nested).orderBy("ord").collect()] == names


def test_csv_in_parts(spark, tmp_path):
    sinks.write_csv_parts(X.receipt_lines(rows(spark)), X.RECEIPT_HEADER, str(tmp_path / "csv"), ["ord"])
    whole = b"".join(open(f, "rb").read() for part in ("header", "lines") for f in sorted(glob.glob(str(tmp_path / "csv" / part / "part-*"))))
    assert whole == ("\r\n".join([X.header_line(X.RECEIPT_HEADER), *LINES]) + "\r\n").encode()


def test_zip_of_images(spark):
    target, seen = io.BytesIO(), []
    assert sinks.export_images(rows(spark), lambda i: ("image/JPEG; q=1", i.encode()), target, lambda p, n: seen.append(p)) == 3
    with zipfile.ZipFile(target) as z:
        assert [(i.filename, i.compress_type, z.read(i)) for i in z.infolist()] == [("2026-06-21 - Say -hi-, Inc.jpg", 0, b"a"), ("unknown-date - Two-lines.jpg", 0, b"b"), ("2026-06-21 - Say -hi-, Inc (2).jpg", 0, b"c")]
    assert seen == [33, 67, 100]
    with pytest.raises(RuntimeError, match="receipt a"):
        sinks.export_images(rows(spark), lambda i: ("image/png", b""), io.BytesIO())


def test_upsert(spark):
    old = spark.createDataFrame([(0, "a", "old", "img", "error", "e"), (1, "b", "old", None, "success", None)], "ord long, id string, vendor string, local_image_url string, status string, error_message string")
    new = spark.createDataFrame([(0, "c", "new", None, "pending", None), (1, "a", "new", "x", "pending", "e2")], old.schema)
    got = M.upsert_receipts(old, new).orderBy("rank").collect()
    assert [(r["id"], r["vendor"], r["local_image_url"], r["status"], r["error_message"]) for r in got] == [("c", "new", None, "pending", None), ("a", "new", "img", "success", None), ("b", "old", None, "success", None)]
    assert [r["id"] for r in M.keep_unsaved(old).collect()] == ["a"]
    twice = old.unionByName(old.where("id = 'a'").withColumns({"ord": F.lit(-1), "local_image_url": F.lit("first")}))
    assert {r["id"]: r["local_image_url"] for r in M.upsert_receipts(twice, new).collect()}["a"] == "first"
    changed = M.update_by_id(old, spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("z", 1, "q")], "id string, ord long, vendor string"))
    assert {r["id"]: r["vendor"] for r in changed.collect()} == {"a": "y", "b": "old"}


def test_edits(spark):
    one = spark.range(1).select(*(M.edit_value(f, v)[f].alias(f) for f, v in (("vendor", " V "), ("total", "12abc"), ("purchase_date", "06/21/26"), ("category", " c "))))
    assert tuple(one.first()) == ("V", 12.0, "2026-06-21", " c ")
    for field, value in (("total", "abc"), ("purchase_date", "06/31/26"), ("id", "x")):
        with pytest.raises(ValueError):
            M.edit_value(field, value)
    assert M.mirrored(["items", "vendor", "tax"]) == ["vendor", "tax"]
    items = F.array(F.struct(F.lit("a").alias("name"), F.lit(1.0).alias("quantity"), F.lit(2.0).alias("price")))
    got = spark.range(1).select(M.add_item(items), M.replace_item(items, 0, " b ", 3, 4), M.remove_item(items, 0)).first()
    assert [tuple(x) for x in got[0]] == [("a", 1.0, 2.0), ("New item", 1.0, 0.0)] and tuple(got[1][0]) == ("b", 3.0, 4.0) and got[2] == []


def test_edits_are_written_to_both_tables(spark):
    meta = '{"a":{"vendor":"old","total":1,"tags":{"x":[1]}},"b":{"vendor":"b"},"l":[1],"q\\"":{"vendor":"q"}}'
    shards = spark.createDataFrame([(0, "s0", "receipt_shard", "o", "0", meta), (1, "s1", "receipt_shard", "o", "1", None)], "ord long, id string, _schema string, owner_email string, shard_index string, receipt_metadata string")
    details = spark.createDataFrame([("s0", "a", '{"vendor":"old","items":[{"name":"i"}]}'), ("s0", "b", '{"vendor":"b"}')], "shard_doc_id string, receipt_id string, data string")
    edits = spark.createDataFrame([("s0", "a", 1, "vendor", '"first"'), ("s0", "a", 2, "vendor", '"new"'), ("s0", "a", 1, "items", "[]"), ("s0", "q\"", 1, "total", "2.5"), ("s0", "gone", 1, "tax", "1"), ("s1", "x", 1, "tax", "1")], "shard_doc_id string, receipt_id string, ord long, field string, value string")
    new_shards, new_details = M.write_edits(shards, details, edits)
    metas = {r["id"]: r["receipt_metadata"] for r in new_shards.collect()}
    assert metas["s1"] is None and list(json.loads(metas["s0"])) == ["a", "b", "l", 'q"']
    assert json.loads(metas["s0"]) == {"a": {"vendor": "new", "total": 1, "tags": {"x": [1]}}, "b": {"vendor": "b"}, "l": [1], 'q"': {"vendor": "q", "total": 2.5}}
    got = {(r["shard_doc_id"], r["receipt_id"]): json.loads(r["data"]) for r in new_details.collect()}
    assert got == {("s0", "a"): {"vendor": "new", "items": []}, ("s0", "b"): {"vendor": "b"}, ("s0", 'q"'): {"total": 2.5}, ("s0", "gone"): {"tax": 1}, ("s1", "x"): {"tax": 1}}


def test_image_replacement(spark):
    old = spark.createDataFrame([("a", "x", True), ("b", "x", True), ("c", "x", None)], "id string, image_url string, image_grayscale boolean")
    new = spark.createDataFrame([("a", 1, "y", False), ("a", 2, "z", None), ("c", 1, "y", False)], "id string, ord long, storage_path string, image_grayscale boolean")
    assert {r["id"]: (r["image_url"], r["image_grayscale"]) for r in M.replace_images(old, new).collect()} == {"a": ("z", True), "b": ("x", True), "c": ("y", False)}


def test_categories(spark):
    docs = spark.createDataFrame([(0, {" b ": "1", "A": None}), (1, {"b": "2", " ": "x"})], "place long, categories map<string,string>")
    assert [tuple(r) for r in M.flatten_categories(docs).collect()] == [("A", ""), ("b", "2")]
    one = spark.createDataFrame([({"a": "1", "b": "2"},)], "c map<string,string>")
    got = one.select(M.put_category(F.col("c"), " n ", " "), M.put_category(F.col("c"), "b2", "x", "b"), M.drop_category(F.col("c"), "a")).first()
    assert (got[0], got[1], got[2]) == ({"a": "1", "b": "2", "n": None}, {"a": "1", "b2": "x"}, {"b": "2"})
    with pytest.raises(ValueError):
        M.put_category(F.col("c"), "  ")


def test_a_shard_is_read_once_for_its_edits(spark):
    shards = spark.createDataFrame([(0, "s", '{"a \\"b":{"vendor":"v","x":1},"c":{"vendor":"w"},"d":5}')], "ord long, id string, receipt_metadata string")
    details = spark.createDataFrame([], "shard_doc_id string, receipt_id string, data string")
    edits = spark.createDataFrame([("s", i, 1, "vendor", '"new"') for i in ('a "b', "d")], "shard_doc_id string, receipt_id string, ord long, field string, value string")
    mirror, _ = M.write_edits(shards, details, edits)
    assert mirror.first()["receipt_metadata"] in ('{"a \\"b":{"vendor":"new","x":1},"c":{"vendor":"w"},"d":5}', '{"a \\"b":{"x":1,"vendor":"new"},"c":{"vendor":"w"},"d":5}')
    plan = mirror._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 3  # the shard, an entry, its edits
