import json

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import receipts as R
from tallyspark.sources import documents as D
from tallyspark.streaming import changes as C
from tallyspark.streaming import uploads as T

SHARDS = "ord long, id string, _schema string, owner_email string, shard_index string, receipt_metadata string"
DETAILS = "shard_doc_id string, receipt_id string, data string"
FULL = {"vendor": "Shop", "subtotal": 1, "tax": "0.13", "total": 1.13, "category": "Food", "purchase_date": "2026-07-23", "created_at": "2026-07-23T10:00:00Z"}


def shards(spark, *entries, **extra):
    return spark.createDataFrame([(i, f"s{i}", extra.get("schema", "receipt_shard"), "Me@x.org", str(i), json.dumps(m) if isinstance(m, dict) else m) for i, m in enumerate(entries)], SHARDS)


def test_metadata_wins_and_details_fill(spark):
    meta = {"corrected": FULL | {"vendor": "Corrected", "tax": None}, "fallback": {"created_at": "2026-01-01T00:00:00Z"}, "empty": {}}
    detail = {"corrected": FULL | {"vendor": "Detail", "tax": 9, "items": [{"name": "a", "quantity": "2", "price": 1.5}, 7, {"name": 1}]}, "fallback": FULL | {"image_grayscale": True}, "empty": {"extracted_fields": {"ai_suggestions": {"vendor": "AI"}}}}
    details = spark.createDataFrame([("s0", k, json.dumps(v)) for k, v in detail.items()], DETAILS)
    got = {r["id"]: r for r in R.all_receipts(shards(spark, meta), details).collect()}
    assert got["corrected"]["vendor"] == "Corrected" and got["corrected"]["tax"] == 9.0
    assert [tuple(i) for i in got["corrected"]["items"]] == [("a", 2.0, 1.5), ("", 0.0, 0.0)]
    assert got["fallback"]["vendor"] == "Shop" and got["fallback"]["image_grayscale"] and got["fallback"]["tax"] == 0.13
    assert got["empty"]["vendor"] == "" and got["empty"]["total"] == 0.0 and got["empty"]["extracted_fields"] == []


def test_repeated_ids(spark):
    whole, part = FULL, {"vendor": "part"}
    docs = shards(spark, {"a": part | {"vendor": "one"}, "b": part}, {"a": whole | {"vendor": "two"}, "b": part | {"vendor": "last"}}, {"a": whole | {"vendor": "three"}})
    got = {r["id"]: r for r in R.all_receipts(docs, spark.createDataFrame([], DETAILS)).collect()}
    assert got["a"]["vendor"] == "two" and tuple(got["a"]["ord"]) == (0, 0)
    assert got["b"]["vendor"] == "last" and tuple(got["b"]["ord"]) == (0, 1)


def test_what_is_skipped(spark):
    docs = shards(spark, {" ": FULL, "n": None, "l": [1], "t": "text", "ok": FULL}, "not json", None)
    assert [r["id"] for r in R.expand_shards(docs).collect()] == ["ok"]
    assert R.expand_shards(shards(spark, {"a": FULL}, schema="other")).count() == 0
    assert D.owner_shards(docs, "me@x.org").count() == 0 and D.owner_shards(docs, "Me@x.org").count() == 3


def test_created_at_by_truth(spark):
    meta = {k: {"created_at": "meta"} for k in "abcd"}
    detail = {"a": {"created_at": ""}, "b": {"created_at": 5}, "c": {"created_at": "detail"}, "d": {"created_at": 0}}
    details = spark.createDataFrame([("s0", k, json.dumps(v)) for k, v in detail.items()], DETAILS)
    got = {r["id"]: r["created_at"] for r in R.all_receipts(shards(spark, meta), details).collect()}
    assert got == {"a": "meta", "b": "", "c": "detail", "d": "meta"}


def test_lookup_takes_the_first_shard_and_its_detail(spark):
    docs = shards(spark, {"x": {}}, {"a": {"vendor": "first"}}, {"a": FULL})
    details = spark.createDataFrame([("s2", "a", json.dumps({"category": "no"})), ("s1", "a", json.dumps({"category": "yes"}))], DETAILS)
    row = R.find_receipt(docs, details, "a").first()
    assert (row["vendor"], row["category"]) == ("first", "yes")
    assert R.find_receipt(docs, details, "z").count() == 0


def flat(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, id string, vendor string, category string, purchase_date string, total double, created_at string")


def test_filters(spark):
    rows = flat(spark, ("a", " Café 100% ", " Food ", "06/21/26", 1.0, ""), ("b", "cafe", "Fuel", "2026-07-23", 2.0, ""), ("c", "x_y", "Food", "bad", 3.0, ""))
    ids = lambda **k: [r["id"] for r in R.filter_receipts(rows, R.ReceiptFilter(**k)).orderBy("id").collect()]
    assert ids() == ["a", "b", "c"] and ids(from_date="2026-06-21", to_date="July 23, 2026") == ["a", "b"]
    assert ids(from_date="nonsense") == ["a", "b", "c"] and ids(categories=[" Food", ""]) == ["a", "c"] and ids(categories=["food"]) == []
    assert ids(vendor=" CAFÉ ") == ["a"] and ids(vendor="%") == ["a"] and ids(vendor="_") == ["c"] and ids(vendor="caf", categories=["Fuel"]) == ["b"]
    with pytest.raises(ValueError):
        R.check_range(R.ReceiptFilter("2026-07-02", "2026-07-01"))
    assert ids(from_date="٢٠٢٦-07-01") == ["a", "b", "c"]
    days = R.with_purchase_day(rows)
    assert [r["id"] for r in R.filter_receipts(days, R.ReceiptFilter(from_date="2026-07-01")).collect()] == ["b"]
    assert R.export_rows(rows, R.ReceiptFilter(vendor="x_y")).count() == 1
    with pytest.raises(ValueError, match="no receipts"):
        R.export_rows(rows, R.ReceiptFilter(vendor="nobody"))


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_receipts_are_read_once(spark):
    """The plans of the heavier queries scan each table they need once, or once for each of the two things they need it for."""
    from tallyspark.plans.queries import QUERIES

    most = {"receipts_dedup": 3, "gst_match": 4, "filter_receipts": 2, "search_cards": 5, "spending_by_day": 5}
    assert {n: scans(QUERIES[n](spark, "/root/testdata/sf0.001")) for n in most} == most


def test_groups_totals_and_order(spark):
    rows = flat(spark, ("a", "v", "c", "06/21/26", 0.1, "2026-01-01T00:00:00Z"), ("b", "v", "c", "", 0.2, ""), ("c", "v", "c", "June 21, 2026", 0.3, "2026-01-02T00:00:00Z"), ("d", "v", "c", "06/31/26", 1.0, "never"))
    groups = R.group_by_date(rows, with_rows=True).orderBy("first_ord").collect()
    assert [(g["label"], g["n"], g["total_cents"], g["ids"]) for g in groups] == [("June 21, 2026", 2, 40, ["a", "c"]), ("Unknown Date", 1, 20, ["b"]), ("06/31/26", 1, 100, ["d"])]
    assert tuple(R.totals(rows).first()) == (4, 160) and tuple(R.totals(rows.limit(0)).first()) == (0, 0)
    assert [r["id"] for r in R.in_order(rows).collect()] == ["c", "a", "b", "d"]
    assert R.select_by_id(rows.where("id = 'a'"), rows, "b").first()["id"] == "b"


def test_category_scan(spark):
    docs = spark.createDataFrame([(0, "a", "Me@x.org", {"x": "typed"}), (1, "a", "me@x.org", {"x": "lower"}), (2, "b", "Me@x.org", {"y": None}), (3, "c", "you@x.org", {"z": "no"})], "ord long, id string, owner_email string, categories map<string,string>")
    assert {r["id"]: r["categories"] for r in D.owner_categories(docs, " Me@x.org").collect()} == {"a": {"x": "lower"}, "b": {"y": None}}


def test_refresh_reads_the_newest_shard(spark):
    old = spark.createDataFrame([("a", (0, 0), "old", "error"), ("z", (0, 1), "z", "success")], "id string, ord struct<shard_ord:bigint,pos:int>, vendor string, status string")
    docs = shards(spark, {"b": FULL}, {"a": FULL})
    rows, page = C.refresh_latest(old, docs)
    assert page == 1 and [(r["id"], r["vendor"], r["status"]) for r in rows.orderBy("rank").collect()] == [("a", "Shop", "success"), ("z", "z", "success")]
    rows, page = C.refresh_latest(old, docs.limit(0))
    assert page == 0 and [r["id"] for r in rows.collect()] == ["a"]


def test_upload_states(spark):
    steps = [("u1", 0, "started", None, '{"image_grayscale":true}', None), ("u1", 1, "stored", 204, None, None), ("u2", 2, "started", None, None, None), ("u2", 3, "stored", 500, None, " "), ("u3", 4, "started", None, None, None), ("u3", 5, "finalized", None, '{"id":"r3","vendor":"v"}', None), ("u4", 6, "failed", None, None, "offline"), ("u5", 7, "started", None, None, None), ("u5", 8, "retried", None, None, None), ("u6", 9, "finalized", None, "broken", None)]
    got = {r["upload_id"]: (r["id"], r["status"], r["error_message"], r["image_grayscale"]) for r in T.upload_states(spark.createDataFrame(steps, "upload_id string, ord long, kind string, code int, data string, message string")).collect()}
    assert got == {"u1": ("u1", "uploading", None, True), "u2": ("u2", "error", "Upload failed", False), "u3": ("r3", "success", None, False), "u4": ("u4", "error", "offline", False), "u6": ("u6", "success", None, False)}


def test_sources(spark):
    token = spark.createDataFrame([("x.eyJlbWFpbCI6ImFAYiIsImV4cCI6NX0.y",), ("bad",), (None,)], "t string")
    assert [r[0] and tuple(r[0]) for r in token.select(D.token_payload(F.col("t"), "email string, exp long")).collect()] == [("a@b", 5), None, None]
    stored = spark.createDataFrame([('{"firstName":"A","lastName":2}',), ("{",), (None,)], "t string")
    assert [tuple(r[0]) for r in stored.select(D.name_settings(F.col("t"))).collect()] == [("A", ""), ("", ""), ("", "")]
    pages = D.shard_pages(spark.createDataFrame([(0, "a", "receipt_shard", "o", "2", None), (1, "b", "receipt_shard", "o", "10", None), (2, "c", "receipt_shard", "o", None, None), (3, "d", "x", "o", "99", None)], SHARDS))
    assert [(r["id"], r["page"]) for r in pages.orderBy("page").collect()] == [("b", 1), ("a", 2), ("c", 3)]
    sorted_names = R.category_options(spark.createDataFrame([("b",), ("A",), ("",), ("a",)], "n string"), spark.createDataFrame([("é",), ("f",), ("B",)], "n string"))
    assert [r[0] for r in sorted_names.collect()] == ["a", "A", "b", "B", "é", "f"]
