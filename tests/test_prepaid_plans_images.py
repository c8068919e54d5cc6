import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import images as I
from tallyspark.operators import prepaid as P
from tallyspark.operators import subscriptions as U
from tallyspark.sources import documents as D

CARD = "id string, activation_barcode string, vanilla_serial string, denomination double, state string, last4 string, pan_hash string, package_image_storage_path string, opened_card_image_storage_path string"
PURCHASE = f"id string, owner_email string, sales_receipt_id string, activation_receipts array<struct<id:string,storage_path:string>>, cards array<struct<{CARD.replace(' string', ':string').replace(' double', ':double')}>>, created_at string, ord long"


def card(name, state="active", last4="3456", images=True, pan_hash=None):
    return (name, "1" * 30, "2" * 11, 50.0, state, last4, pan_hash, "p" if images else "", "o" if images else None)


def purchases(spark):
    return spark.createDataFrame([("p1", "o", "r1", [("a1", "x"), ("a2", "y")], [card("c1"), card("c2", "archived")], "2026-01-01", 0), ("p2", "o", "r9", [("a1", "x")], [card("c3", "archived", "9999", pan_hash=P.number_hash("1" * 16, b"k"))], "2026-01-02", 1), ("p3", "o", "r1", [], [], None, 2)], PURCHASE)


def test_search(spark):
    assert P.search_digits("34-56") == "3456"
    with pytest.raises(ValueError):
        P.search_digits("12345")
    found = P.search_cards(purchases(spark), "34-56")
    assert {r["card_id"] for r in found.collect()} == {"c1", "c2"}
    assert [r["card_id"] for r in P.search_cards(purchases(spark), "1" * 16, b"k").collect()] == ["c3"]
    opened = P.open_results(found, P.with_state(purchases(spark), "active"), P.with_state(purchases(spark), "archived"), purchases(spark))
    assert {(r["card_id"], r["source"]) for r in opened.collect()} == {("c1", 0), ("c2", 1)}
    assert {tuple(r) for r in P.open_results(found, purchases(spark)).collect()} == {tuple(r) for r in opened.collect()}
    receipts = spark.createDataFrame([("r1", "Shop", "2026-02-02")], "id string, vendor string, purchase_date string")
    assert {r["retailer"] for r in P.results_with_receipts(found, receipts).collect()} == {"Shop"}
    assert {(r["id"], r["retailer"], r["shown_date"]) for r in P.with_sales_receipts(purchases(spark), receipts).collect()} == {("p1", "Shop", "2026-02-02"), ("p2", "Retailer", "2026-01-02"), ("p3", "Shop", "2026-02-02")}


def test_states_counts_and_cleanup(spark):
    assert [r["id"] for r in P.with_state(purchases(spark), "active").collect()] == ["p1"]
    assert [tuple(r) for r in P.card_counts(purchases(spark)).orderBy("id").collect()] == [("p1", 1, 1, 2), ("p2", 0, 1, 1), ("p3", 0, 0, 0)]
    assert tuple(P.cleanup_counts(purchases(spark)).first()) == (2, 2, 1, 2)
    assert tuple(P.cleanup_counts(P.after_cleanup(purchases(spark))).first())[:3] == (0, 0, 0)
    assert P.card_detail(purchases(spark), "p1", "c2").first()["card"]["state"] == "archived"
    with pytest.raises(Exception, match="unavailable"):
        P.card_detail(purchases(spark), "p1", "zz").collect()
    assert [(r["receipt_id"], r["ordinal"]) for r in P.activation_ordinals(purchases(spark)).where("purchase_id = 'p1'").orderBy("ordinal").collect()] == [("a1", 1), ("a2", 2)]
    assert {r["package_image_name"] for r in P.card_rows(purchases(spark)).collect()} == {"package-card-3456.jpg", "package-card-9999.jpg"}
    assert {r["opened_image_name"] for r in P.card_rows(purchases(spark)).collect()} == {"opened-card-3456.jpg", "opened-card-9999.jpg"}


def test_purchase_upsert(spark):
    change = purchases(spark).where("id = 'p1'").withColumn("sales_receipt_id", F.lit("new"))
    other = change.withColumn("id", F.lit("p0"))
    got = P.upsert_purchase(purchases(spark), change.unionByName(other)).orderBy("ord").collect()
    assert [(r["id"], r["sales_receipt_id"], r["ord"]) for r in got] == [("p0", "new", -1), ("p1", "new", 0), ("p2", "r9", 1)]
    more = other.unionByName(other.withColumns({"id": F.lit("p9"), "ord": F.lit(5)})).unionByName(change.withColumns({"sales_receipt_id": F.lit("later"), "ord": F.lit(7)})).unionByName(change)
    got = P.upsert_purchase(purchases(spark), more).orderBy("ord").collect()
    assert [(r["id"], r["sales_receipt_id"], r["ord"]) for r in got] == [("p9", "new", -6), ("p0", "new", -1), ("p1", "later", 0), ("p2", "r9", 1)]


def test_drafts(spark):
    schema = "d array<struct<storage_path:string,activation_barcode:string,vanilla_serial:string,denomination:string>>"
    good, empty = ("f", "1" * 15 + "-" + "1" * 15, "2" * 11, " 50 "), ("", None, "", "")
    rows = spark.createDataFrame([([good, empty],), ([empty],), ([good, ("", "1", "", "")],)], schema)
    got = rows.select(P.drafts_valid(F.col("d")), P.draft_cards(F.col("d"))).collect()
    assert [r[0] for r in got] == [True, False, False]
    assert [(c["activation_barcode"], c["denomination"], c["confirmed"]) for c in got[0][1]] == [("1" * 30, 50.0, True)]
    drafts = spark.createDataFrame([("a", "old", "s", "5"), ("b", "old", "s", "5")], "id string, activation_barcode string, vanilla_serial string, denomination string")
    new = spark.createDataFrame([("a", "", "n", 0.0)], "id string, activation_barcode string, serial_number string, denomination double")
    assert [tuple(r) for r in P.overlay_extraction(drafts, new).orderBy("id").collect()] == [("a", "old", "n", "0"), ("b", "old", "s", "5")]


def test_plans(spark):
    users = spark.createDataFrame([("u1", "a@b", json.dumps({"plan_name": " Pro yearly ", "monthly_limit": 5, "features": ["x", 1], "payment_method_ready": True, "helcim_customer_code": "h"})), ("u2", "c@d", "{}")], "uid string, owner_email string, data string")
    first = U.user_plan(users, "u1", None).first()
    assert (first["plan_name"], first["plan_id"], first["monthly_limit"], first["features"], first["payment_method_saved"], first["customer_code"]) == ("Pro", "Pro", 5, ["x"], True, "h")
    assert U.user_plan(users, "?", "c@d").first()["plan_name"] == "free"
    none = U.user_plan(users, "?", "z@z").first()
    assert (none["plan_name"], none["owner_email"], none["monthly_limit"]) == ("free", "z@z", None)
    plans = spark.createDataFrame([("1", "Free"), ("2", "Plus x"), ("3", "Odd")], "id string, name string")
    assert [r["id"] for r in U.visible_plans(plans, "PLUS").collect()] == ["2"] and U.visible_plans(plans, "odd").count() == 3
    periods = plans.select(U.billing_period(F.element_at(F.array(*map(F.lit, ("monthly", "yearly", "weekly"))), F.col("id").cast("int"))))
    assert [r[0] for r in periods.collect()] == ["month", "year", "weekly"]
    raw = spark.createDataFrame([("1", None, None, None, None, None, None)], "id string, name string, features array<string>, interval string, monthly_limit long, payment_plan_id long, price_cents long")
    assert tuple(D.read_plans(raw).first()) == ("1", "", [], "month", 0, 0, None)


def scene(width, height, box=None, ground=25):
    image = np.full((height, width, 4), ground, np.uint8)
    if box:
        image[box[1] : box[3] + 1, box[0] : box[2] + 1] = 255
    return image


def test_detector():
    found = I.detect_corners(scene(400, 300, (80, 60, 319, 239)))
    assert [(found[c]["x"], found[c]["y"]) for c in ("tl", "tr", "br", "bl")] == [(80, 60), (319, 60), (319, 239), (80, 239)]
    assert I.detect_corners(scene(400, 300)) is None and I.detect_corners(scene(400, 300, (0, 0, 399, 299))) is None
    assert I.detect_corners(scene(400, 300, (80, 60, 90, 70))) is None


def test_largest_component_counts_corners():
    mask = np.zeros((5, 6), bool)
    mask[0, 0] = mask[1, 1] = mask[2, 2] = True
    mask[4, 4:6] = True
    assert I.largest_component(mask).tolist() == [[0, 0], [1, 1], [2, 2]]


def test_gray_and_median():
    pixels = np.array([[[255, 0, 0, 9], [0, 120, 240, 8]]], np.uint8)
    assert I.grayscale(pixels)[0].tolist() == [[54, 54, 54, 9], [103, 103, 103, 8]]
    assert I.upper_median(np.array([1, 1, 0, 2])) == 3


def test_crop(spark):
    images = [("ok", 400, 300, scene(400, 300, (80, 60, 319, 239)).tobytes()), ("side", 400, 300, scene(400, 300, (10, 60, 319, 239)).tobytes()), ("none", 400, 300, scene(400, 300).tobytes()), ("broken", 400, 300, b"x"), ("large", 1600, 1200, scene(1600, 1200, (320, 240, 1279, 959)).tobytes())]
    rows = spark.createDataFrame(images, "id string, width int, height int, pixels binary")
    got = {r["id"]: r["crop"] and tuple(r["crop"]) for r in I.auto_crop(rows).collect()}
    assert got["ok"] == (70, 52, 329, 247) and got["side"] == (0, 52, 332, 247) and got["none"] is None and got["broken"] is None
    assert got["large"] == (281, 211, 1317, 987)
    fit = rows.select(I.fit_width(F.lit(2400), F.lit(1200), 1000)).first()[0]
    assert tuple(fit) == (1000, 500)
    assert [r[0] for r in spark.createDataFrame([(True,), (False,)], "g boolean").select(I.jpeg_quality(F.col("g"))).collect()] == [0.65, 0.75]
    gray = rows.where("id = 'ok'").select(I.gray_pixels(F.col("width"), F.col("height"), F.col("pixels"))).first()[0]
    assert len(gray) == 400 * 300 * 4
