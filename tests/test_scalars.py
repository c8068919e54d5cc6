import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.sources.pictures import read_pictures


def each(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", expression(F.col("v")).alias("o")).orderBy("i").collect()]


def test_accepted_dates(spark):
    d = datetime.date
    cases = {"2026-07-23": d(2026, 7, 23), "2026/07/23": d(2026, 7, 23), "06/21/26": d(2026, 6, 21), "06/07/26": d(2026, 6, 7), "Jun 7, 2026": d(2026, 6, 7), "Jun 07, 2026": d(2026, 6, 7), "June 7, 2026": d(2026, 6, 7), "jUnE 7, 2026": d(2026, 6, 7), "02/29/24": d(2024, 2, 29), "February 29, 2024": d(2024, 2, 29), "﻿ 2026-07-23\t": d(2026, 7, 23)}
    assert each(spark, list(cases), S.purchase_date) == list(cases.values())


def test_every_month_name(spark):
    got = each(spark, [f"{name.title()} 7, 2026" for name in S.MONTHS], S.purchase_date)
    assert got == [datetime.date(2026, m, 7) for m in S.MONTHS.values()]


def test_rejected_dates(spark):
    bad = ["02/29/25", "13/01/26", "06/31/26", "Feb 29, 2025", "Jun 31, 2026", "Foo 7, 2026", "", "2026/02/30", "2026-13-01", "not-a-date", "2026-07/23", "0000-01-01", "Jan 1, 0000", "2026-07-23T00:00Z", None]
    assert each(spark, bad, S.purchase_date) == [None] * len(bad)


def test_labels(spark):
    assert each(spark, ["06/07/26", " 06/31/26 ", "soon", "", "2026-06-07T10:00:00Z"], S.date_label) == ["June 7, 2026", "06/31/26", "soon", "", "June 7, 2026"]
    assert each(spark, ["06/07/26"], lambda c: S.date_label(c, "EEEE, MMMM d, yyyy")) == ["Sunday, June 7, 2026"]


def test_numbers(spark):
    assert each(spark, ["1", " 2.5\n", "0x10", "1d", "NaN", "Infinity", "1e400", "", None, "-.5", "5."], S.number) == [1.0, 2.5, 16.0, None, None, None, None, None, None, -0.5, 5.0]
    assert each(spark, ["12abc", " -3.5kg", "abc"], S.leading_number) == [12.0, -3.5, None]


def test_money(spark):
    assert each(spark, [1.005, 105.5, -2.5, -0.005, None], S.cents, "double") == [101, 10550, -250, 0, None]
    assert each(spark, [554, 550, 10550, -1, 2**53], S.tax_cents, "long") == [72, 72, 1372, None, None]
    assert each(spark, [0, 5, 105, -1234], S.money, "long") == ["0.00", "0.05", "1.05", "-12.34"]
    assert S.basis_points(None) == 1300 and S.basis_points(0) is None and S.basis_points(12.345) == 1235
    assert each(spark, ["1.43", "x", None], S.cents_of_text) == [143, 0, 0]


def test_number_texts(spark):
    assert each(spark, [0.0, -0.0, 2.15, 100.0, 12345678.0, 1e-7, 1e20, float("nan"), None], S.plain_number, "double") == ["0", "0", "2.15", "100", "12345678", "0.0000001", "100000000000000000000", "", ""]
    assert each(spark, [1.005, 2.675, 0.125, -1.005, 10.235, 2.5], S.two_decimals, "double") == ["1.00", "2.67", "0.13", "-1.00", "10.23", "2.50"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e9, 1e9, allow_nan=False), min_size=50, max_size=200))
def test_two_decimals_are_exact(spark, values):
    from decimal import ROUND_HALF_UP, Decimal

    expected = [("-" if v < 0 else "") + str(abs(Decimal(v)).quantize(Decimal("0.01"), ROUND_HALF_UP)) for v in values]
    assert each(spark, values, S.two_decimals, "double") == expected


def test_names_and_texts(spark):
    assert each(spark, ['a<b>:c"/\\|?*', " x \t y. . ", "...", "\x01a\nb", ""], lambda c: S.filename_part(c, "none")) == ["a-b--c------", "x - y", "none", "-a-b", "none"]
    assert each(spark, ['say "hi"', "a\nb"], S.csv_field) == ['"say ""hi"""', '"a\nb"']
    assert each(spark, ["a.b.jpg", "plain"], lambda c: S.swap_extension(c, "webp")) == ["a.b.webp", "plain.webp"]
    assert each(spark, ["1234567890123", "123456789012"], S.short_tail) == ["...234567890123", "123456789012"]
    assert each(spark, ["Form1[0].Row_2"], S.field_key) == ["form10row2"]
    assert S.resolve_field(["form.Last_Name[0]", "X"], ["last_name"]) == "form.Last_Name[0]" and S.resolve_field(["x"], ["y"]) is None
    assert S.storage_key("p.", "a b@c") == "p.a%20b%40c"


@pytest.mark.parametrize(("value", "text"), [(ValueError(" bad "), "ValueError: bad"), (Exception("bad"), "bad"), ("  ", "empty error string"), (None, "null"), (True, "true"), ({"name": "E", "message": "m"}, "E: m"), ({"a": 1}, '{"a":1}'), ({}, "unknown error object"), (3, "3")])
def test_error_texts(value, text):
    assert S.error_text(value) == text


def test_quantities(spark):
    assert each(spark, [1.0, 1.5, -2.0, 0.0, None, float("inf")], S.positive_whole, "double") == [1.0, None, None, None, None, None]
    rows = spark.createDataFrame([(" fee ", 2.0), ("fee", 1.5), ("", 1.0)], "n string, q double")
    assert [r[0] for r in rows.select(S.item_description(F.col("n"), F.col("q"))).collect()] == ["2 × fee", "fee", ""]


@pytest.mark.parametrize("value, text", [(0.1 + 0.2, "0.30000000000000004"), (5.0, "5"), (-0.0, "0"), (1e21, "1e+21"), (1e-5, "0.00001"), (1e-7, "1e-7"), (float("nan"), "NaN"), (float("-inf"), "-Infinity"), (True, "true"), ({}, "unknown error object"), ({"name": " N ", "message": "m"}, "N: m"), ({"code": 1}, '{"code":1}'), ({"a": {1}}, "unknown error object"), (KeyError(), "KeyError")])
def test_error_values(value, text):
    assert S.error_text(value) == text


def test_free_form_dates(spark):
    cases = {
        "Tue, 07 Jul 2026 10:00:00 +0200": "2026-07-07 08:00:00", "Tue Jul 07 2026 23:30:00 GMT-0200 (Central)": "2026-07-08 01:30:00", "7 Jul 2026": "2026-07-07 00:00:00", "07-Jul-2026": "2026-07-07 00:00:00", "July 7 2026": "2026-07-07 00:00:00",
        " Jul 7, 2026 12:05 am ": "2026-07-07 00:05:00", "Jul. 7, 2026, 12:05 PM": "2026-07-07 12:05:00", "7/7/2026": "2026-07-07 00:00:00", "7/7/2026, 3:04:05 PM": "2026-07-07 15:04:05", "2026-07-07T10:00:00.123Z": "2026-07-07 10:00:00",
        "2026-07-07 10:00": "2026-07-07 10:00:00", "2026-7-7 9:05 EST": "2026-07-07 14:05:00", "2026-07-07T01:00:00+05:30": "2026-07-06 19:30:00", "Sat, 29 Feb 2025 10:00:00 GMT": None, "Feb 30 2026": None, "7/7/26 1:00": None, "2026-07-07": None,
        "13/1/2026": None, "Jul 7, 2026 13:00 PM": None, "Jul 7, 2026 25:00": None, "Jul 7, 2026 10:00 XYZ": None, "Jul 7, 2026 noon": None, "Foo 7 2026": None, "soon": None, "": None, "Jul 7 2026 10:00 +2": None,
    }
    got = each(spark, list(cases), lambda c: F.date_format(S.free_time(c), "yyyy-MM-dd HH:mm:ss"))
    assert dict(zip(cases, got)) == cases
    assert each(spark, [None, "Tue, 07 Jul 2026 23:00:00 -0500", "Jul 7, 2026 noon "], S.date_label) == [None, "July 8, 2026", "Jul 7, 2026 noon"]


def test_iso_timestamp_and_image_files(spark, tmp_path):
    stamp = spark.sql("SELECT TIMESTAMP '2026-01-02 03:04:05.678' AS t, CAST(NULL AS TIMESTAMP) AS n")
    assert tuple(stamp.select(S.iso_timestamp(stamp.t), S.iso_timestamp(stamp.n)).first()) == ("2026-01-02T03:04:05.678Z", None)
    for name, start in (("a.JPG", b"\xff\xd8\xff"), ("b.txt", b""), ("c.webp", b"RIFF1234WEBP"), ("d.png", b"no image")):
        (tmp_path / name).write_bytes(start + name.encode())
    found = read_pictures(spark, str(tmp_path)).collect()
    assert sorted(bytes(r["content"])[-5:] for r in found) == [b".webp", b"a.JPG"]
