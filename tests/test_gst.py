from itertools import chain, combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.functions import scalars as S
from tallyspark.operators import exports as X
from tallyspark.operators import gst as G

SCHEMA = "ord long, id string, vendor string, invoice_id string, purchase_date string, subtotal double, tax double, items array<struct<name:string,quantity:double,price:double>>"
CASES = [
    (105.5, 0.72, [("Visa value", 1, 100), ("Activation fee", 1, 5.5)], "matched", "1 × Activation fee"),
    (80, 10.4, [("Sale item", 1, 100), ("Coupon discount", 1, -20)], "matched", "1 × Sale item"),
    (10, 1.3, [("Bulk item", 2, 5)], "matched", "2 × Bulk item"),
    (11, 1.43, [("Activation fee", 1, 5.5), ("activation fee", 1, 5.5)], "matched", "2 × Activation fee"),
    (10, 1.3, [("Purchase A", 1, 5), ("Purchase B", 1, 5), ("Coupon", 1, 5)], "matched", "1 × Purchase A; 1 × Purchase B"),
    (105.5, 0.72, [("Two taxable items", 2, 2.77)], "matched", "2 × Two taxable items"),
    (105.5, 1.43, [("Visa value", 1, 100), ("Activation fee", 1, 5.5), ("activation fee", 1, 5.5)], "matched", "2 × Activation fee"),
    (105.5, 2.15, [("Vanilla Prepaid Visa $5.50 Activation Fee", 3, 5.5)], "matched", "3 × Vanilla Prepaid Visa $5.50 Activation Fee"),
    (105.5, 0.72, [("Fee A", 1, 5.5), ("Fee B", 1, 5.5)], "ambiguous", ""),
    (105.5, 0.99, [("Item", 1, 5.5)], "unmatched", ""),
    (105.5, 0.72, [("Fee", 1, 5.5), ("Free gift", 1, 0)], "ambiguous", ""),  # with and without the gift are two subsets
    (105.5, 0, [("Fee", 1, 5.5)], "unmatched", ""),
    (105.5, 0.72, None, "unmatched", ""),
]


def table(spark, rows):
    return spark.createDataFrame([(i, f"r{i:03d}", "V", None, "2026-07-23", float(s), float(t), items and [(n, float(q), float(p)) for n, q, p in items]) for i, (s, t, items, *_) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("enumerated", [0, 12])
def test_known_cases(spark, enumerated):
    got = G.infer(table(spark, CASES), enumerated=enumerated).orderBy("ord").collect()
    assert [(r["match_status"], r["description"]) for r in got] == [(c[3], c[4]) for c in CASES]
    assert {r["match_status"] for r in G.infer(table(spark, CASES), 0).collect()} == {"unmatched"}


def brute(cents, low, high):
    subsets = chain.from_iterable(combinations(range(len(cents)), n) for n in range(1, len(cents) + 1))
    fits = [s for s in subsets if low <= sum(cents[i] for i in s) <= high]
    return min(2, len(fits)), list(fits[0]) if len(fits) == 1 else None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=9), st.integers(1, 20), st.sampled_from([500, 1300, 1500]))
def test_counting_is_that_of_all_subsets(cents, tax, points):
    low, high = S.matching_sums(tax, points)
    n, places = G.count_subsets(cents, low, high)
    expected, one = brute(cents, low, high)
    assert n == expected and (n != 1 or places == one)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 9).map(lambda x: x * 12), max_size=10), st.integers(1, 400), st.integers(0, 30))
def test_counting_with_a_common_divisor_and_most_lines(cents, low, more):
    n, places = G.count_subsets(cents, low, low + more)
    expected, one = brute(cents, low, low + more)
    assert n == expected and (n != 1 or places == one)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=9), st.integers(1, 200), st.integers(0, 8))
def test_counting_by_lists_of_sums(cents, low, more):
    whole, G.ARRAY = G.ARRAY, -1
    try:
        n, places = G.count_subsets(cents, low, low + more)
    finally:
        G.ARRAY = whole
    expected, one = brute(cents, low, low + more)
    assert n == expected and (n != 1 or places == one)


def test_many_lines_take_little_time():
    import random
    import time

    rng = random.Random(5)
    cases = [[rng.randint(100, 5_000) for _ in range(60)], [rng.randint(100, 200_000) for _ in range(100)], [rng.randint(1, 2_000) * 100 for _ in range(100)], [200_000 + i for i in range(100)], [2 ** (i % 18) for i in range(100)]]
    for cents in cases:
        for share in (0.02, 0.5, 0.98):
            low = int(sum(cents) * share)
            began = time.perf_counter()
            n, places = G.count_subsets(cents, low, low + 7)
            assert time.perf_counter() - began < 1 and (n != 1 or low <= sum(cents[i] for i in places) <= low + 7)
    assert G.count_subsets([10**12 + 7, 3 * 10**12, 5], 10**12 + 12, 10**12 + 12) == (1, [0, 2])
    alone = [3 ** i for i in range(14)]  # every sum has one subset
    for chosen in ([0], [13], [1, 5, 9], list(range(14)), list(range(1, 14))):
        low = sum(alone[i] for i in chosen)
        assert G.count_subsets(alone, low, low) == (1, chosen)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 30), min_size=1, max_size=7), st.integers(1, 12)), min_size=20, max_size=60))
def test_expressions_and_udf_agree(spark, cases):
    rows = table(spark, [(0, tax / 100, [(f"n{i}", 1, c / 100) for i, c in enumerate(cents)]) for cents, tax in cases])
    found = [{(r["id"], r["match_status"], r["description"]) for r in G.infer(rows, enumerated=n).collect()} for n in (0, 8)]
    assert found[0] == found[1]


def test_rows_summary_and_form(spark):
    rows = G.rebate_rows(table(spark, [(1, 0.13, [("thing", 1, 1)])] * 30))
    form = G.form_rows(rows)
    assert [(r["page"], r["total_cents"], r["total"]) for r in G.page_totals(form).orderBy("page").collect()] == [(1, 143, "1.43"), (2, 247, "2.47")]
    assert [(r["row_number"], r["page"], r["slot"]) for r in form.orderBy("row_number").collect()][10:12] == [(11, 1, 11), (12, 2, 1)]
    assert tuple(G.summary(rows).first()) == (30, 30, 0, 0)
    assert G.form_fields(form, "L", "F").where("field = 'tax'").count() == 30
    with pytest.raises(ValueError):
        G.form_rows(G.rebate_rows(table(spark, [(1, 0.13, [("thing", 1, 1)])] * 31)))
    assert [r["total"] for r in G.page_totals(G.form_rows(rows.limit(0))).collect()] == ["0.00", "0.00"]


def test_form_order_puts_blank_dates_last(spark):
    rows = spark.createDataFrame([("", "a"), ("2026-01-02", "b"), ("2026-01-01", "B"), ("2026-01-01", "a")], "date string, receipt_id string")
    assert [r["receipt_id"] for r in G.in_form_order(rows).collect()] == ["a", "B", "b", "a"]


def test_interval_is_exact():
    for points in (500, 1200, 1300, 1500):
        for tax in range(1, 60):
            low, high = S.matching_sums(tax, points)
            fits = [c for c in range(0, 20_000) if (c * points + 5000) // 10_000 == tax]
            assert (low, high) == (fits[0], fits[-1])


def test_names():
    assert [X.range_name("gst288", "csv", *r) for r in ((None, None), ("07/01/26", None), (None, "2026-07-31"), ("2026-07-01", "July 31, 2026"), ("x", "y"))] == ["gst288.csv", "gst288-from-2026-07-01.csv", "gst288-through-2026-07-31.csv", "gst288-2026-07-01-to-2026-07-31.csv", "gst288.csv"]
    assert (X.progress(0, 0.05, 3), X.progress(3, 0, 3), X.progress(0, 0, 0), X.progress(0, 0, 0, True)) == (2, 100, 0, 100)


@pytest.mark.parametrize("half", [0, 1 << 20])
@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=9), st.integers(1, 200), st.integers(0, 8))
def test_counting_by_lists_and_by_halves(half, cents, low, more):
    whole, G.ARRAY, G.HALF = (G.ARRAY, G.HALF), -1, half
    try:
        n, places = G.count_subsets(cents, low, low + more)
    finally:
        G.ARRAY, G.HALF = whole
    expected, one = brute(cents, low, low + more)
    assert n == expected and (n != 1 or places == one)


def test_few_lines_of_large_amounts_take_no_array():
    import random
    import time

    rng = random.Random(8)
    cases = [[rng.randint(100_000, 10_000_000) for _ in range(n)] for n in range(7, 15) for _ in range(10)]
    began = time.perf_counter()
    for cents in cases:
        low = cents[0] + cents[-1]
        n, places = G.count_subsets(cents, low, low + 7)
        assert n == 2 or places == [0, len(cents) - 1]
    assert time.perf_counter() - began < 0.2
