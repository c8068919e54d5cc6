"""The rebate schedule: which line items explain a receipt's tax, one row per eligible receipt, summary and form pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import receipts as R

#: Largest number of candidate lines whose subsets are enumerated as column expressions; more go through the counting UDF,
#: which takes a step for each line, on an array of all sums, instead of one for each subset.
ENUMERATED = 6
#: Largest sum (in units of what divides all amounts) for which an array of all sums is made; beyond it only the sums that occur are listed.
ARRAY = 1 << 26
#: Steps of an array of all sums that cost as much as one subset of a half, and the most subsets of a half that are listed.
STEPS, HALF = 200, 1 << 20
# The rows of the form and of its two pages, and the words that mark a line as no purchase.
MAX_ROWS, PAGE_ROWS = 30, (11, 19)
_NOT_BOUGHT = r"(?i)\b(?:discount|coupon|adjustment)\b"


def bought_items(items: Column) -> Column:
    """Items with a name and positive quantity and price that are no discount, coupon or adjustment."""
    named = lambda x: S.let(S.trimmed(x["name"]), lambda n: (n != "") & ~n.rlike(_NOT_BOUGHT))
    return F.filter(items, lambda x: F.coalesce((S.finite(x["quantity"]) > 0) & (S.finite(x["price"]) > 0) & named(x), F.lit(False)))


def describe_items(items: Column) -> Column:
    """Items by name in any case, in order of first appearance under the first spelling, positive whole quantities added up."""
    shaped = F.transform(items, lambda x: S.let(S.trimmed(x["name"]), lambda n: F.struct(n.alias("name"), F.lower(n).alias("key"), S.positive_whole(x["quantity"]).alias("quantity"))))

    def one(own: Column) -> Column:
        quantities = F.filter(F.transform(own, lambda x: x["quantity"]), lambda q: q.isNotNull())
        total = F.aggregate(quantities, F.lit(None).cast("double"), lambda a, q: F.coalesce(a, F.lit(0.0)) + q)
        return F.concat(S.let(total, lambda t: F.when(t.isNull(), "").otherwise(F.concat(S.plain_number(t), F.lit(" × ")))), F.get(own, F.lit(0))["name"])

    def all_(named: Column) -> Column:
        keys = F.array_distinct(F.transform(named, lambda x: x["key"]))
        return F.array_join(F.transform(keys, lambda key: S.let(F.filter(named, lambda x: x["key"] == key), one)), "; ")

    return S.let(F.filter(shaped, lambda x: x["name"] != ""), all_)


def candidates(items: Column) -> Column:
    """Lines that may be taxable: quantity and price not negative; each line's value in cents, rounded by itself."""
    usable = F.filter(items, lambda x: F.coalesce((S.finite(x["quantity"]) >= 0) & (S.finite(x["price"]) >= 0), F.lit(False)))
    return F.transform(usable, lambda x: F.struct(F.coalesce(S.trimmed(x["name"]), F.lit("")).alias("name"), x["quantity"].alias("quantity"), S.cents(x["quantity"] * x["price"]).alias("cents")))


def _interval(tax: Column, points: int) -> tuple[Column, Column]:
    """The sums in cents whose tax is ``tax``: one interval."""
    return F.ceil((tax * 10_000 - 5_000) / points).cast("long"), F.floor((tax * 10_000 + 4_999) / points).cast("long")


def _picked(lines: Column, chosen: Column) -> Column:
    return F.filter(lines, lambda x, i: F.array_contains(chosen, i))


def _enumerate(lines: Column, low: Column, high: Column) -> Column:
    """How many subsets have a sum within the bounds, and the places of the first, as a struct of n and places."""
    bit = lambda mask, i: F.getbit(mask, i) == 1
    total = lambda mask: F.aggregate(F.transform(lines, lambda x, i: F.when(bit(mask, i), x["cents"]).otherwise(0)), F.lit(0).cast("long"), lambda a, c: a + c)
    masks = F.sequence(F.lit(1).cast("long"), F.pow(F.lit(2), F.size(lines)).cast("long") - 1)
    good = F.filter(masks, lambda m: S.let(total(m), lambda t: t.between(low, high)))
    places = lambda mask: F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: bit(mask, i))
    return S.let(good, lambda g: F.struct(F.size(g).alias("n"), S.let(F.get(g, F.lit(0)), places).alias("places")))


def _reachable(values: np.ndarray, limit: int, low: int | None = None) -> np.ndarray:
    """For each sum up to ``limit`` how many subsets of the values (all above 0) have it, counted up to 2. Given ``low``, it ends as soon as two subsets
    have a sum of at least ``low``: what the other values add doesn't matter then."""
    ways, top = np.zeros(limit + 1, np.uint8), 0
    ways[0] = 1
    for value in values.tolist():
        if value > limit:
            continue
        top = min(limit, top + value)
        ways[value : top + 1] += ways[: top + 1 - value].copy()
        np.minimum(ways[: top + 1], 2, out=ways[: top + 1])
        if low is not None and top >= low and int(ways[low : top + 1].sum(dtype=np.int64)) >= 2:
            break
    return ways


def _sums(values: np.ndarray) -> np.ndarray:
    """The sums of all subsets, by the bits of the subset's number."""
    sums = np.zeros(1, np.int64)
    for value in values:
        sums = np.concatenate([sums, sums + value])
    return sums


def _by_halves(values: np.ndarray, places: np.ndarray, low: int, high: int) -> tuple[int, list[int]]:
    """How many subsets have a sum in low..high, and the only one's places: the sums of one half's subsets are looked up among those of the other half."""
    half = len(values) // 2
    left, right = _sums(values[:half]), _sums(values[half:])
    order = np.argsort(right, kind="stable")
    ordered = right[order]
    first = np.searchsorted(ordered, low - left)
    many = np.searchsorted(ordered, high - left, "right") - first
    n = int(many.sum())
    if n != 1:
        return n, []
    i = int(np.argmax(many))
    number = i | int(order[first[i]]) << half
    return 1, [int(place) for bit, place in enumerate(places) if number >> bit & 1]


def _few_sums(values: np.ndarray, places: np.ndarray, low: int, high: int) -> tuple[int, list[int]]:
    """Subsets with a sum in low..high, up to 2, and the only one's places: for sums too far apart for an array of all of them. Each step lists the sums
    that can be reached, with their ways; the only subset is found by going back through the lists."""
    steps, ways = [np.zeros(1, np.int64)], np.ones(1, np.int64)
    for value in values.tolist():
        sums = np.concatenate([steps[-1], steps[-1] + value])
        sums, back = np.unique(sums, return_inverse=True)
        ways = np.minimum(np.bincount(back, np.concatenate([ways, ways])), 2)
        ways, sums = ways[sums <= high], sums[sums <= high]
        steps.append(sums)
        if ways[sums >= low].sum() >= 2:
            return 2, []
    fits = np.flatnonzero(steps[-1] >= low)
    if not len(fits):
        return 0, []
    total, chosen = int(steps[-1][fits[0]]), []
    for i in range(len(values) - 1, -1, -1):
        if not (steps[i] == total).any():
            chosen.append(int(places[i]))
            total -= int(values[i])
    return 1, chosen


def _only_subset(values: np.ndarray, places: np.ndarray, total: int) -> list[int]:
    """The places of the one subset with this sum: both halves' sums meet in one pair, and each half is divided on."""
    if total == 0:
        return []
    if len(values) == 1:
        return [int(places[0])]
    half = len(values) // 2
    left, right = _reachable(values[:half], total), _reachable(values[half:], total)
    split = int(np.flatnonzero((left > 0) & (right[::-1] > 0))[0])
    return _only_subset(values[:half], places[:half], split) + _only_subset(values[half:], places[half:], total - split)


def count_subsets(cents: list[int], low: int, high: int) -> tuple[int, list[int]]:
    """Subsets (by place) whose sum lies in low..high (low above 0), counted up to 2, and the places of one if it is the only one.

    Where subsets of halves are fewer than the steps of an array, both halves' sums are listed and looked up in each other. Else an array has the ways to each sum,
    up to 2, and takes a value in one step; it ends at the second subset. Where most of the lines are wanted the lines left out are
    counted instead, amounts are divided by what divides all of them, and values that are too large play no part. A line of 0 cents makes every subset two."""
    values = np.array(cents, np.int64)
    places = np.flatnonzero(values > 0)
    values, zeros = values[places], len(cents) - len(places)
    order = np.argsort(-values, kind="stable")
    values, places = values[order], places[order]
    total = int(values.sum())
    low, high = max(low, 0), min(high, total)
    if low > high:
        return 0, []
    unit = int(np.gcd.reduce(values)) if len(values) else 1
    values, total, low, high = values // unit, total // unit, -(-low // unit), high // unit
    if low > high:
        return 0, []
    others = total - low < high  # the lines left out have the smaller sums
    a, b = (total - high, total - low) if others else (low, high)
    own = values <= b  # larger ones play no part
    values, places_ = values[own], places[own]
    half = 1 << (len(values) + 1) // 2
    if half <= HALF and (b > ARRAY or half * STEPS < b * len(values)):
        n, found = _by_halves(values, places_, a, b)
    elif b > ARRAY:
        n, found = _few_sums(values, places_, a, b)
    else:
        ways = _reachable(values, b, a)[a:]
        n, found = int(ways.sum(dtype=np.int64)), None
    n *= 2 if zeros else 1
    if n != 1:
        return min(2, n), []
    chosen = set(_only_subset(values, places_, a + int(np.argmax(ways))) if found is None else found)
    return 1, sorted(set(places.tolist()) - chosen if others else chosen)


def _count_udf():
    """From an array of low, high and the lines' cents, null where there is nothing to count."""

    @F.pandas_udf("struct<n:int,places:array<int>>")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for asked in batches:
            rows = [(0, []) if values is None else count_subsets([int(c) for c in values[2:]], int(values[0]), int(values[1])) for values in asked]
            yield pd.DataFrame({"n": [r[0] for r in rows], "places": [r[1] for r in rows]})

    return count


def infer(receipts: DataFrame, rate_percent: float | None = None, enumerated: int = ENUMERATED) -> DataFrame:
    """``receipts`` with match_status (matched, ambiguous, unmatched) and description.

    Without a positive tax or rate: unmatched. If the subtotal's tax is the receipt's, everything bought is the answer. Else the
    subsets of lines whose sum has that tax are counted: exactly one is an answer, several are ambiguous. Receipts of more than
    ``enumerated`` lines are counted by an Arrow UDF over arrays of sums, for the others it gets nothing to count. The
    receipts are read once."""
    points = S.basis_points(rate_percent)
    if points is None:
        return receipts.withColumns({"match_status": F.lit("unmatched"), "description": F.lit("")})
    low, high = _interval(F.col("_tax"), points)
    rows = receipts.withColumns({"_tax": S.cents(S.finite(F.col("tax"))), "_sub": S.cents(S.finite(F.col("subtotal"))), "_lines": candidates(F.coalesce("items", F.array().cast(receipts.schema["items"].dataType)))})
    rows = rows.withColumns({"_low": low, "_high": high})
    taxed = F.coalesce(F.col("_tax") > 0, F.lit(False))
    whole = taxed & F.coalesce(S.tax_cents(F.col("_sub"), rate_percent) == F.col("_tax"), F.lit(False))
    n = F.size("_lines")
    rows = rows.withColumns({"_whole": whole, "_open": F.when(taxed & ~whole & (n > 0), n).otherwise(0)})
    listed = F.concat(F.array("_low", "_high"), F.transform("_lines", lambda x: x["cents"]))
    counted = rows.withColumn("_counted", _count_udf()(F.when(F.col("_open") > enumerated, listed)))
    small = F.when(F.col("_open").between(1, enumerated), _enumerate(F.col("_lines"), F.col("_low"), F.col("_high"))).otherwise(F.col("_counted"))
    both = counted.withColumn("_r", small).withColumns({"_n": F.col("_r.n"), "_places": F.col("_r.places")})
    status = F.when(F.col("_whole") | (F.col("_n") == 1), "matched").when(F.col("_n") > 1, "ambiguous").otherwise("unmatched")
    text = F.when(F.col("_whole"), describe_items(bought_items(F.col("items")))).when(F.col("_n") == 1, describe_items(_picked(F.col("_lines"), F.col("_places")))).otherwise("")
    return both.withColumns({"match_status": status, "description": text}).drop("_tax", "_sub", "_lines", "_low", "_high", "_n", "_places", "_whole", "_open", "_counted", "_r")


def check_rate(rate_percent: float) -> float:
    """Refuses a rate in percent that isn't above 0 and at most 100."""
    if not 0 < float(rate_percent) <= 100:
        raise ValueError("enter a rate between 0 and 100 %")
    return float(rate_percent)


def rebate_rows(receipts: DataFrame, from_date: str | None = None, to_date: str | None = None, rate_percent: float | None = None) -> DataFrame:
    """Rows of receipts with a positive tax in the range: date, invoice_id, supplier, description, tax, tax_cents, receipt_id, status."""
    date = S.purchase_date(F.coalesce("purchase_date", F.lit("")))
    tax = S.cents(S.finite(F.col("tax")))
    eligible = receipts.where((tax > 0) & R.date_bounds(date, from_date, to_date))
    return infer(eligible, rate_percent).select(
        S.date_text(date).alias("date"), F.coalesce("invoice_id", F.lit("")).alias("invoice_id"), F.coalesce("vendor", F.lit("")).alias("supplier"), "description",
        S.money(tax).alias("tax"), tax.alias("tax_cents"), F.col("id").alias("receipt_id"), F.col("match_status").alias("status"),
    )


def in_form_order(rows: DataFrame) -> DataFrame:
    """By date (blank last), then by receipt as a reader would sort."""
    return rows.orderBy((F.col("date") == "").asc(), "date", F.collate("receipt_id", "UNICODE"))


def summary(rows: DataFrame) -> DataFrame:
    """Number of rows and how many there are of each status."""
    return rows.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("matched", "ambiguous", "unmatched")))


def form_rows(rows: DataFrame) -> DataFrame:
    """Rows with row_number, page and slot of the form. More than 30 rows are refused, not cut off."""
    if rows.limit(MAX_ROWS + 1).count() > MAX_ROWS:
        raise ValueError(f"the form holds {MAX_ROWS} receipts; narrow the date range")
    # at most 30 rows are left, so one partition is enough
    order = Window.orderBy((F.col("date") == "").asc(), "date", F.collate("receipt_id", "UNICODE"))
    number = F.row_number().over(order)
    numbered = rows.withColumn("row_number", number)
    page = F.when(F.col("row_number") <= PAGE_ROWS[0], 1).otherwise(2)
    return numbered.withColumn("page", page).withColumn("slot", F.col("row_number") - F.when(page == 1, 0).otherwise(PAGE_ROWS[0]))


def page_totals(form: DataFrame) -> DataFrame:
    """Tax of each of the form's two pages, in whole cents and as text; a page without rows has 0.00."""
    pages = form.sparkSession.range(1, 3).select(F.col("id").cast("int").alias("page"))
    sums = form.groupBy("page").agg(F.sum("tax_cents").alias("cents"))
    return pages.join(sums, "page", "left").select("page", F.coalesce("cents", F.lit(0)).alias("total_cents"), S.money(F.coalesce("cents", F.lit(0))).alias("total"))


def form_fields(form: DataFrame, last_name: str = "", first_name: str = "") -> DataFrame:
    """The form's content as (page, slot, row_number, field, value); the binary form itself is not made here."""
    cells = form.select("page", "slot", "row_number", F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in ("date", "invoice_id", "supplier", "description", "tax")))).alias("c"))
    cells = cells.select("page", "slot", "row_number", "c.field", "c.value")
    none = F.lit(None).cast("int")
    totals = page_totals(form).select("page", none.alias("slot"), none.alias("row_number"), F.explode(F.array(F.struct(F.lit("page_number").alias("field"), F.col("page").cast("string").alias("value")), F.struct(F.lit("page_count").alias("field"), F.lit("2").alias("value")), F.struct(F.lit("page_total").alias("field"), F.col("total").alias("value")))).alias("c"))
    names = form.sparkSession.createDataFrame([(1, "last_name", last_name), (1, "first_name", first_name)], "page int, field string, value string").select("page", none.alias("slot"), none.alias("row_number"), "field", "value")
    return cells.unionByName(totals.select("page", "slot", "row_number", "c.field", "c.value")).unionByName(names)
