"""Receipts: projection of stored documents, resolution of duplicates, filters, groups, totals and order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import documents as D
from ..sources import store

# The columns of a receipt.
COLUMNS = ("id", "vendor", "subtotal", "tax", "total", "category", "purchase_date", "invoice_id", "extracted_text", "extracted_fields", "items", "created_at", "image_url", "image_grayscale", "status", "shard_doc_id")
# The fields that edits copy into the shard's metadata.
MIRRORED = ("vendor", "subtotal", "tax", "total", "category", "purchase_date", "invoice_id")
_TEXTS, _NUMBERS = ("vendor", "category", "purchase_date"), ("subtotal", "tax", "total")


@dataclass(frozen=True)
class ReceiptFilter:
    """What a list or an export asks for; an empty part asks for nothing."""

    from_date: str | None = None
    to_date: str | None = None
    categories: Sequence[str] = ()
    vendor: str | None = None


def _read(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """``rows`` with every field of a JSON column as a column of its own, read once: texts, numbers, lists, truths."""
    rows = rows.withColumn(f"{prefix}_doc", F.try_parse_json(column))
    doc = F.col(f"{prefix}_doc")
    given = D.member(doc, "created_at")
    fields = {f: D.text_of(doc, f) for f in (*_TEXTS, "invoice_id", "extracted_text", "image_url", "created_at")} | {f: D.number_of(doc, f) for f in _NUMBERS}
    fields |= {"items": D.items_of(doc), "fields": D.fields_of(doc), "gray": D.true_of(doc, "image_grayscale"), "created_kind": D.kind_of(given), "created_number": D.number_of(doc, "created_at"), "created_true": D.true_of(doc, "created_at")}
    return rows.select("*", *(c.alias(f"{prefix}_{n}") for n, c in fields.items())).drop(f"{prefix}_doc")


def complete(*prefixes: str) -> Column:
    """Whether the six canonical fields are all there, each in one of the documents read under the prefixes."""
    out = F.lit(True)
    for f in _TEXTS:
        out = out & ~S.is_blank(F.concat(*(F.coalesce(f"{p}_{f}", F.lit("")) for p in prefixes)))
    for f in _NUMBERS:
        out = out & F.coalesce(*(F.col(f"{p}_{f}") for p in prefixes)).isNotNull()
    return out


def _created(prefixes: tuple[str, ...]) -> Column:
    """created_at as text: the detail's if it is anything but missing, empty, zero or false, and then only if it is text."""
    own = F.coalesce("m_created_at", F.lit(""))
    if len(prefixes) == 1:
        return own
    kind = F.coalesce("d_created_kind", F.lit("VOID"))
    truthy = F.when(kind == "STRING", F.col("d_created_at") != "").when(kind == "BOOLEAN", F.col("d_created_true")).when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), F.coalesce("d_created_number", F.lit(0.0)) != 0).otherwise(kind != "VOID")
    return F.when(truthy, F.coalesce("d_created_at", F.lit(""))).otherwise(own)


def project(entries: DataFrame, *prefixes: str) -> DataFrame:
    """Receipts from read entries ("m", the metadata, and "d", the detail): canonical fields from the metadata first, the rest
    from the detail first."""
    col = lambda p, f: F.col(f"{p}_{f}")
    text = lambda f: S.first_text(*(col(p, f) for p in prefixes))
    first = lambda f: F.coalesce(*(col(p, f) for p in prefixes[::-1]))
    lists = lambda f: col("m", f) if len(prefixes) == 1 else F.when(F.size(col("d", f)) > 0, col("d", f)).otherwise(col("m", f))
    values = {
        "id": F.col("receipt_id"), "vendor": text("vendor"), **{n: F.coalesce(*(col(p, n) for p in prefixes), F.lit(0.0)) for n in _NUMBERS},
        "category": text("category"), "purchase_date": text("purchase_date"), "invoice_id": text("invoice_id"), "extracted_text": F.coalesce(first("extracted_text"), F.lit("")),
        "extracted_fields": lists("fields"), "items": lists("items"), "created_at": _created(prefixes), "image_url": first("image_url"),
        "image_grayscale": col("m", "gray") if len(prefixes) == 1 else col("m", "gray") | col("d", "gray"), "status": F.lit("success"), "shard_doc_id": F.col("shard_doc_id"),
    }
    return entries.select(*(values[c].alias(c) for c in COLUMNS), "ord", complete(*prefixes).alias("complete"))


def expand_shards(shards: DataFrame) -> DataFrame:
    """The receipts of shards from their metadata alone, newest first by ``in_order``."""
    return project(_read(D.shard_entries(shards), "meta", "m"), "m").drop("complete")


def all_receipts(shards: DataFrame, details: DataFrame) -> DataFrame:
    """Every receipt of the shards once, with ``ord``, the place of its id's first occurrence.

    Details are looked up for entries with incomplete metadata only: the others have no key to look up, so they meet none and are
    spread over the join's tasks by their shard. Of several entries of an id the first complete one counts, else the last one."""
    entries = _read(D.shard_entries(shards), "meta", "m").withColumn("asks", F.when(~complete("m"), F.col("receipt_id")))
    found = details.select("shard_doc_id", F.col("receipt_id").alias("asks"), "data")
    return resolve_duplicates(project(_read(entries.join(found, ["shard_doc_id", "asks"], "left"), "data", "d"), "m", "d"))


def resolve_duplicates(rows: DataFrame) -> DataFrame:
    """One row per id of rows with (id, ord, complete): the first complete one, else the last; ord becomes the id's first."""
    own = Window.partitionBy("id")
    pick = own.orderBy(F.col("complete").desc(), F.when(F.col("complete"), F.col("ord")).asc_nulls_last(), F.col("ord").desc())
    ranked = rows.withColumn("n", F.row_number().over(pick)).withColumn("first", F.min("ord").over(own))
    return ranked.where("n = 1").drop("n", "ord", "complete").withColumnRenamed("first", "ord")


def find_receipt(shards: DataFrame, details: DataFrame, receipt_id: str) -> DataFrame:
    """The receipt of an id in the first shard that has it, from its detail wherever there is one; empty if no shard has it."""
    entry = D.shard_entries(shards).where(F.col("receipt_id") == receipt_id).orderBy("ord").limit(1)
    joined = entry.join(details.where(F.col("receipt_id") == receipt_id).select("shard_doc_id", "receipt_id", "data"), ["shard_doc_id", "receipt_id"], "left")
    return project(_read(_read(joined, "meta", "m"), "data", "d"), "m", "d").drop("ord", "complete")


def write_index(shards: DataFrame, details: DataFrame, path: str, parts: int = 64) -> None:
    """Lays out, by receipt id, every entry of the shards with its detail, for ``find_indexed``: one row per id and shard."""
    entries = D.shard_entries(shards)
    rows = entries.join(details.select("shard_doc_id", "receipt_id", "data"), ["shard_doc_id", "receipt_id"], "left")
    store.write_table(rows.select("receipt_id", "shard_doc_id", "ord", "meta", "data"), path, ["receipt_id"], parts)


def refresh_index(shards: DataFrame, details: DataFrame, path: str, shard_ids: DataFrame, parts: int = 64, batch: int | None = None) -> list[int]:
    """Brings the index up to date after changes of the shards ``shard_ids`` (id) or their details; returns the parts rewritten. Entries that these shards have lost
    are found by a scan of the index's shard column alone."""
    spark, gone = shards.sparkSession, shard_ids.select(F.col("id").alias("shard_doc_id")).distinct().persist()
    try:
        entries = D.shard_entries(shards.join(shard_ids.select("id").distinct(), "id", "left_semi"))
        fresh = entries.join(details.join(gone, "shard_doc_id", "left_semi").select("shard_doc_id", "receipt_id", "data"), ["shard_doc_id", "receipt_id"], "left").select("receipt_id", "shard_doc_id", "ord", "meta", "data").persist()
        before = store.read_table(spark, path).select("receipt_id", "shard_doc_id").join(gone, "shard_doc_id", "left_semi")
        touched = fresh.select("receipt_id").unionByName(before.select("receipt_id"))
        return store.change_parts(spark, path, ["receipt_id"], parts, touched, lambda rows: rows.join(gone, "shard_doc_id", "left_anti").select(*fresh.columns).unionByName(fresh), batch)
    finally:
        gone.unpersist()


def find_indexed(spark: SparkSession, path: str, receipt_id: str, parts: int = 64) -> DataFrame:
    """``find_receipt`` from the index: one part is opened, the id is pushed down to its files, and no shard is parsed."""
    entry = store.lookup(spark, path, parts, receipt_id=receipt_id).orderBy("ord").limit(1)
    return project(_read(_read(entry, "meta", "m"), "data", "d"), "m", "d").drop("ord", "complete")


def list_order() -> list[Column]:
    """Newest first by creation time; blank times count as the epoch, unreadable ones come last; ties in scan order."""
    return [S.epoch_millis(F.col("created_at")).desc_nulls_last(), F.col("ord").asc()]


def in_order(receipts: DataFrame) -> DataFrame:
    return receipts.orderBy(*list_order())


def date_bounds(date: Column, from_date: str | None, to_date: str | None, stored: bool = False) -> Column:
    """Inclusive bounds on a date; a bound that can't be read asks for nothing, a row without a date fails any bound.

    A date that is not ``stored`` is computed once for both bounds; a stored one is left to the scan, and null bounds are null then."""
    low, high = S.read_date(from_date), S.read_date(to_date)
    if low is None and high is None:
        return F.lit(True)
    within = lambda d: (d >= F.lit(low) if low else F.lit(True)) & (d <= F.lit(high) if high else F.lit(True))
    return within(date) if stored else S.let(date, lambda d: F.coalesce(within(d), F.lit(False)))


def filter_receipts(receipts: DataFrame, wanted: ReceiptFilter) -> DataFrame:
    """Receipts that meet every part of the filter; categories are alternatives, the vendor a part of the name in any case.

    Where the table has ``purchase_day`` (the normalised date, materialised) the bounds are pushed down on it."""
    stored = "purchase_day" in receipts.columns
    date = F.col("purchase_day") if stored else S.purchase_date(F.coalesce("purchase_date", F.lit("")))
    condition = date_bounds(date, wanted.from_date, wanted.to_date, stored)
    categories = sorted({c.strip() for c in wanted.categories} - {""})
    if categories:
        condition = condition & S.trimmed(F.col("category")).isin(*categories)
    vendor = (wanted.vendor or "").strip().lower()
    if vendor:
        condition = condition & F.lower(S.trimmed(F.col("vendor"))).contains(vendor)
    return receipts.where(condition)


def check_range(wanted: ReceiptFilter) -> None:
    """Refuses a range that ends before it begins."""
    low, high = S.read_date(wanted.from_date), S.read_date(wanted.to_date)
    if low and high and low > high:
        raise ValueError("the range ends before it begins")


def with_purchase_day(receipts: DataFrame) -> DataFrame:
    """Receipts with their normalised date as a column, to be written: filters on stored dates reach the scan."""
    return receipts.withColumn("purchase_day", S.purchase_date(F.coalesce("purchase_date", F.lit(""))))


def export_rows(receipts: DataFrame, wanted: ReceiptFilter) -> DataFrame:
    """The receipts that an export of CSV lines or images is made of; a bad range, and a filter that nothing meets, are refused."""
    check_range(wanted)
    rows = filter_receipts(receipts, wanted)
    if rows.isEmpty():
        raise ValueError("no receipts match the selected filters")
    return rows


def group_by_date(receipts: DataFrame, with_rows: bool = False) -> DataFrame:
    """Groups under a date label in the order of their first receipts: label, n, total_cents, first_ord (and the ids)."""
    label = F.when(F.col("purchase_date") == "", "Unknown Date").otherwise(S.date_label(F.col("purchase_date")))
    ids = [F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("ids")] if with_rows else []
    return receipts.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum(S.cents(F.col("total"))).alias("total_cents"), F.min("ord").alias("first_ord"), *ids)


def totals(receipts: DataFrame) -> DataFrame:
    """Number of receipts and the sum of their totals in cents."""
    return receipts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(S.cents(F.col("total"))), F.lit(0)).alias("total_cents"))


def display_rows(receipts: DataFrame) -> DataFrame:
    """What a receipt's card shows."""
    shown = F.when(F.col("purchase_date") == "", "—").otherwise(S.date_label(F.col("purchase_date"), "MMM d, yyyy"))
    return receipts.select("id", F.when(F.col("vendor") == "", "Unknown").otherwise(F.col("vendor")).alias("vendor"), shown.alias("date"), S.two_decimals(F.col("total")).alias("total"))


def select_by_id(visible: DataFrame, everything: DataFrame, receipt_id: str) -> DataFrame:
    """The receipt among the visible ones, else among all."""
    both = visible.withColumn("source", F.lit(0)).unionByName(everything.withColumn("source", F.lit(1)))
    return both.where(F.col("id") == receipt_id).orderBy("source").limit(1).drop("source")


def category_options(*sources: DataFrame) -> DataFrame:
    """Distinct names of several one-column tables, blanks out, sorted as a reader would."""
    union = sources[0].toDF("name")
    for s in sources[1:]:
        union = union.unionByName(s.toDF("name"))
    return union.where(F.col("name") != "").distinct().orderBy(F.collate("name", "UNICODE"))
