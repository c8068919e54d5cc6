"""Exports: CSV lines, item texts, numbered file names and range file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scalars as S
from .receipts import ReceiptFilter, filter_receipts

# The headers of both exports.
RECEIPT_HEADER = ("Date", "Invoice ID", "Merchant Name", "Items Purchased", "Total GST/HST")
REBATE_HEADER = ("Date", "Invoice ID", "Supplier Name", "Brief Description of Purchases", "GST/HST")
#: Places of the order that are numbered together; a shard is taken for a hundred places.
SLICE = 100_000


def items_text(items: Column) -> Column:
    """``name xQ ($P.PP)`` for each item in order, empty parts and items left out, joined by semicolons."""
    quantity = lambda x: F.when(S.finite(x["quantity"]).isNotNull(), F.concat(F.lit("x"), S.plain_number(x["quantity"]))).otherwise("")
    price = lambda x: F.when(S.finite(x["price"]).isNotNull(), F.concat(F.lit("($"), S.two_decimals(x["price"]), F.lit(")"))).otherwise("")
    one = lambda x: F.array_join(F.filter(F.array(S.trimmed(F.coalesce(x["name"], F.lit(""))), quantity(x), price(x)), lambda p: p != ""), " ")
    return F.array_join(F.filter(F.transform(F.coalesce(items, F.array().cast("array<struct<name:string,quantity:double,price:double>>")), one), lambda t: t != ""), "; ")


def csv_line(*fields: Column) -> Column:
    """Every field quoted, separated by commas."""
    return F.concat_ws(",", *(S.csv_field(f) for f in fields))


def receipt_lines(receipts: DataFrame, wanted: ReceiptFilter | None = None) -> DataFrame:
    """(ord, line) of the receipt export, without its header."""
    rows = filter_receipts(receipts, wanted or ReceiptFilter())
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select("ord", csv_line(S.date_text(S.purchase_date(text("purchase_date"))), text("invoice_id"), text("vendor"), items_text(F.col("items")), S.plain_number(F.col("tax"))).alias("line"))


def rebate_lines(rows: DataFrame) -> DataFrame:
    """(date, receipt_id, line) of the rebate export, without its header."""
    return rows.select("date", "receipt_id", csv_line(*(F.col(c) for c in ("date", "invoice_id", "supplier", "description", "tax"))).alias("line"))


def header_line(names: tuple[str, ...]) -> str:
    return ",".join('"' + n.replace('"', '""') + '"' for n in names)


def image_names(receipts: DataFrame) -> DataFrame:
    """(id, ord, name): ``date - vendor.jpg``, numbered from the second of a name on, in order.

    A name that a great share of all receipts have is numbered slice by slice of the order, and each slice's numbers begin behind
    those of the slices before it, so no task sees more rows than a slice. ``ord`` is a number, or a struct that begins with one."""
    base = F.concat(F.coalesce(F.date_format(S.purchase_date(F.coalesce("purchase_date", F.lit(""))), "yyyy-MM-dd"), F.lit("unknown-date")), F.lit(" - "), S.filename_part(F.coalesce("vendor", F.lit("")), "Unknown retailer"))
    kind = receipts.schema["ord"].dataType
    place = F.col("ord") if not isinstance(kind, StructType) else F.col(f"ord.{kind.fields[0].name}") * (SLICE // 100)
    named = receipts.select("id", "ord", base.alias("base"), F.floor(place / SLICE).alias("slice"))
    sizes = named.groupBy("base", "slice").agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.partitionBy("base").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("base", "slice", before.alias("before")).where("before > 0")  # of names that go on from a slice before
    named = named.withColumn("own", F.row_number().over(Window.partitionBy("base", "slice").orderBy("ord")))
    named = named.join(sizes, ["base", "slice"], "left").withColumn("n", F.coalesce("before", F.lit(0)) + F.col("own"))
    return named.select("id", "ord", F.concat("base", F.when(F.col("n") > 1, F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).otherwise(""), F.lit(".jpg")).alias("name"))


def range_name(stem: str, extension: str, from_date: str | None = None, to_date: str | None = None) -> str:
    """A file name for a date range; a bound that can't be read counts as none."""
    low, high = S.read_date(from_date), S.read_date(to_date)
    part = f"-{low:%Y-%m-%d}-to-{high:%Y-%m-%d}" if low and high else f"-from-{low:%Y-%m-%d}" if low else f"-through-{high:%Y-%m-%d}" if high else ""
    return f"{stem}{part}.{extension}"


def progress(done: int, fraction: float, total: int, finished: bool = False) -> int:
    """Percent of an export that is done."""
    return (100 if finished else 0) if not total else min(100, int((done + fraction) / total * 100 + 0.5))
