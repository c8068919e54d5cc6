"""Receipt-shaped tables from the star-schema test tables, and the same in SQL for the oracles.

An order is a receipt, its lines the items, its customer the vendor. The purchase date is written in the four accepted shapes
and an impossible one, by the order's number. The tax is that of the first line, of all lines, or one that nothing explains.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

OWNER = "owner@example.com"
#: Orders in a shard.
SHARD = 100
#: Images that a task draws: a table of sizes is a small file, its images are a thousand times as large.
DRAWN = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shape(day: Column, key: Column) -> Column:
    k = key % 5
    us = F.when(F.year(day) >= 2000, F.date_format(day, "MM/dd/yy")).otherwise(F.date_format(day, "MMMM d, yyyy"))
    return F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyy/MM/dd")).when(k == 2, us).when(k == 3, F.date_format(day, "MMM d, yyyy")).otherwise("2026-13-01")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, items): each order's lines in a fixed order as an array of name, quantity, price."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    rows = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "p_name", "p_retailprice")))
    items = F.transform(ordered, lambda x: F.struct(x["p_name"].alias("name"), x["l_quantity"].alias("quantity"), x["p_retailprice"].alias("price")))
    return rows.groupBy(F.col("l_orderkey").alias("key")).agg(items.alias("items"))


def receipts(spark: SparkSession, sf_dir: str, with_items: bool = False) -> DataFrame:
    """(id, ord, vendor, category, total, purchase_date, created_at, ..), with items, subtotal and tax if asked for."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = rows.select(
        F.col("o_orderkey").alias("key"), F.concat(F.lit("r"), F.col("o_orderkey")).alias("id"), F.col("o_orderkey").alias("ord"), F.coalesce("c_name", F.lit("")).alias("vendor"), F.col("o_orderpriority").alias("category"),
        F.col("o_totalprice").alias("total"), _shape(F.col("o_orderdate"), F.col("o_orderkey")).alias("purchase_date"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), F.concat(F.lit("INV-"), F.col("o_orderkey")).alias("invoice_id"),
    )
    if not with_items:
        return rows
    rows = rows.join(line_items(spark, sf_dir), "key", "left")
    cents = F.transform("items", lambda x: S.cents(x["quantity"] * x["price"]))
    whole = F.coalesce(F.aggregate(cents, F.lit(0).cast("long"), lambda a, c: a + c), F.lit(0).cast("long"))
    first = F.coalesce(F.get(cents, F.lit(0)), F.lit(0).cast("long"))
    k = F.col("key") % 4
    tax = F.when(k == 2, S.tax_cents(whole)).when(k == 3, F.lit(1).cast("long")).otherwise(S.tax_cents(first))
    return rows.withColumns({"subtotal": F.when(k == 2, whole / 100).otherwise(F.lit(0.0)), "tax": tax / 100})


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard documents of receipts. Every seventh receipt lacks its category; receipts of the second order of a hundred also
    stand in the next shard, complete and under another vendor."""
    own = F.floor(F.col("key") / SHARD)
    both = receipts(spark, sf_dir).withColumn("shard", F.explode(F.when(F.col("key") % SHARD == 1, F.array(own, own + 1)).otherwise(F.array(own))))
    again = F.col("shard") > own
    both = both.withColumns({"vendor": F.when(again, F.concat(F.lit("again "), F.col("vendor"))).otherwise(F.col("vendor")), "category": F.when(~again & (F.col("key") % 7 == 0), "").otherwise(F.col("category"))})
    meta = F.to_json(F.struct("vendor", F.col("total").alias("subtotal"), F.lit(0.0).alias("tax"), "total", "category", "purchase_date", "created_at"))
    entries = F.array_sort(F.collect_list(F.struct("key", "id", meta.alias("meta"))))
    # the map's JSON text keeps the order of its entries
    joined = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), e["id"], F.lit('":'), e["meta"])), ","), F.lit("}"))
    docs = both.groupBy("shard").agg(joined.alias("receipt_metadata"))
    return docs.select(F.col("shard").alias("ord"), F.concat(F.lit("s"), F.col("shard")).alias("id"), F.lit("receipt_shard").alias("_schema"), F.lit(OWNER).alias("owner_email"), F.col("shard").cast("string").alias("shard_index"), "receipt_metadata")


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail documents: a category for every fourteenth receipt, under another vendor that must not win."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").where(key % 14 == 0)
    data = F.to_json(F.struct(F.lit("detail vendor").alias("vendor"), F.lit("from detail").alias("category"), F.lit("text").alias("extracted_text")))
    return rows.select(F.concat(F.lit("s"), F.floor(key / SHARD)).alias("shard_doc_id"), F.concat(F.lit("r"), key).alias("receipt_id"), data.alias("data"))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as purchases, lines as cards: returned lines are archived; every third order's sales receipt is unknown."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_quantity", "l_shipdate")
    digits = lambda n, m: F.lpad((F.col("l_partkey") * 7919 + F.col("l_orderkey") * 104729 + m).cast("string"), n, "0")
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_returnflag")
    card = F.struct(
        *order, digits(30, 1).alias("activation_barcode"), digits(11, 2).alias("vanilla_serial"), F.lpad((F.col("l_partkey") % 10000).cast("string"), 4, "0").alias("last4"),
        F.when(F.col("l_returnflag") == "R", "archived").otherwise("active").alias("state"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("p/"), F.col("l_partkey"))).alias("package_image_storage_path"),
        F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("o/"), F.col("l_partkey"))).alias("opened_card_image_storage_path"), F.col("l_extendedprice").alias("denomination"), F.lit(None).cast("string").alias("pan_hash"),
    )
    cards = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(card)).alias("raw"))
    names = ("activation_barcode", "vanilla_serial", "denomination", "state", "last4", "pan_hash", "package_image_storage_path", "opened_card_image_storage_path")
    shaped = F.transform("raw", lambda x, i: F.struct(F.concat(F.lit("c"), i + 1).alias("id"), *(x[n].alias(n) for n in names)))
    activation = F.transform(F.sequence(F.lit(1), (F.col("l_orderkey") % 3 + 1).cast("int")), lambda i: F.struct(F.concat(F.lit("a"), i).alias("id"), F.concat(F.lit("act/"), i).alias("storage_path")))
    return cards.select(
        F.concat(F.lit("p"), F.col("l_orderkey")).alias("id"), F.lit(OWNER).alias("owner_email"), F.when(F.col("l_orderkey") % 3 == 0, F.concat(F.lit("x"), F.col("l_orderkey"))).otherwise(F.concat(F.lit("r"), F.col("l_orderkey"))).alias("sales_receipt_id"),
        activation.alias("activation_receipts"), shaped.alias("cards"), F.lit("1999-01-01").alias("created_at"), F.col("l_orderkey").alias("ord"),
    )


def drawn(parts: DataFrame) -> DataFrame:
    """Images for parts (p_partkey, p_size): a white rectangle, its place by the size, on a 80x60 ground of luma 25.

    They are spread over tasks by their number, which the files' footers tell, as the scan's own tasks go by bytes."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            pixels = []
            for size in rows["p_size"]:
                image = np.full((60, 80, 4), 25, np.uint8)
                image[..., 3] = 255
                image[12:48, 10 + int(size) % 20 : 60] = 255
                pixels.append(image.tobytes())
            yield pd.DataFrame({"id": rows["p_partkey"], "width": 80, "height": 60, "pixels": pixels})

    rows = parts.select("p_partkey", "p_size")
    return rows.repartition(max(1, -(-parts.count() // DRAWN)), "p_partkey").mapInPandas(draw, "id long, width int, height int, pixels binary")


def bitmap(width: int, height: int, rgba: bytes) -> bytes:
    """A BMP file of 24 bits a pixel."""
    own = np.frombuffer(rgba, np.uint8).reshape(height, width, 4)
    lines = np.zeros((height, -(-3 * width // 4) * 4), np.uint8)  # lines are filled up to four bytes, the last one comes first
    lines[:, : 3 * width] = own[::-1, :, 2::-1].reshape(height, 3 * width)
    head = np.array([40, width, height, 1 | 24 << 16, 0, lines.size, 2835, 2835, 0, 0], "<u4").tobytes()
    return b"BM" + np.array([54 + lines.size, 0, 54], "<u4").tobytes() + head + lines.tobytes()


#: Common table expressions: r (receipts), i (items with place, from 0, and cents), t (tax and subtotal in cents), d (normalised dates).
SQL = r"""
r AS (SELECT o_orderkey AS k, 'r' || o_orderkey AS id, coalesce(c_name, '') AS vendor, o_orderpriority AS category, o_totalprice AS total, o_orderdate,
      CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d')
        WHEN 2 THEN CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%m/%d/%y') ELSE strftime(o_orderdate, '%B %-d, %Y') END
        WHEN 3 THEN strftime(o_orderdate, '%b %-d, %Y') ELSE '2026-13-01' END AS purchase_date
      FROM orders LEFT JOIN customer ON c_custkey = o_custkey),
d AS (SELECT k, CASE WHEN regexp_matches(purchase_date, '^\d{4}-\d{2}-\d{2}$') THEN CAST(try_strptime(purchase_date, '%Y-%m-%d') AS DATE)
        WHEN regexp_matches(purchase_date, '^\d{4}/\d{2}/\d{2}$') THEN CAST(try_strptime(purchase_date, '%Y/%m/%d') AS DATE)
        WHEN regexp_matches(purchase_date, '^\d{2}/\d{2}/\d{2}$') THEN CAST(try_strptime(purchase_date[1:6] || '20' || purchase_date[7:8], '%m/%d/%Y') AS DATE)
        WHEN regexp_matches(purchase_date, '^[A-Za-z]{3} ') OR purchase_date[1:4] = 'May ' THEN CAST(try_strptime(purchase_date, '%b %-d, %Y') AS DATE)
        ELSE CAST(try_strptime(purchase_date, '%B %-d, %Y') AS DATE) END AS day FROM r),
i AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS pos, p_name AS name, l_quantity AS quantity, p_retailprice AS price,
      CAST(floor((l_quantity * p_retailprice + 2.220446049250313e-16) * 100 + 0.5) AS BIGINT) AS cents FROM lineitem JOIN part ON p_partkey = l_partkey),
s AS (SELECT k, CAST(sum(cents) AS BIGINT) AS whole, arg_min(cents, pos) AS first FROM i GROUP BY k),
t AS (SELECT r.k, CASE r.k % 4 WHEN 2 THEN (coalesce(whole, 0) * 1300 + 5000) // 10000 WHEN 3 THEN 1 ELSE (coalesce(first, 0) * 1300 + 5000) // 10000 END AS tax,
      CASE r.k % 4 WHEN 2 THEN coalesce(whole, 0) ELSE 0 END AS subtotal FROM r LEFT JOIN s ON s.k = r.k)
"""
