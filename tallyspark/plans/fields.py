"""Queries of the rules for single fields and for the list's order and state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import merge as M
from ..operators import receipts as R
from ..sources import documents as D
from . import adapter as A
from .queries import query


@query(
    "WITH x AS (SELECT id, k, vendor, CASE k % 5 WHEN 3 THEN 0 WHEN 4 THEN NULL ELSE epoch_ms(CAST(o_orderdate AS TIMESTAMP)) - CASE k % 5 WHEN 2 THEN 7200000 ELSE 0 END END AS ms FROM r) "
    "SELECT id, row_number() OVER (PARTITION BY vendor ORDER BY ms DESC NULLS LAST, k) AS place FROM x"
)
def list_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each receipt's place among its vendor's: newest first, times with a zone among them, blank ones as the epoch, unreadable ones last."""
    k, day = F.col("ord") % 5, F.substring("created_at", 1, 10)
    made = F.when(k == 2, F.concat(day, F.lit("T00:00:00+02:00"))).when(k == 3, " ").when(k == 4, "no time").otherwise(F.col("created_at"))
    rows = A.receipts(spark, sf_dir).withColumn("created_at", made)
    return rows.select("id", F.row_number().over(Window.partitionBy("vendor").orderBy(*R.list_order())).cast("long").alias("place"))


@query("SELECT id, CASE WHEN k % 3 = 1 THEN 'uploading' ELSE 'error' END AS status FROM r WHERE k % 3 <> 0")
def unsaved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays in the list when the store is empty: uploads and errors."""
    k = F.col("ord") % 3
    rows = A.receipts(spark, sf_dir).withColumn("status", F.when(k == 0, "success").when(k == 1, "uploading").otherwise("error"))
    return M.keep_unsaved(rows).select("id", "status")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS stamp FROM events", base=False)
def iso_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").select("event_id", S.iso_timestamp(F.col("ts")).alias("stamp"))


@query("SELECT k, pos, CASE WHEN pos % 3 = 2 THEN name ELSE CAST(CAST(quantity AS BIGINT) AS VARCHAR) || ' × ' || name END AS description FROM i")
def item_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's text; every third quantity is no whole number, so the name stands alone."""
    rows = A.line_items(spark, sf_dir).select(F.col("key").alias("k"), F.posexplode("items").alias("pos", "x"))
    quantity = F.col("x.quantity") + F.when(F.col("pos") % 3 == 2, 0.5).otherwise(0.0)
    return rows.select("k", F.col("pos").cast("long").alias("pos"), S.item_description(F.concat(F.lit(" "), "x.name", F.lit("  ")), quantity).alias("description"))


@query("SELECT p_partkey AS id, regexp_replace(lower(p_type || '_[' || p_name || '].0'), '[^a-z0-9]', '', 'g') AS key, p_name || '.webp' AS name, CASE WHEN length(p_name) <= 12 THEN p_name ELSE '...' || right(p_name, 12) END AS tail FROM part", base=False)
def field_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form field's key, a converted image's name and the end of a long name, for each part."""
    key = S.field_key(F.concat("p_type", F.lit("_["), "p_name", F.lit("].0")))
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), key.alias("key"), S.swap_extension(F.concat("p_name", F.lit(".HEIC")), "webp").alias("name"), S.short_tail(F.col("p_name")).alias("tail"))


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN '' WHEN 2 THEN '' ELSE c_name END AS first, CASE c_custkey % 4 WHEN 0 THEN 'of ' || c_nationkey ELSE '' END AS last FROM customer", base=False)
def stored_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in settings as they are stored: whole, broken, with a number in place of a text, and with one of both."""
    k = F.col("c_custkey") % 4
    whole = F.to_json(F.struct(F.col("c_name").alias("firstName"), F.concat(F.lit("of "), "c_nationkey").alias("lastName")))
    text = F.when(k == 0, whole).when(k == 1, F.concat(F.lit("{"), whole)).when(k == 2, F.to_json(F.struct(F.col("c_nationkey").alias("firstName")))).otherwise(F.to_json(F.struct(F.col("c_name").alias("firstName"), F.lit(7).alias("lastName"))))
    return A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), D.name_settings(text).alias("n")).select("id", F.col("n.firstName").alias("first"), F.col("n.lastName").alias("last"))


@query("SELECT id, vendor || ' | ' || CASE WHEN k % 5 < 2 THEN 'kept' ELSE 'gone' END AS line FROM r JOIN d USING (k) WHERE day BETWEEN DATE '1997-01-01' AND DATE '1997-06-30' AND k % 5 < 2")
def exported_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range that is checked before it is exported, of receipts with dates in numbers."""
    rows = R.export_rows(A.receipts(spark, sf_dir).where("ord % 5 < 2"), R.ReceiptFilter("1997/01/01", "Jun 30, 1997"))
    return rows.select("id", F.concat("vendor", F.lit(" | kept")).alias("line"))
