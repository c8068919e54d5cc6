"""Queries whose operators write: each lays its tables out in the shared folder, changes them there, and gives back what is read again."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exports as X
from ..operators import images as I
from ..operators import merge as M
from ..operators import receipts as R
from ..sources import archives as Z
from ..sources import documents as D
from ..sources import pictures as P
from ..sources import store
from ..streaming import timers as W
from . import adapter as A
from .queries import _WANTED_SQL, WANTED, category_edits, query

#: Parts of the tables here; small, as the test tables are.
PARTS = 16


@query("SELECT id, vendor, CASE WHEN k % 7 = 0 THEN 'edited' ELSE category END AS category, 's' || k // 100 AS shard_doc_id, total FROM r")
def stored_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of two batches to stored tables, each rewriting the parts that it touches; the first batch comes twice and counts once."""
    shards, details = (store.shared_folder(spark, n) for n in ("shards", "details"))
    store.write_table(A.shards(spark, sf_dir), shards, ["id"], PARTS)
    store.write_table(A.details(spark, sf_dir), details, ["shard_doc_id"], PARTS)
    edits = category_edits(spark, sf_dir)
    first = edits.withColumn("value", F.when(F.col("field") == "category", F.lit('"first"')).otherwise(F.col("value")))
    for batch, rows in ((1, first), (2, edits), (1, first)):
        M.store_edits(shards, details, rows, PARTS, batch)
    rows = R.all_receipts(store.read_table(spark, shards), store.read_table(spark, details))
    return rows.select("id", "vendor", "category", "shard_doc_id", "total")


@query("SELECT id, CASE WHEN k % 10 = 0 THEN 'new ' || vendor ELSE vendor END AS vendor, CASE WHEN k % 100 = 0 THEN 2 WHEN k % 10 = 0 THEN 1 ELSE 0 END AS batch FROM r UNION ALL SELECT 'n' || k, 'new ' || vendor, 2 FROM r WHERE k % 100 = 0")
def stored_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of receipts over a stored list; the later batch is further in front."""
    path = store.shared_folder(spark, "receipts")
    rows = A.receipts(spark, sf_dir).select("id", "ord", "vendor", "key")
    store.write_table(rows.withColumn("batch", F.lit(0)), path, ["id"], PARTS)
    new = rows.where("key % 10 = 0").withColumn("vendor", F.concat(F.lit("new "), F.col("vendor")))
    hundred = new.where("key % 100 = 0")
    for batch, incoming in ((1, new), (2, hundred.unionByName(hundred.withColumn("id", F.concat(F.lit("n"), F.col("key"))))), (1, new)):
        M.store_upserts(path, incoming.withColumn("batch", F.lit(None).cast("int")), PARTS, batch)
    return store.read_table(spark, path).select("id", "vendor", "batch")


@query("SELECT id, vendor, CASE WHEN k % 14 = 0 THEN 'from detail' WHEN k % 7 = 0 THEN '' ELSE category END AS category FROM r WHERE k = 700")
def indexed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``receipt_lookup`` from an index by receipt id over all shards."""
    path = store.shared_folder(spark, "index")
    R.write_index(A.shards(spark, sf_dir), A.details(spark, sf_dir), path, PARTS)
    return R.find_indexed(spark, path, "r700", PARTS).select("id", "vendor", "category")


@query(f"SELECT id, vendor, category FROM r JOIN d USING (k) WHERE {_WANTED_SQL}")
def stored_day_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``filter_receipts`` on a table that has the normalised day: the bounds reach the scan, and files sorted by day are skipped."""
    path = store.shared_folder(spark, "days")
    rows = R.with_purchase_day(A.receipts(spark, sf_dir)).select("id", "vendor", "category", "purchase_date", "purchase_day")
    rows.repartitionByRange("purchase_day").sortWithinPartitions("purchase_day").write.option("compression", "zstd").parquet(path)
    return R.filter_receipts(spark.read.parquet(path), WANTED).select("id", "vendor", "category")


_BYTES = "list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten([[CAST(ord(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] FOR ch IN string_split({0}, '')])), lambda r, e: xor(xor(r, e) >> 1, 3988292384 * (xor(r, e) & 1)))"


@query(
    "WITH b AS (SELECT id, k, coalesce(CAST(day AS VARCHAR), 'unknown-date') || ' - ' || vendor AS base FROM r JOIN d USING (k)), n AS (SELECT id, k, base, row_number() OVER (PARTITION BY base ORDER BY k) AS n FROM b), "
    "e AS (SELECT k, CASE WHEN n > 1 THEN base || ' (' || n || ').jpg' ELSE base || '.jpg' END AS name, 'image of ' || id AS data FROM n) "
    f"SELECT name, CAST(length(data) AS BIGINT) AS size, xor({_BYTES.format('data')}, 4294967295) AS crc, CAST(coalesce(sum(30 + strlen(name) + length(data)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM e"
)
def receipt_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ZIP file of an image for every receipt, written by executors and read back entry by entry."""
    folder, target = store.shared_folder(spark, "parts"), store.shared_folder(spark, "archive")
    archive = Z.write_parts(X.image_names(A.receipts(spark, sf_dir)), folder, lambda key: ("image/jpeg", f"image of {key}".encode()))
    Z.join_parts(spark, archive, f"{target}/receipts.zip")
    return Z.read_entries(spark, archive.directory, f"{target}/receipts.zip").select("name", "size", "crc", "offset")


def _red_sums(pixels: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else int(np.frombuffer(p, np.uint8)[::4].sum()) for p in pixels], dtype="Int64")


def _red(pixels: str) -> Column:
    """The sum of an image's red values, null for none, as a column."""
    return F.pandas_udf(_red_sums, "long")(pixels)


@query("SELECT p_partkey AS id, 40 AS width, 30 AS height, (25 * 4800 + 230 * (50 - p_size % 20) * 36) // 4 AS red, CASE WHEN p_partkey % 2 = 0 THEN 0.65 ELSE 0.75 END AS quality FROM part", base=False)
def export_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn images at half their width, every second one in gray (which leaves gray ones as they are)."""
    images = A.drawn(A.table(spark, sf_dir, "part")).withColumn("image_grayscale", F.col("id") % 2 == 0)
    return I.export_pixels(images, 40).select("id", "width", "height", _red("pixels").alias("red"), "quality")


@query("SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 5 <> 0 THEN 80 END AS width, CASE WHEN s_suppkey % 5 <> 0 THEN 60 END AS height, CASE WHEN s_suppkey % 5 <> 0 THEN 25 * 4800 + 230 * (50 - s_nationkey % 20) * 36 END AS red, CASE WHEN s_suppkey % 5 = 0 THEN 'no picture of ' || s_suppkey END AS original FROM supplier", base=False)
def decoded_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bitmap for each supplier, written under a name that says nothing, found and decoded; what is no image comes back as it is."""
    folder = store.shared_folder(spark, "pictures")
    drawn = A.drawn(A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.col("s_nationkey").alias("p_size")))
    bitmap = F.udf(A.bitmap, "binary")
    text = F.concat(F.lit("no picture of "), F.col("id")).cast("binary")
    files = drawn.select(F.concat(F.lit("s"), "id", F.when(F.col("id") % 2 == 0, ".txt").otherwise("")).alias("name"), F.when(F.col("id") % 5 == 0, text).otherwise(bitmap("width", "height", "pixels")).alias("content"))
    P.save_files(files, folder).write.format("noop").mode("overwrite").save()
    own = F.regexp_extract("path", r"/(s\d+)[^/]*$", 1)
    return P.decode_pictures(spark, folder).select(own.alias("id"), "width", "height", _red("pixels").alias("red"), F.col("original").cast("string").alias("original"))


@query("SELECT 'names:' || replace(replace(c_name, '#', '%23'), ' ', '%20') || '%20(' || c_nationkey || ')' AS key, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS first, CASE WHEN c_custkey % 3 = 0 THEN 'no ' || c_custkey ELSE '' END AS last FROM customer", base=False)
def stored_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of every customer, written as settings, a third of them twice and once more in a second batch."""
    path = store.shared_folder(spark, "settings")
    store.write_table(spark.createDataFrame([], "key string, value string"), path, ["key"], PARTS)
    who = F.concat("c_name", F.lit(" ("), "c_nationkey", F.lit(")"))
    rows = A.table(spark, sf_dir, "customer").select(who.alias("identity"), F.lit(1).alias("ord"), F.lit("old").alias("first_name"), F.lit(None).cast("string").alias("last_name"), "c_custkey")
    later = rows.where("c_custkey % 3 = 0").withColumns({"first_name": F.lit("new"), "last_name": F.concat(F.lit("no "), "c_custkey")})
    for batch, changes in ((1, rows.unionByName(later.withColumn("ord", F.lit(0)))), (2, later), (1, rows)):
        M.store_names(path, changes, "names:", PARTS, batch)
    return store.read_table(spark, path).select("key", D.name_settings(F.col("value")).alias("n")).select("key", F.col("n.firstName").alias("first"), F.col("n.lastName").alias("last"))


_DONE = "WITH x AS (SELECT CAST(user_id AS VARCHAR) AS key, ts FROM events WHERE event_type = 'purchase'), y AS (SELECT key, ts, lead(ts) OVER (PARTITION BY key ORDER BY ts) AS n FROM (SELECT DISTINCT key, ts FROM x)), z AS (SELECT key, ts AS due, 'now' AS kind FROM x UNION ALL SELECT key, ts + INTERVAL 1 HOUR, 'later' FROM y WHERE n IS NULL OR n > ts + INTERVAL 1 HOUR) "
_AT = "SELECT key, CAST(epoch_us(due) AS BIGINT) AS \"at\", kind FROM z"


def _timed(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.unix_micros("at").alias("at"), "kind")


@query(_DONE + _AT, base=False)
def refresh_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as uploads that ended well: when the list is read again, at once and an hour after the last of a run."""
    done = A.table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("key"), "ts")
    return _timed(W.refreshes(done, 3600))


@query(_DONE + _AT + ", (SELECT date_trunc('milliseconds', max(ts) - INTERVAL 2 HOUR) AS clock FROM x) WHERE kind = 'now' OR due < clock", base=False)
def streamed_refreshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream: what is due before the watermark, two hours behind the last event, has been given out."""
    events = A.table(spark, sf_dir, "events")
    folder, _, name = events.inputFiles()[0].rpartition("/")  # a table is one file, or a folder of its own
    reader = spark.readStream.schema(events.schema)
    source = reader.parquet(folder) if folder.endswith("/events.parquet") else reader.option("pathGlobFilter", name).parquet(folder)
    done = source.where("event_type = 'purchase'").select(F.col("user_id").alias("key"), "ts")
    due = W.refreshes_stream(done, "2 hours", 3600)
    return _timed(W.run_to_table(due, store.shared_folder(spark, "due"), store.shared_folder(spark, "due-state")))


@query(
    "WITH x AS (SELECT CAST(user_id AS VARCHAR) AS key, ts, min(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) AS open FROM events WHERE event_type <> 'signup' GROUP BY 1, 2), y AS (SELECT *, lead(ts) OVER (PARTITION BY key ORDER BY ts) AS n FROM x), "
    "z AS (SELECT key, ts + INTERVAL 6 HOUR AS due, 'unanswered' AS kind FROM y WHERE open = 1 AND (n IS NULL OR n > ts + INTERVAL 6 HOUR)) " + _AT, base=False
)
def unanswered_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks as uploads begun and tried again, what ends them as the other events but sign-ups."""
    kind = F.when(F.col("event_type") == "view", "started").when(F.col("event_type") == "click", "retried").when(F.col("event_type") != "signup", "failed")
    return _timed(W.unanswered(A.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", kind.alias("kind")), 6 * 3600))


@query(
    "WITH x AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM x) "
    "SELECT user_id AS key, CAST(epoch_us(max(ts) + INTERVAL 30 MINUTE) AS BIGINT) AS \"at\", arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value FROM y GROUP BY user_id, run", base=False
)
def settled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each user once nothing more has come for half an hour."""
    rows = A.table(spark, sf_dir, "events").withColumnRenamed("user_id", "key")
    return W.settled(rows, ("event_type", "value"), 1800).select("key", F.unix_micros("at").alias("at"), "event_type", "value")
