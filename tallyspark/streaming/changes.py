"""Change streams: the last change of each receipt, and upserts of micro-batches into a table.

The store behind the receipts offers no stream; these wrap the batch operators for sources that do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merge
from ..operators import receipts as R
from ..sources import documents as D


def latest_by_key(events: DataFrame, key: str = "user_id", *order: str) -> DataFrame:
    """The last event of each key by ``order`` (ts, event_id unless given)."""
    by = F.struct(*(order or ("ts", "event_id")))
    columns = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), by).alias("last")).select(key, "last.*")


def apply_category_changes(receipts: DataFrame, changes: DataFrame) -> DataFrame:
    """Receipts with the last category that the changes (receipt_id, category, ts) give them."""
    return merge.update_by_id(receipts, changes.select(F.col("receipt_id").alias("id"), "category", F.col("ts").alias("ord")))


def refresh_latest(existing: DataFrame, shards: DataFrame) -> tuple[DataFrame, int]:
    """The list after a new look at an owner's shards, and the number of pages it has read: the newest shard's receipts are merged into it,
    and paging goes on from there. Without any shard only rows that aren't saved stay, and no page is read."""
    newest = D.shard_pages(shards).where("page = 1").drop("page")
    if newest.isEmpty():
        return merge.keep_unsaved(existing), 0
    return merge.upsert_receipts(existing, R.expand_shards(newest)), 1


def upsert_stream(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], checkpoint: str):
    """Starts a query that upserts every micro-batch of receipts into a table and stops when the source is drained.

    ``read`` returns the table, ``write`` replaces it (the table's format decides whether that is atomic). A batch that runs
    again gives the same table: an upsert of rows that are there changes nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        merged = merge.upsert_receipts(read(), rows)
        write(merged.drop("rank"))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_parts(stream: DataFrame, path: str, parts: int, checkpoint: str, interval: str | None = None):
    """Starts a query that upserts every micro-batch of receipts into a stored table (``merge.store_upserts``), rewriting only the parts that it touches.

    A micro-batch that the stream runs again after a failure is recognised by its number. Without an ``interval`` the query stops when the
    source is drained."""

    def batch(rows: DataFrame, number: int) -> None:
        merge.store_upserts(path, rows, parts, number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def windowed_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of each type by time window, with a watermark for late ones: works on streams and on tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
