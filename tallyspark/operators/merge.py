"""Changes to tables: upserts, removals, edits of receipts and of category maps."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import store
from .receipts import MIRRORED


def upsert_receipts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows first in their order, over the existing ones of their ids; then the rest. ``rank`` gives the new order.

    Both have (id, ord, ..). Incoming values win; a local image of the existing row stays; a merged row is a success without
    an error text. Of existing rows that repeat an id the first one's image counts."""
    names = incoming.columns
    image = [F.min_by("local_image_url", "ord").alias("_image")] if "local_image_url" in existing.columns else []
    merged = incoming.join(existing.groupBy("id").agg(F.min(F.lit(True)).alias("_old"), *image), "id", "left")
    if "local_image_url" in names and "local_image_url" in existing.columns:
        merged = merged.withColumn("local_image_url", F.coalesce(F.when(F.col("_image") != "", F.col("_image")), F.col("local_image_url")))
    for name, value in (("status", F.lit("success")), ("error_message", F.lit(None).cast("string"))):
        if name in names:
            merged = merged.withColumn(name, F.when(F.col("_old"), value).otherwise(F.col(name)))
    rest = existing.join(incoming.select("id").distinct(), "id", "left_anti")
    rank = lambda part: F.struct(F.lit(part).alias("part"), F.col("ord").alias("ord"))
    return merged.select(*names, rank(0).alias("rank")).unionByName(rest.select(*rest.columns, rank(1).alias("rank")), allowMissingColumns=True)


def keep_unsaved(existing: DataFrame) -> DataFrame:
    """What stays in the list when the store turns out to be empty."""
    return existing.where(F.col("status") != "success")


def remove_by_id(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id").distinct(), "id", "left_anti")


def update_by_id(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows with the columns of ``changes`` (id, ..) replaced where an id is there, the last change (by ``ord``) winning."""
    columns = [c for c in changes.columns if c not in ("id", "ord")]
    last = changes.groupBy("id").agg(*(F.max_by(c, "ord").alias(f"_{c}") for c in columns), F.lit(True).alias("_hit"))
    joined = rows.join(last, "id", "left")
    return joined.select(*(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def edit_value(field: str, value: str) -> dict[str, Column]:
    """What an edit of a field writes; raises for a number that doesn't start a text, or an impossible date."""
    if field in ("vendor", "invoice_id"):
        return {field: F.lit(value.strip())}
    if field == "category":
        return {field: F.lit(value)}
    if field in ("total", "subtotal", "tax"):
        found = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", value)
        if not found:
            raise ValueError(f"invalid {field}")
        return {field: F.lit(float(found[1]))}
    if field == "purchase_date":
        day = S.read_date(value)
        if value.strip() and day is None:
            raise ValueError("invalid purchase date")
        return {field: F.lit(f"{day:%Y-%m-%d}" if day else "")}
    raise ValueError(f"{field} can't be edited")


def mirrored(columns: Sequence[str]) -> list[str]:
    """The fields of an edit that are written to the metadata as well."""
    return [c for c in columns if c in MIRRORED]


def _merged(document: Column, fields: Column) -> Column:
    """A JSON object's text with fields (map of VARIANT) set; a text that isn't an object's counts as an empty one."""
    own = F.coalesce(F.from_json(document, "map<string,variant>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))
    return F.to_json(F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(fields, k)), fields))


def write_edits(shards: DataFrame, details: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after edits (shard_doc_id, receipt_id, ord, field, value JSON): shards and details.

    A detail takes all fields that its edits set, by the last edit of each (by ``ord``); a detail that isn't there is made. The
    receipt's metadata in its shard takes the mirrored ones among them; metadata that isn't there, or is no object, stays as it
    is. Other documents and other fields of the same document keep their values. Both results come from one reading of the
    edits; they are written by the caller."""
    last = edits.groupBy("shard_doc_id", "receipt_id", "field").agg(F.max_by("value", "ord").alias("value")).withColumn("value", F.try_parse_json("value"))
    fields = lambda rows: F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields")
    keys = ["shard_doc_id", "receipt_id"]
    joined = details.join(last.groupBy(*keys).agg(fields(last)), keys, "full_outer")
    data = F.when(F.col("fields").isNotNull(), _merged(F.coalesce("data", F.lit("{}")), F.col("fields"))).otherwise(F.col("data"))
    written = joined.select(*(data.alias("data") if c == "data" else F.col(c) for c in details.columns))
    mirrored_ = last.where(F.col("field").isin(*MIRRORED))
    by_shard = mirrored_.groupBy(*keys).agg(fields(mirrored_)).groupBy("shard_doc_id").agg(F.map_from_entries(F.collect_list(F.struct("receipt_id", F.to_json("fields").alias("fields")))).alias("_edits"))

    def entry(key: Column, value: Column) -> Column:
        edit = F.try_element_at("_edits", key)
        merged = S.let(F.from_json(edit, "map<string,variant>"), lambda new: _merged(value, new))  # read once, not for each field
        return F.when(edit.isNotNull() & F.ltrim(value).startswith("{"), merged).otherwise(value)

    def one(e: Column) -> Column:
        quoted = S.let(F.to_json(F.array(e["key"])), lambda j: j.substr(F.lit(2), F.char_length(j) - 2))
        return F.concat(quoted, F.lit(":"), S.let(F.coalesce(F.to_json(e["value"]), F.lit("null")), lambda value: entry(e["key"], value)))

    def text(own: Column) -> Column:
        return F.when(own.isNotNull(), F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(own), one), ","), F.lit("}"))).otherwise(F.col("receipt_metadata"))

    mirror = F.when(F.col("_edits").isNotNull(), S.let(F.from_json("receipt_metadata", "map<string,variant>"), text)).otherwise(F.col("receipt_metadata"))
    both = shards.join(by_shard.withColumnRenamed("shard_doc_id", "id"), "id", "left")
    return both.select(*(mirror.alias("receipt_metadata") if c == "receipt_metadata" else F.col(c) for c in shards.columns)), written


def store_edits(shards: str, details: str, edits: DataFrame, parts: int, batch: int | None = None) -> tuple[list[int], list[int]]:
    """``write_edits`` on tables that ``store.write_table`` has laid out: shards by id, details by shard_doc_id, in the same number of parts.

    Both tables get the edits of the parts that these touch, from the same reading; all other files stay. Returns the parts of each table. A batch that runs
    again, also after it reached one of both tables only, gives the same tables."""
    spark = edits.sparkSession
    edits = edits.persist()
    try:
        empty = lambda path: store.read_table(spark, path).limit(0)
        own = edits.select("shard_doc_id")
        written = store.change_parts(spark, details, ["shard_doc_id"], parts, own, lambda rows: write_edits(empty(shards), rows, edits)[1], batch)
        mirrors = edits.where(F.col("field").isin(*MIRRORED)).select(F.col("shard_doc_id").alias("id"))
        mirrored_ = store.change_parts(spark, shards, ["id"], parts, mirrors, lambda rows: write_edits(rows, empty(details), edits)[0], batch)
        return mirrored_, written
    finally:
        edits.unpersist()


def store_upserts(path: str, incoming: DataFrame, parts: int, batch: int) -> list[int]:
    """``upsert_receipts`` on a table of receipts that is laid out by id and has ``batch``, the number of the batch that a row came with: the list's order
    is the latest batch first, then ``ord``. Of incoming rows that repeat an id the first by ``ord`` stays, as a table holds an id once."""
    one = incoming.groupBy("id").agg(F.min_by(F.struct(*[c for c in incoming.columns if c != "id"]), "ord").alias("_row")).select("id", "_row.*").persist()
    try:

        def change(rows: DataFrame) -> DataFrame:
            merged = upsert_receipts(rows, one)
            return merged.withColumn("batch", F.when(F.col("rank.part") == 0, F.lit(batch)).otherwise(F.col("batch"))).drop("rank")

        return store.change_parts(incoming.sparkSession, path, ["id"], parts, one.select("id"), change, batch)
    finally:
        one.unpersist()


def store_names(path: str, changes: DataFrame, prefix: str, parts: int, batch: int | None = None) -> list[int]:
    """Writes name settings: of changes (identity, ord, first_name, last_name) the last one of each identity, as JSON under its key, into a table (key, value) laid
    out by key. Null names are written as empty ones; rows without an identity are left out. Other settings stay as they are."""
    key = S.storage_key_of(prefix, F.col("identity"))
    text = F.to_json(F.struct(F.coalesce("first_name", F.lit("")).alias("firstName"), F.coalesce("last_name", F.lit("")).alias("lastName")))
    new = changes.where("identity is not null").groupBy(key.alias("key")).agg(F.max_by(text, "ord").alias("value")).persist()
    try:
        return store.change_parts(changes.sparkSession, path, ["key"], parts, new.select("key"), lambda rows: rows.join(new.select("key"), "key", "left_anti").select("key", "value").unionByName(new), batch)
    finally:
        new.unpersist()


def replace_images(receipts: DataFrame, changes: DataFrame) -> DataFrame:
    """Receipts with the last image (by ``ord``) of changes (id, ord, storage_path, image_grayscale); a null gray flag leaves the
    receipt's as it is, false is written."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("storage_path", "image_grayscale"), "ord").alias("_new"))
    values = {"image_url": F.when(F.col("_new").isNotNull(), F.col("_new.storage_path")).otherwise(F.col("image_url")), "image_grayscale": F.coalesce("_new.image_grayscale", "image_grayscale")}
    return receipts.join(last, "id", "left").select(*(values[c].alias(c) if c in values else F.col(c) for c in receipts.columns))


def replace_item(items: Column, index: int, name: str, quantity: float, price: float) -> Column:
    """Items with one replaced; a name, and numbers, are required."""
    if not name.strip():
        raise ValueError("an item needs a name")
    new = F.struct(F.lit(name.strip()).alias("name"), F.lit(float(quantity)).alias("quantity"), F.lit(float(price)).alias("price"))
    return F.transform(items, lambda x, i: F.when(i == index, new).otherwise(x))


def remove_item(items: Column, index: int) -> Column:
    return F.filter(items, lambda x, i: i != index)


def add_item(items: Column) -> Column:
    """Items with a new one at the end."""
    new = F.struct(F.lit("New item").alias("name"), F.lit(1.0).alias("quantity"), F.lit(0.0).alias("price"))
    return F.array_append(F.coalesce(items, F.array().cast("array<struct<name:string,quantity:double,price:double>>")), new)


def flatten_categories(documents: DataFrame) -> DataFrame:
    """(name, description) of category documents (place, categories map): names trimmed, blanks out; of equal names the last
    description, at the first one's place; sorted as a reader would."""
    rows = documents.where("categories is not null").select("place", F.posexplode(F.map_entries("categories")).alias("pos", "e"))
    rows = rows.select(S.trimmed(F.col("e.key")).alias("name"), F.coalesce("e.value", F.lit("")).alias("description"), F.struct("place", "pos").alias("at")).where(F.col("name") != "")
    return rows.groupBy("name").agg(F.max_by("description", "at").alias("description"), F.min("at").alias("at")).orderBy(F.collate("name", "UNICODE")).select("name", "description")


def put_category(categories: Column, name: str, description: str = "", old_name: str | None = None) -> Column:
    """A category map with an entry set (and another one, its old name, gone). A blank description is null, a name is required."""
    name, text = name.strip(), description.strip()
    if not name:
        raise ValueError("a category needs a name")
    gone = [name] + ([old_name] if old_name is not None else [])
    kept = F.map_filter(categories, lambda k, v: ~k.isin(*gone))
    return F.map_concat(kept, F.create_map(F.lit(name), F.lit(text or None).cast("string")))


def drop_category(categories: Column, name: str) -> Column:
    return F.map_filter(categories, lambda k, v: k != name)
