"""Scans of the document store's tables: owners' shards, details, categories, plans, tokens and settings.

A stored document is schemaless: a receipt's metadata and detail are JSON texts, read as VARIANT and normalised field by field.
Shards: (ord, id, _schema, owner_email, shard_index, receipt_metadata); details: (shard_doc_id, receipt_id, data). ``ord`` is the
order in which the store returned the shards; map entries keep their order in the JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

_NUMERIC = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def kind_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def member(document: Column, name: str) -> Column:
    return F.try_variant_get(document, f"$.{name}", "variant")


def text_of(document: Column, name: str) -> Column:
    """The field's text if it is a string, else null."""
    return F.when(kind_of(member(document, name)) == "STRING", F.try_variant_get(document, f"$.{name}", "string"))


def number_of(document: Column, name: str) -> Column:
    """The field's number if it is one or a string that reads as one, else null."""
    return F.when(kind_of(member(document, name)).rlike(_NUMERIC), S.finite(F.try_variant_get(document, f"$.{name}", "double"))).otherwise(S.number(text_of(document, name)))


def true_of(document: Column, name: str) -> Column:
    """Whether the field is the boolean true."""
    return F.coalesce((kind_of(member(document, name)) == "BOOLEAN") & F.try_variant_get(document, f"$.{name}", "boolean"), F.lit(False))


def objects_of(document: Column, name: str) -> Column:
    """The objects in an array field; empty if it isn't an array."""
    listed = F.try_variant_get(document, f"$.{name}", "array<variant>")
    return F.filter(F.coalesce(listed, F.array().cast("array<variant>")), lambda x: F.coalesce(kind_of(x).startswith("OBJECT"), F.lit(False)))


def items_of(document: Column) -> Column:
    """Line items: objects only; a name that isn't text is empty, a number that can't be read is 0."""
    return F.transform(
        objects_of(document, "items"),
        lambda x: F.struct(F.coalesce(text_of(x, "name"), F.lit("")).alias("name"), F.coalesce(number_of(x, "quantity"), F.lit(0.0)).alias("quantity"), F.coalesce(number_of(x, "price"), F.lit(0.0)).alias("price")),
    )


def fields_of(document: Column) -> Column:
    """Extracted fields: objects whose label and value are both text."""
    pairs = F.transform(objects_of(document, "extracted_fields"), lambda x: F.struct(text_of(x, "label").alias("label"), text_of(x, "value").alias("value")))
    return F.filter(pairs, lambda p: p["label"].isNotNull() & p["value"].isNotNull())


def owner_shards(shards: DataFrame, owner_email: str) -> DataFrame:
    """All documents of an owner; the address must agree exactly."""
    return shards.where(F.col("owner_email") == F.lit(owner_email))


def shard_entries(shards: DataFrame) -> DataFrame:
    """One row per receipt in the shards: shard_doc_id, receipt_id, ord (shard order, then place in the map), meta (JSON).

    Documents that aren't shards, blank ids and entries that aren't objects are left out."""
    entries = F.map_entries(F.from_json("receipt_metadata", "map<string,string>"))
    rows = shards.where(F.col("_schema") == "receipt_shard").select(F.col("id").alias("shard_doc_id"), F.col("ord").alias("shard_ord"), F.posexplode(entries).alias("pos", "entry"))
    rows = rows.where(~S.is_blank(F.col("entry.key")) & F.ltrim("entry.value").startswith("{"))
    return rows.select("shard_doc_id", F.col("entry.key").alias("receipt_id"), F.struct("shard_ord", "pos").alias("ord"), F.col("entry.value").alias("meta"))


def shard_pages(shards: DataFrame) -> DataFrame:
    """Shards with their page number from 1: largest shard_index first, a missing index counts as 0, ties in scan order."""
    index = F.coalesce(S.number(F.col("shard_index").cast("string")), F.lit(0.0))
    # one row per shard document of one owner: a bounded set
    return shards.where(F.col("_schema") == "receipt_shard").withColumn("page", F.row_number().over(Window.partitionBy("owner_email").orderBy(index.desc(), "ord")))


def owner_categories(documents: DataFrame, owner_email: str) -> DataFrame:
    """Category documents of an owner under the address as typed or in lower case, each id once (its last copy, first place)."""
    email = owner_email.strip()
    own = documents.where(F.col("owner_email").isin(*{email, email.lower()}))
    rank = F.when(F.col("owner_email") == email, 0).otherwise(1)
    found = own.groupBy("id").agg(F.max_by("categories", F.struct(rank, "ord")).alias("categories"), F.min(F.struct(rank.alias("rank"), F.col("ord"))).alias("place"))
    return found


def read_plans(documents: DataFrame) -> DataFrame:
    """The plan dimension with its defaults; only nulls are replaced."""
    default = {"name": F.lit(""), "features": F.array().cast("array<string>"), "interval": F.lit("month"), "payment_plan_id": F.lit(0).cast("long"), "price_cents": F.lit(0).cast("long")}
    return documents.select("id", *(F.coalesce(F.col(c), d).alias(c) for c, d in default.items()), F.col("monthly_limit"))


def token_payload(token: Column, schema: str) -> Column:
    """The payload of a web token as a struct, null if it can't be read. The signature isn't checked: not for authentication."""
    part = F.translate(F.get(F.split(token, r"\."), F.lit(1)), "-_", "+/")
    padded = F.rpad(part, F.ceil(F.char_length(part) / 4).cast("int") * 4, F.lit("="))
    return F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), schema)


def name_settings(stored: Column) -> Column:
    """First and last name from stored JSON; empty where it can't be read."""
    document = F.try_parse_json(stored)
    return F.struct(*(F.coalesce(text_of(document, n), F.lit("")).alias(n) for n in ("firstName", "lastName")))
