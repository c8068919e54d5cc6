"""Prepaid purchases: cards by state, search, joins to sales receipts, cleanup counts. Card numbers and codes are never held.

Purchases: (id, owner_email, sales_receipt_id, activation_receipts array<struct<id,storage_path>>, cards array<struct<..>>,
created_at, ord). A card has id, activation_barcode, vanilla_serial, denomination, state, last4, pan_hash, image paths.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def search_digits(value: str) -> str:
    """The digits of a search; it must have 4 or 16."""
    found = "".join(c for c in value if c in "0123456789")
    if len(found) not in (4, 16):
        raise ValueError("enter exactly 4 or 16 digits")
    return found


def number_hash(digits: str, key: bytes) -> str:
    """The keyed hash that stands for a full card number."""
    return hmac.new(key, digits.encode(), hashlib.sha256).hexdigest()


def explode_cards(purchases: DataFrame) -> DataFrame:
    """One row per card with its purchase's columns; purchases without cards have none."""
    return purchases.select(F.col("id").alias("purchase_id"), "owner_email", "sales_receipt_id", "created_at", "ord", F.size("activation_receipts").alias("activation_receipt_count"), F.posexplode("cards").alias("pos", "card"))


def is_archived(card: Column) -> Column:
    return F.coalesce(card["state"] == "archived", F.lit(False))


def with_state(purchases: DataFrame, state: str) -> DataFrame:
    """Purchases reduced to their cards of a state (active, archived, all); those left without cards go, except for ``all``."""
    if state == "all":
        return purchases
    wanted = is_archived if state == "archived" else lambda c: ~is_archived(c)
    return purchases.withColumn("cards", F.filter("cards", wanted)).where(F.size("cards") > 0)


def card_counts(purchases: DataFrame) -> DataFrame:
    """(id, active_card_count, archived_card_count, activation_receipt_count)."""
    archived = F.size(F.filter("cards", is_archived))
    return purchases.select("id", (F.size("cards") - archived).alias("active_card_count"), archived.alias("archived_card_count"), F.size("activation_receipts").alias("activation_receipt_count"))


def search_cards(purchases: DataFrame, value: str, key: bytes = b"") -> DataFrame:
    """Cards whose last four digits, or whole number (by its keyed hash), are searched for."""
    digits = search_digits(value)
    cards = explode_cards(purchases)
    found = cards.where(F.col("card.last4") == digits) if len(digits) == 4 else cards.where(F.col("card.pan_hash") == number_hash(digits, key))
    return found.select("purchase_id", F.col("card.id").alias("card_id"), "sales_receipt_id", F.col("card.last4").alias("last4"), F.col("card.denomination").alias("denomination"), F.col("card.state").alias("state"), "activation_receipt_count")


def open_results(results: DataFrame, *lists: DataFrame) -> DataFrame:
    """Each result with its purchase and card, and ``source``, the number of the first list that has it: of the active, the archived,
    and all purchases. One table of all purchases can stand for the three: there a card's state tells the list. Of cards with
    the same id in a purchase the first counts."""
    cards = None
    for rank, purchases in enumerate(lists):
        one = purchases.select(F.col("id").alias("purchase_id"), F.posexplode("cards").alias("pos", "card"))
        one = one.withColumn("source", F.lit(rank) if len(lists) > 1 else F.when(is_archived(F.col("card")), 1).otherwise(0))
        cards = one if cards is None else cards.unionByName(one)
    keys = ["purchase_id", "card_id"]
    wanted = cards.withColumn("card_id", F.col("card.id")).join(results.select(*keys), keys, "left_semi")
    rank = F.struct("source", "pos")
    return results.join(wanted.groupBy(*keys).agg(F.min_by("card", rank).alias("card"), F.min("source").alias("source")), keys)


def card_detail(purchases: DataFrame, purchase_id: str, card_id: str) -> DataFrame:
    """One card; a missing one is an error when the result is read."""
    found = explode_cards(purchases).where((F.col("purchase_id") == purchase_id) & (F.col("card.id") == card_id))
    one = found.agg(F.first("card").alias("card"), F.count(F.lit(1)).alias("n"))
    return one.where(F.when(F.col("n") > 0, True).otherwise(F.raise_error(F.lit("card details are unavailable")).cast("boolean"))).select("card")


def with_sales_receipts(purchases: DataFrame, receipts: DataFrame) -> DataFrame:
    """Purchases with their sales receipt's vendor ("Retailer" if unknown) and date (else that of the purchase)."""
    known = receipts.select(F.col("id").alias("sales_receipt_id"), F.col("vendor").alias("_vendor"), F.col("purchase_date").alias("_date"), F.lit(True).alias("_found"))
    rows = purchases.join(known, "sales_receipt_id", "left")
    vendor = F.when(F.coalesce("_vendor", F.lit("")) != "", F.col("_vendor")).otherwise("Retailer")
    date = F.when(F.coalesce("_date", F.lit("")) != "", F.col("_date")).otherwise(F.coalesce("created_at", F.lit("")))
    return rows.withColumns({"retailer": vendor, "shown_date": date}).drop("_vendor", "_date", "_found")


def results_with_receipts(results: DataFrame, receipts: DataFrame) -> DataFrame:
    """Search results with their retailer ("Retailer unavailable" if unknown)."""
    known = receipts.select(F.col("id").alias("sales_receipt_id"), F.col("vendor").alias("_vendor"))
    shown = F.when(F.coalesce("_vendor", F.lit("")) != "", F.col("_vendor")).otherwise("Retailer unavailable")
    return results.join(known, "sales_receipt_id", "left").withColumn("retailer", shown).drop("_vendor")


def upsert_purchase(purchases: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed purchases in the place of the old ones, new ones in front: one after the other in the order of their own ``ord``, so the
    last of them comes first. Of several changes of a purchase the last counts; purchases left without cards go."""
    columns = [c for c in purchases.columns if c != "id"]
    last = changed.groupBy("id").agg(F.max_by(F.struct(*columns), "ord").alias("_new"))
    base = F.coalesce(purchases.agg(F.min("ord")).scalar(), F.lit(0))
    since = F.col("_new.ord") - changed.agg(F.min("ord")).scalar()
    both = purchases.select("id", F.struct(*columns).alias("_old")).join(last, "id", "full_outer")
    place = F.when(F.col("_old").isNull(), base - 1 - since).otherwise(F.col("_old.ord"))
    values = {c: place if c == "ord" else F.when(F.col("_new").isNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}")) for c in columns}
    return both.select(*(values[c].alias(c) if c in values else F.col(c) for c in purchases.columns)).where(F.size("cards") > 0)


def cleanup_counts(purchases: DataFrame) -> DataFrame:
    """What a cleanup deletes: package and opened-card images of archived cards, and the activation images of purchases all
    of whose cards are archived. Sales receipts are kept."""
    archived = F.filter("cards", is_archived)
    has = lambda c, f: F.coalesce(c[f] != "", F.lit(False))
    all_ = (F.size("cards") > 0) & F.forall("cards", is_archived)
    rows = purchases.select(
        F.size(F.filter(archived, lambda c: has(c, "package_image_storage_path"))).alias("p"), F.size(F.filter(archived, lambda c: has(c, "opened_card_image_storage_path"))).alias("o"),
        F.when(all_, F.size(F.filter("activation_receipts", lambda a: has(a, "storage_path")))).otherwise(0).alias("a"), F.when(F.size(archived) > 0, F.col("sales_receipt_id")).alias("s"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(total("p").alias("package_images_deleted"), total("o").alias("opened_card_images_deleted"), total("a").alias("activation_receipt_images_deleted"), F.count_distinct("s").alias("sales_receipts_preserved"))


def after_cleanup(purchases: DataFrame) -> DataFrame:
    """Purchases without the image paths that a cleanup deletes."""
    all_ = (F.size("cards") > 0) & F.forall("cards", is_archived)
    cleaned = F.transform("cards", lambda c: F.when(is_archived(c), c.withField("package_image_storage_path", F.lit(None).cast("string")).withField("opened_card_image_storage_path", F.lit(None).cast("string"))).otherwise(c))
    return purchases.withColumns({"cards": cleaned, "activation_receipts": F.when(all_, F.slice("activation_receipts", 1, 0)).otherwise(F.col("activation_receipts"))})


def activation_ordinals(purchases: DataFrame) -> DataFrame:
    """Activation receipts with their number from 1 in the whole list."""
    return purchases.select(F.col("id").alias("purchase_id"), F.posexplode("activation_receipts").alias("pos", "receipt")).select("purchase_id", F.col("receipt.id").alias("receipt_id"), (F.col("pos") + 1).alias("ordinal"))


def card_rows(purchases: DataFrame) -> DataFrame:
    """What the list shows of a card: masked number, short barcode, denomination (0 if unknown), names of its images."""
    cards = explode_cards(purchases)
    digits = S.digits(F.coalesce("card.last4", F.lit("")))
    plain = F.substring(F.regexp_replace(F.coalesce("card.id", F.lit("card")), "[^a-zA-Z0-9_-]", ""), 1, 24)
    identity = F.when(digits != "", F.right(digits, F.lit(4))).when(plain != "", plain).otherwise("card")
    return cards.select("purchase_id", F.col("card.id").alias("card_id"), F.concat(F.lit("•••• "), F.coalesce("card.last4", F.lit(""))).alias("masked"), S.short_tail(F.coalesce("card.activation_barcode", F.lit(""))).alias("barcode"), F.coalesce("card.denomination", F.lit(0.0)).alias("denomination"), *(F.concat(F.lit(f"{kind}-card-"), identity, F.lit(".jpg")).alias(f"{kind}_image_name") for kind in ("package", "opened")))


_DRAFT_FIELDS = ("storage_path", "activation_barcode", "vanilla_serial", "denomination")


def _filled(draft: Column) -> Column:
    out = F.lit(False)
    for f in _DRAFT_FIELDS:
        out = out | (F.coalesce(draft[f], F.lit("")) != "")
    return out


def drafts_valid(drafts: Column) -> Column:
    """Whether some draft has an image and each one that isn't empty has 30 barcode digits, 11 serial digits and an amount."""
    whole = lambda d: (F.char_length(S.digits(F.coalesce(d["activation_barcode"], F.lit("")))) == 30) & (F.char_length(S.digits(F.coalesce(d["vanilla_serial"], F.lit("")))) == 11) & S.optional_money(d["denomination"]).isNotNull()
    return F.exists(drafts, lambda d: F.coalesce(d["storage_path"], F.lit("")) != "") & F.forall(drafts, lambda d: ~_filled(d) | whole(d))


def draft_cards(drafts: Column) -> Column:
    """The cards of drafts that aren't empty: digits only, optional amount, confirmed."""
    card = lambda d: F.struct(S.digits(F.coalesce(d["activation_barcode"], F.lit(""))).alias("activation_barcode"), S.digits(F.coalesce(d["vanilla_serial"], F.lit(""))).alias("vanilla_serial"), S.optional_money(d["denomination"]).alias("denomination"), d["storage_path"].alias("package_image_storage_path"), F.lit(True).alias("confirmed"))
    return F.transform(F.filter(drafts, _filled), card)


def overlay_extraction(drafts: DataFrame, extracted: DataFrame) -> DataFrame:
    """Drafts with extracted values over their own, where the extraction has any."""
    new = extracted.select("id", *(F.col(c).alias(f"_{c}") for c in ("activation_barcode", "serial_number", "denomination")))
    rows = drafts.join(new, "id", "left")
    text = lambda n, c: F.when(F.coalesce(F.col(n), F.lit("")) != "", F.col(n)).otherwise(F.col(c))
    return rows.withColumns({"activation_barcode": text("_activation_barcode", "activation_barcode"), "vanilla_serial": text("_serial_number", "vanilla_serial"), "denomination": F.when(F.col("_denomination").isNotNull(), S.plain_number(F.col("_denomination"))).otherwise(F.col("denomination"))}).select(*drafts.columns)
