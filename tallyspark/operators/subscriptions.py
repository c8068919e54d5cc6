"""User plans: projection with field aliases, lookup with fallback, tiers, prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import documents as D

# The tiers of plans.
TIERS = {"free": 0, "plus": 1, "pro": 2}


def project_plan(data: Column) -> Column:
    """A user's plan as a struct from a stored document (VARIANT): name from plan_name, else plan_id, else free (first word)."""
    text, default = D.text_of, lambda c, v: F.coalesce(c, F.lit(v))
    name = S.first_word(F.coalesce(*(F.when(~S.is_blank(text(data, f)), text(data, f)) for f in ("plan_name", "plan_id")), F.lit("free")))
    flag = lambda f: F.when(D.kind_of(D.member(data, f)) == "BOOLEAN", F.try_variant_get(data, f"$.{f}", "boolean"))
    whole = lambda f: F.when(D.kind_of(D.member(data, f)).rlike(D._NUMERIC), F.try_variant_get(data, f"$.{f}", "long"))
    listed = F.coalesce(F.try_variant_get(data, "$.features", "array<variant>"), F.array().cast("array<variant>"))
    return F.struct(
        default(text(data, "owner_email"), "").alias("owner_email"), F.when(~S.is_blank(text(data, "plan_id")), text(data, "plan_id")).otherwise(name).alias("plan_id"), name.alias("plan_name"),
        default(text(data, "description"), "").alias("description"), default(text(data, "subscription_status"), "inactive").alias("subscription_status"), default(text(data, "plan_interval"), "month").alias("plan_interval"),
        whole("monthly_limit").alias("monthly_limit"), default(whole("plan_price_cents"), 0).alias("plan_price_cents"),
        F.transform(F.filter(listed, lambda x: F.coalesce(D.kind_of(x) == "STRING", F.lit(False))), lambda x: F.try_variant_get(x, "$", "string")).alias("features"),
        default(text(data, "plan_updated_at"), "").alias("plan_updated_at"), whole("last_transaction_id").alias("last_transaction_id"),
        F.coalesce(text(data, "customer_code"), text(data, "helcim_customer_code")).alias("customer_code"), F.coalesce(flag("payment_method_saved"), flag("payment_method_ready"), F.lit(False)).alias("payment_method_saved"),
    )


def user_plan(users: DataFrame, uid: str, email: str | None) -> DataFrame:
    """The plan of a user (users: uid, owner_email, data JSON): by uid, else by address (least uid), else the free one."""
    own = users.where(F.col("uid") == uid).select(F.lit(0).alias("rank"), "uid", "data")
    other = users.where(F.col("owner_email") == email).select(F.lit(1).alias("rank"), "uid", "data") if email else own.limit(0)
    none = users.sparkSession.createDataFrame([(2, "", email or "")], "rank int, uid string, email string").select("rank", "uid", F.to_json(F.struct(F.col("email").alias("owner_email"))).alias("data"))
    best = own.unionByName(other).unionByName(none).orderBy("rank", "uid").limit(1)
    return best.select(project_plan(F.try_parse_json("data")).alias("plan")).select("plan.*")


def tier(name: Column) -> Column:
    """The tier of a plan's name in any case; unknown names have the lowest."""
    out = F.lit(0)
    for word, value in TIERS.items():
        out = F.when(F.lower(name) == word, value).otherwise(out)
    return out


def visible_plans(plans: DataFrame, user_plan_name: str) -> DataFrame:
    """Plans of the user's tier and above; a plan's tier is that of the first word of its name."""
    return plans.where(tier(F.get(F.split("name", " "), F.lit(0))) >= TIERS.get(user_plan_name.lower(), 0))


def with_tier(users: DataFrame) -> DataFrame:
    return users.withColumn("tier", tier(F.col("plan_name")))


def price_text(price_cents: Column) -> Column:
    return S.money(price_cents)


def billing_period(period: Column) -> Column:
    return F.when(period == "monthly", "month").when(period == "yearly", "year").otherwise(period)
