"""What writers do to listings: row rules, repairs with counts, conflicts between
sources, geocoding states, and subscriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.categories import plain_category, title_category
from ..functions.money import valid_discount
from ..functions.places import state_code
from ..functions.text import city_name, is_blank
from ..functions.urls import blocked_image

#: Parts of addresses that are notices, not places. Fixed values.
NOTICES = ["entre em contato", "whatsapp", "www.", "grupolance", "mais informações", ".com.br", "dentre outras"]
#: Parts of image addresses that a row rule blanks. Fixed values.
IMAGE_PARTS = ["connect.facebook.net", "facebook.com", "bank_icons", "logo", "placeholder", "no-image", "sem-foto"]
BANK_PAGE = "https://venda-imoveis.caixa.gov.br/sistema/detalhe-imovel.asp?hdnimovel="


def as_stored(rows: DataFrame, as_of: str) -> DataFrame:
    """What every writer does to a row: capitals in places, no images of other
    things, an address for the bank's own rows, and the time."""
    image = F.lower("image_url")
    bad = F.length("image_url") < 20
    for part in IMAGE_PARTS:
        bad = bad | F.contains(image, F.lit(part))
    return rows.withColumns({
        "city": F.initcap("city"), "neighborhood": F.initcap("neighborhood"), "image_url": F.when(~bad, F.col("image_url")),
        "source_url": F.when(F.startswith("id", F.lit("caixa-")) & (F.coalesce("source_url", F.lit("")) == ""), F.concat(F.lit(BANK_PAGE), F.replace("id", F.lit("caixa-"), F.lit("")))).otherwise(F.col("source_url")),
        "updated_at": F.lit(as_of).cast("timestamp_ntz"),
    })


def image_rule(rows: DataFrame) -> DataFrame:
    """The stricter image rule alone, by all blocked kinds."""
    return rows.withColumn("image_url", F.when(~blocked_image(F.col("image_url")) & (F.length("image_url") >= 20), F.col("image_url")))


def conflict_key(address: Column, id: Column) -> Column:
    """The address without marks, else the id."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(address, F.lit(""))), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))
    return F.coalesce(F.nullif(plain, F.lit("")), id)


def bank_first(rows: DataFrame, order: str = "id") -> DataFrame:
    """Of the listings at one key, city and state the bank's first row stays, and
    all others name it as their original. Keys without a row of the bank are left
    alone. The bank's first row of a key is an aggregate, so a hot key combines
    before the shuffle."""
    keys = ["key", "city", "state"]
    best = rows.where("source = 'caixa'").groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min(order).alias("_bank"))
    out = rows.join(best, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*(f"_{k}" for k in keys))
    loses = F.col("_bank").isNotNull() & (F.col("_bank") != F.col(order))
    return out.withColumns({"is_duplicate": F.coalesce("is_duplicate", F.lit(False)) | loses, "original_id": F.when(loses, F.col("_bank"))}).drop("_bank")


def reclassified(rows: DataFrame) -> DataFrame:
    """Categories that the title contradicts, of rows that are no duplicates; changed says where."""
    said = title_category(F.col("title"))
    change = ~F.coalesce("is_duplicate", F.lit(False)) & said.isNotNull() & ~said.eqNullSafe(F.col("category"))
    return rows.withColumns({"category": F.when(change, said).otherwise(F.col("category")), "changed": change})


def repaired(rows: DataFrame) -> DataFrame:
    """State, category and city in their normal forms."""
    return rows.withColumns({"state": state_code(F.col("state")), "category": plain_category(F.col("category")), "city": city_name(F.col("city"))})


def migrated(rows: DataFrame) -> DataFrame:
    """repaired, with discounts out of range blanked, and the names of the fields that changed."""
    fields = ["state", "category", "city", "discount_percentage"]
    old = rows.select("*", F.struct(*fields).alias("_old"))
    new = repaired(old).withColumn("discount_percentage", valid_discount(F.col("discount_percentage")))
    return new.withColumn("changed", F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"_old.{f}")), f) for f in fields)))).drop("_old")


def change_counts(migrated_rows: DataFrame) -> DataFrame:
    """How many rows changed in each field: (field, n)."""
    return migrated_rows.select(F.explode("changed").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def geocode_backfill(rows: DataFrame) -> DataFrame:
    """Statuses before any attempt: notices are invalid; of pending rows those with
    coordinates are done and those without address and city skipped."""
    notice = F.lit(False)
    for part in NOTICES:
        notice = notice | F.contains(F.lower("address"), F.lit(part))
    waits = F.col("geocoding_status") == "pending"
    status = (
        F.when(F.coalesce(notice, F.lit(False)), "invalid_address").when(waits & F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), "done")
        .when(waits & is_blank(F.col("address")) & is_blank(F.col("city")), "skipped").otherwise(F.col("geocoding_status"))
    )
    return rows.withColumn("geocoding_status", status)


def named(listings: DataFrame, auctioneers: DataFrame) -> DataFrame:
    """Missing auctioneer names from the dimension, else from the id in words."""
    names = auctioneers.where(~is_blank(F.col("name"))).groupBy(F.col("id").alias("_id")).agg(F.min("name").alias("_name"))
    out = listings.join(names, F.col("auctioneer_id") == F.col("_id"), "left")
    words = F.initcap(F.translate(F.col("auctioneer_id").cast("string"), "_-", "  "))
    return out.withColumn("auctioneer_name", F.when(is_blank(F.col("auctioneer_name")), F.coalesce("_name", words)).otherwise(F.col("auctioneer_name"))).drop("_id", "_name")


def without_ids(rows: DataFrame, gone: DataFrame, id: str = "id") -> DataFrame:
    return rows.join(gone.select(id).distinct(), id, "left_anti")


def point(rows: DataFrame, id: object, key: str = "id") -> DataFrame:
    """The row of one id."""
    return rows.where(F.col(key) == id)


def subscriptions(users: DataFrame, events: DataFrame) -> DataFrame:
    """users (id, status, plan, ends) after payment events (user, event, value, at):
    the newest that says anything decides. A payment of more than 500 is for a year."""
    says = F.when(F.col("event").isin("PAYMENT_CONFIRMED", "PAYMENT_RECEIVED"), "active").when(F.col("event") == "PAYMENT_OVERDUE", "overdue").when(F.col("event").isin("SUBSCRIPTION_DELETED", "SUBSCRIPTION_INACTIVATED"), "cancelled")
    known = events.withColumn("says", says).where("says is not null and user is not null")
    last = known.groupBy("user").agg(F.max(F.struct("at", "says", "value")).alias("e")).select("user", "e.*")
    yearly = F.col("value") > 500
    out = users.join(last, F.col("id") == F.col("user"), "left")
    paid = F.col("says") == "active"
    return out.select(
        "id", F.coalesce("says", "status").alias("status"), F.when(paid, F.when(yearly, "yearly").otherwise("monthly")).otherwise(F.col("plan")).alias("plan"),
        F.when(paid, F.col("at") + F.make_dt_interval(F.when(yearly, 365).otherwise(30))).otherwise(F.col("ends")).alias("ends"),
    )


def with_source(parts: dict[str, DataFrame]) -> DataFrame:
    """Results of several sources as one relation; columns that one lacks are null there."""
    out = None
    for name, df in parts.items():
        one = df.withColumn("from_source", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
