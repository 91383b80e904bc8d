"""Writes of posted listings as the sources do them: cleaned and replaced, audited
and filled in, or from the bank. Each is a relation: the stored rows after the write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import city_accented, is_blank, name_case
from ..functions.urls import blocked_image, valid_source_url
from .first_wins import first_of_each
from .lifecycle import conflict_key
from .merge import last_posted
from .quality import audit

#: Never written over by a posted row. Fixed values.
KEPT = ["created_at", "dedup_key", "is_duplicate", "original_id", "auctioneer_id"]
#: What an audited row fills in. Fixed values.
FILLED = [
    "title", "description", "second_auction_value", "evaluation_value", "discount_percentage", "address", "city", "state", "category", "area_total", "latitude", "longitude", "second_auction_date", "image_url",
]


def cleaned(posted: DataFrame) -> DataFrame:
    """posted with no image where it is no photo, the seller's address where there
    is no usable one, and city and neighbourhood in their forms."""
    url = F.col("source_url")
    seller = F.col("auctioneer_url") if "auctioneer_url" in posted.columns else F.lit(None).cast("string")
    return posted.withColumns({
        "image_url": F.when(~blocked_image(F.col("image_url")) & (F.length("image_url") >= 20), F.trim("image_url")), "source_url": F.when(valid_source_url(url), F.trim(url)).otherwise(seller),
        "city": city_accented(F.col("city")), "neighborhood": F.when(F.length("neighborhood") > 0, name_case(F.col("neighborhood"))),
    })


def store(old: DataFrame, posted: DataFrame, as_of: str, order: str | None = None) -> DataFrame:
    """old after posted rows by id: each is cleaned and replaces what is stored, but
    for KEPT. The last posted of an id counts, if order says which."""
    new = cleaned(posted if order is None else last_posted(posted, "id", order))
    return _replaced(old, new, as_of, {})


def _replaced(old: DataFrame, new: DataFrame, as_of: str, always: dict[str, Column]) -> DataFrame:
    now = F.lit(as_of).cast("timestamp_ntz")
    o, n = old.withColumn("_there", F.lit(True)).alias("o"), new.withColumn("_there", F.lit(True)).alias("n")
    both = o.join(n, F.col("o.id") == F.col("n.id"), "full_outer")
    had, has = F.col("o._there").isNotNull(), F.col("n._there").isNotNull()
    out = []
    for c in old.columns:
        if c in always:
            value = F.when(has, always[c]).otherwise(F.col(f"o.{c}"))
        elif c in ("updated_at", "last_seen_at"):
            value = F.when(has, now).otherwise(F.col(f"o.{c}"))
        elif c == "created_at":
            value = F.when(had, F.col("o.created_at")).otherwise(now)
        elif c not in new.columns:
            value = F.col(f"o.{c}")
        elif c in KEPT:
            value = F.when(had, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
        else:
            value = F.when(has, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        out.append(value.alias(c))
    return both.select(*out)


def store_audited(old: DataFrame, posted: DataFrame, as_of: str, order: str, states: list[str] | None = None) -> DataFrame:
    """old after those posted rows that pass the audit. A row meets the stored ones
    of its id or its address and fills in what it has, later rows over earlier ones;
    one that meets none is added, unless an earlier one of the same id or address is."""
    now = F.lit(as_of).cast("timestamp_ntz")
    passed = (audit(posted, as_of) if states is None else audit(posted, as_of, states)).where("passed").select(*posted.columns)
    fields = [f for f in FILLED if f in posted.columns and f in old.columns]
    fresh = first_of_each(passed, order, ["id", "source_url"], existing=old)
    missing = [F.lit(None).cast(t).alias(c) for c, t in old.dtypes if c not in passed.columns]
    added = fresh.select(*(now.alias(c) if c in ("created_at", "updated_at") else F.col(c) for c in old.columns if c in passed.columns), *missing)
    rows = old.unionByName(added.select(*old.columns))

    def latest(key: str) -> DataFrame:
        each = [F.max(F.when(F.col(f).isNotNull(), F.struct(F.col(order).alias("at"), F.col(f).alias("v")))).alias(f) for f in fields]
        return passed.where(~is_blank(F.col(key))).groupBy(F.col(key).alias("_key")).agg(F.struct(*each).alias("_of"))

    for key in ("id", "source_url"):
        rows = rows.join(latest(key).select(F.col("_key").alias(f"_{key}"), F.col("_of").alias(f"_by_{key}")), F.col(key) == F.col(f"_{key}"), "left")
    met = F.col("_by_id").isNotNull() | F.col("_by_source_url").isNotNull()
    filled = {f: F.coalesce(F.greatest(F.col(f"_by_id.{f}"), F.col(f"_by_source_url.{f}"))["v"], F.col(f)) for f in fields}
    return rows.withColumns(filled | {"updated_at": F.when(met, now).otherwise(F.col("updated_at"))}).select(*old.columns)


def store_bank(old: DataFrame, posted: DataFrame, as_of: str, order: str | None = None) -> DataFrame:
    """old after the bank's rows by id: they replace what is stored, get a key from
    their address, and are active and no duplicates from then on. A row whose key,
    city and state another stored row of the bank has is passed over; other sellers'
    rows there become duplicates of it."""
    new = (posted if order is None else last_posted(posted, "id", order)).withColumn("dedup_key", conflict_key(F.col("address"), F.col("id")))
    place = ["dedup_key", "city", "state"]
    stored = old.where("source = 'caixa'").groupBy(*place).agg(F.min("id").alias("_low"), F.max("id").alias("_high"))
    new = new.join(stored, place, "left").where(F.col("_low").isNull() | ((F.col("_low") == F.col("id")) & (F.col("_high") == F.col("id")))).drop("_low", "_high")
    bank = new.groupBy(*place).agg(F.min("id").alias("_bank"))
    other = F.coalesce(F.col("source") != "caixa", F.lit(True)) & F.col("_bank").isNotNull() & (F.col("_bank") != F.col("id"))
    marked = old.join(bank, place, "left").withColumns({"is_duplicate": F.coalesce("is_duplicate", F.lit(False)) | other, "original_id": F.when(other, F.col("_bank")).otherwise(F.col("original_id"))}).select(*old.columns)
    return _replaced(marked, new, as_of, {"dedup_key": F.col("n.dedup_key"), "is_duplicate": F.lit(False), "is_active": F.lit(True), "auctioneer_id": F.col("n.auctioneer_id")})
