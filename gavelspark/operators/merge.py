"""Snapshot merges and lifecycle. A merge is one full join by key; what each
column does is data: replace, coalesce (new if not null), track (coalesce, and
keep the old value beside), or keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import discount
from ..functions.urls import blocked_image, normalize_url, valid_source_url
from ..functions.text import is_blank


def merge(old: DataFrame, new: DataFrame, key: str, rules: dict[str, str], protect: Column | None = None, order: str | None = None) -> DataFrame:
    """old after new: key, the ruled columns, action (inserted, updated,
    unchanged, protected or kept). protect: a condition on o.* and n.* under which
    an old row stays as it is. order: where new may have several rows of one key,
    the column by which the last of them wins; else new has one row a key. A null
    key matches nothing: such old rows are kept, such new ones inserted."""
    o = old.withColumn("_there", F.lit(True)).alias("o")
    n = (new if order is None else last_posted(new, key, order)).withColumn("_there", F.lit(True)).alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    has_old, has_new = F.col("o._there").isNotNull(), F.col("n._there").isNotNull()
    write = has_new & (~F.coalesce(protect, F.lit(False)) if protect is not None else F.lit(True))
    columns, changed = [F.coalesce(f"o.{key}", f"n.{key}").alias(key)], F.lit(False)
    for c, rule in rules.items():
        before, after = F.col(f"o.{c}"), F.col(f"n.{c}")
        merged = {"replace": after, "coalesce": F.coalesce(after, before), "track": F.coalesce(after, before), "keep": F.when(has_old, before).otherwise(after)}[rule]
        value = F.when(write, merged).otherwise(before)
        columns.append(value.alias(c))
        differs = has_old & ~value.eqNullSafe(before)
        if rule == "track":
            columns.append(F.when(differs, before).alias(f"previous_{c}"))
        changed = changed | differs
    action = F.when(~has_old, "inserted").when(~has_new, "kept").when(~write, "protected").when(changed, "updated").otherwise("unchanged")
    return both.select(*columns, action.alias("action"))


def last_posted(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of a key the last by `order`; rows without a key stay, each."""
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_r"))
    return last.select("_r.*").unionByName(rows.where(F.col(key).isNull()))


def tracked(old: DataFrame, new: DataFrame, key: str, values: list[str], as_of: str, order: str | None = None) -> DataFrame:
    """old after new by value: a value that is there, not 0 and different replaces
    the old one, which stays beside it with the time; a row that is met again is
    active. Rows of new alone are not added. order: as in merge."""
    n = (new if order is None else last_posted(new, key, order)).where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *(F.col(v).alias(f"_{v}") for v in values))
    out = old.join(n, F.col(key) == F.col("_key"), "left")
    change = {v: F.coalesce((F.col(f"_{v}") != 0) & ~F.col(f"_{v}").eqNullSafe(F.col(v)), F.lit(False)) for v in values}
    any_change = F.lit(False)
    for c in change.values():
        any_change = any_change | c
    columns = {f"previous_{v}": F.when(change[v], F.col(v)) for v in values}
    out = out.withColumns(columns | {"value_changed_at": F.when(any_change, F.lit(as_of).cast("timestamp_ntz")), "_change": F.array(*change.values())})
    new_values = {v: F.when(F.get("_change", F.lit(i)), F.col(f"_{v}")).otherwise(F.col(v)) for i, v in enumerate(values)}
    return out.withColumns(new_values | {"is_active": F.col("is_active") | F.col("_key").isNotNull()}).drop("_key", "_change", *(f"_{v}" for v in values))


def imported(old: DataFrame, new: DataFrame, rules: dict[str, str], protect: Column | None = None, order: str | None = None) -> DataFrame:
    """merge by id of posted rows; those without an id or state are skipped and come back with action `skipped`."""
    good = ~is_blank(F.col("id")) & ~is_blank(F.col("state"))
    done = merge(old, new.where(good), "id", rules, protect, order)
    skipped = new.where(~good).select("id", *(F.col(c) for c in rules), *(F.lit(None).cast(dict(new.dtypes)[c]).alias(f"previous_{c}") for c, r in rules.items() if r == "track"), F.lit("skipped").alias("action"))
    return done.unionByName(skipped)


def latest_by_key(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """One row for each key, the one highest in `order`: an aggregate, so hot keys combine before the shuffle."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def match_by_url_or_id(old: DataFrame, new: DataFrame) -> DataFrame:
    """new with old_id: the old row with its URL, else with its id. Two equi-joins, where an OR would compare all pairs."""
    urls = old.select(normalize_url(F.col("source_url")).alias("u"), F.col("id").alias("id_by_url")).groupBy("u").agg(F.min("id_by_url").alias("id_by_url"))
    ids = old.select(F.col("id").alias("id_by_id"))
    out = new.withColumn("u", normalize_url(F.col("source_url"))).join(urls, "u", "left").join(ids, F.col("id") == F.col("id_by_id"), "left")
    return out.withColumn("old_id", F.coalesce("id_by_url", "id_by_id")).drop("u", "id_by_url", "id_by_id")


def deactivate_unseen(listings: DataFrame, seen: DataFrame, auctioneer: object, as_of: str | None = None) -> DataFrame:
    """listings with is_active off where one auctioneer's active row, no duplicate,
    has an address that is not among those seen; with as_of also deactivated_at
    and updated_at. Only that auctioneer's rows are matched; all others pass."""
    own = F.coalesce(F.col("auctioneer_id") == auctioneer, F.lit(False)) & F.col("is_active") & ~F.coalesce("is_duplicate", F.lit(False))
    urls = seen.select(normalize_url(F.col("source_url")).alias("seen_url")).distinct()
    gone = listings.where(own).join(urls, normalize_url(F.col("source_url")) == F.col("seen_url"), "left").withColumn("_gone", F.col("seen_url").isNull()).drop("seen_url")
    out = listings.where(~F.coalesce(own, F.lit(False))).withColumn("_gone", F.lit(False)).unionByName(gone).withColumn("is_active", F.col("is_active") & ~F.col("_gone"))
    if as_of is not None:
        now = F.lit(as_of).cast("timestamp_ntz")
        before = F.col("deactivated_at") if "deactivated_at" in listings.columns else F.lit(None).cast("timestamp_ntz")
        out = out.withColumns({"deactivated_at": F.when(F.col("_gone"), now).otherwise(before), "updated_at": F.when(F.col("_gone"), now).otherwise(F.col("updated_at"))})
    return out.drop("_gone")


def deactivate_stale(listings: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    stale = F.coalesce(F.col("updated_at") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(days)} day"), F.lit(False))
    return listings.withColumn("is_active", F.col("is_active") & ~stale)


def deactivate_bad(listings: DataFrame) -> DataFrame:
    """Off where there is neither place, nor value, nor a usable URL; with the reason."""
    value = F.greatest(F.coalesce("first_auction_value", F.lit(0.0)), F.coalesce("second_auction_value", F.lit(0.0)))
    reason = F.when(is_blank(F.col("city")) & is_blank(F.col("state")), "no_place").when(value <= 0, "no_value").when(~valid_source_url(F.col("source_url")), "no_url")
    return listings.withColumn("reason", F.when(F.col("is_active"), reason)).withColumn("is_active", F.col("is_active") & reason.isNull())


def repair_discount(listings: DataFrame) -> DataFrame:
    """Discounts outside 0 to 100 go, then missing ones are computed from the values."""
    d = F.col("discount_percentage")
    computed = discount(F.col("evaluation_value"), F.coalesce("second_auction_value", "first_auction_value"))
    return listings.withColumn("discount_percentage", F.coalesce(F.when((d >= 0) & (d <= 100), d), computed))


def blank_images(listings: DataFrame) -> DataFrame:
    return listings.withColumn("image_url", F.when(~blocked_image(F.col("image_url")) & (F.length("image_url") >= 20), F.col("image_url")))


def auctioneer_counts(listings: DataFrame, auctioneers: DataFrame, key: str = "auctioneer_id", dim_key: str = "id") -> DataFrame:
    """Active, unique listings for each auctioneer; 0 where there are none."""
    n = listings.where(F.col("is_active") & ~F.col("is_duplicate")).groupBy(F.col(key).alias(dim_key)).agg(F.count(F.lit(1)).alias("n"))
    return auctioneers.join(n, dim_key, "left").withColumn("property_count", F.coalesce("n", F.lit(0))).drop("n")


def geocode_transition(listings: DataFrame, results: DataFrame, most: int = 3) -> DataFrame:
    """Status after an attempt: done, invalid, pending again, or failed at `most` attempts."""
    out = listings.join(results.select(F.col("id").alias("rid"), "success", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "error"), F.col("id") == F.col("rid"), "left")
    tried, attempts = F.col("rid").isNotNull(), F.coalesce("geocoding_attempts", F.lit(0)) + 1
    status = F.when(F.col("success"), "done").when(F.col("error").contains("invalid"), "invalid").when(attempts >= most, "failed").otherwise("pending")
    return out.withColumns({
        "geocoding_status": F.when(tried, status).otherwise(F.col("geocoding_status")), "geocoding_attempts": F.when(tried, attempts).otherwise(F.col("geocoding_attempts")),
        "geocoding_error": F.when(tried & ~F.col("success"), F.left("error", F.lit(500))), "latitude": F.when(tried & F.col("success"), F.col("lat")).otherwise(F.col("latitude")),
        "longitude": F.when(tried & F.col("success"), F.col("lon")).otherwise(F.col("longitude")),
    }).drop("rid", "success", "lat", "lon", "error")
