"""Catalog statistics and quality reports, each one pass of conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..functions.urls import blocked_image, normalize_url


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    """Of counts, in decimals, half up; 0 of nothing."""
    share = part.cast("decimal(18,0)") * 100 / whole.cast("decimal(18,0)")
    return F.when(whole > 0, F.round(share, places)).otherwise(F.lit(0)).cast("double")


def present(c: str) -> Column:
    return F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))


def overview(listings: DataFrame) -> DataFrame:
    """Totals; the mean discount is over those that are not zero, in decimals."""
    d = F.nullif(F.round(F.col("discount_percentage").cast("decimal(18,6)"), 4), F.lit(0).cast("decimal(18,4)"))
    return listings.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_active").alias("active"), F.count_if(~F.col("is_duplicate")).alias("unique_rows"), F.count_if("is_duplicate").alias("duplicates"),
        F.countDistinct("auctioneer_id").alias("auctioneers"), F.round(F.sum(d) / F.count(d), 2).cast("double").alias("mean_discount"), F.max("updated_at").alias("last_update"),
    )


def count_by(listings: DataFrame, *dims: Column | str, most: int | None = None) -> DataFrame:
    """Counts by dimensions that are not null, largest first; the values break ties."""
    columns = [F.col(d) if isinstance(d, str) else d for d in dims]
    out = listings.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    names = [c for c in out.columns if c != "n"]
    out = out.dropna(subset=names)
    return out if most is None else out.orderBy(F.desc("n"), *names).limit(most)


def count_by_each(listings: DataFrame, dims: list[str]) -> DataFrame:
    """Counts by each dimension by itself, from one scan: (dimension, value, n)."""
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims))
    return listings.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def by_source(listings: DataFrame, dims: list[str]) -> DataFrame:
    """count_by_each for the bank's listings and the rest; no source is the rest."""
    bank = (F.coalesce(F.col("source"), F.lit("")) == "caixa").alias("is_bank")
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims))
    return listings.select(bank, F.explode(pairs).alias("p")).select("is_bank", "p.*").where("value is not null").groupBy("is_bank", "dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def share_of_total(listings: DataFrame, dim: str) -> DataFrame:
    """Counts with their share of all, 2 places. The window is over the groups."""
    n = listings.groupBy(dim).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", percent(F.col("n"), F.sum("n").over(Window.partitionBy()), 2))


FIELDS = ["neighborhood", "image_url", "latitude", "first_auction_value", "second_auction_date"]


def quality_report(listings: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """How many rows have each field, and per cent."""
    n = F.count(F.lit(1))
    return listings.agg(n.alias("total"), *(present(f).alias(f"n_{f}") for f in fields), *(percent(present(f), n).alias(f"pct_{f}") for f in fields))


def completeness(listings: DataFrame, dim: str, fields: list[str] = FIELDS) -> DataFrame:
    """The mean of the fields' percentages for each value of dim, in bands at 80, 60 and 40."""
    n = F.count(F.lit(1))
    total = sum((present(f) for f in fields), F.lit(0))
    out = listings.groupBy(dim).agg(n.alias("n"), percent(total, n * len(fields), 2).alias("score"))
    s = F.col("score")
    return out.withColumn("band", F.when(s >= 80, "excellent").when(s >= 60, "good").when(s >= 40, "fair").otherwise("poor"))


def quality_score(listings: DataFrame, fields: list[str]) -> DataFrame:
    """One row: active listings, the share of them that has each field (per cent, one
    decimal), the mean of the shares, and its band (80, 60, 40)."""
    n = F.count(F.lit(1))
    shares = [F.when(n > 0, present(f) * 100 / n).otherwise(0.0) for f in fields]
    out = listings.where("is_active").agg(n.alias("total"), *(F.round(x, 1).alias(f"pct_{f}") for f, x in zip(fields, shares, strict=True)), (sum(shares[1:], shares[0]) / len(fields)).alias("score"))
    s = F.col("score")
    return out.withColumns({"band": F.when(s >= 80, "excellent").when(s >= 60, "good").when(s >= 40, "fair").otherwise("poor"), "score": F.round("score", 1)})


_BAD_IMAGES = "facebook|logo|placeholder|no-image"


def maintenance(listings: DataFrame) -> DataFrame:
    """One row: five counts of what can be mended and three totals."""
    shouted = lambda c: (F.col(c) == F.upper(c)) & (F.length(c) > 2)
    no_url, bank = is_blank(F.col("source_url")), F.col("id").startswith("caixa-")
    return listings.agg(
        F.count_if(shouted("city")).alias("uppercase_cities"), F.count_if(shouted("neighborhood")).alias("uppercase_neighborhoods"), F.count_if(F.col("image_url").rlike(_BAD_IMAGES)).alias("invalid_images"),
        F.count_if(no_url & bank).alias("missing_bank_urls"), F.count_if(no_url & ~bank).alias("missing_other_urls"), F.count(F.lit(1)).alias("total"), F.count_if(~is_blank(F.col("image_url"))).alias("with_image"), F.count_if(~no_url).alias("with_url"),
    )


def maintained(listings: DataFrame, page: str) -> DataFrame:
    """listings with what `maintenance` counts mended: names in title case, no such
    images, and the bank's own page (`page` and the number) where its rows have none."""
    named = lambda c: F.when(F.col(c) == F.upper(c), F.initcap(c)).otherwise(F.col(c))
    lacks = is_blank(F.col("source_url")) & F.col("id").startswith("caixa-")
    return listings.withColumns({
        "city": named("city"), "neighborhood": named("neighborhood"), "image_url": F.when(~F.col("image_url").rlike(_BAD_IMAGES), F.col("image_url")),
        "source_url": F.when(lacks, F.concat(F.lit(page), F.replace("id", F.lit("caixa-"), F.lit("")))).otherwise(F.col("source_url")),
    })


def audit_counts(listings: DataFrame) -> DataFrame:
    no = lambda c: is_blank(F.col(c))
    first, second = F.coalesce("first_auction_value", F.lit(0.0)), F.coalesce("second_auction_value", F.lit(0.0))
    d = F.col("discount_percentage")
    return listings.agg(
        F.count_if(no("city")).alias("no_city"), F.count_if(no("state")).alias("no_state"), F.count_if(no("neighborhood")).alias("no_neighborhood"),
        F.count_if((first <= 0) & (second <= 0)).alias("no_value"), F.count_if(no("source_url")).alias("no_url"), F.count_if((d < 0) | (d > 100)).alias("bad_discount"),
        F.count_if(second > first).alias("second_above_first"), F.count_if(first > F.col("evaluation_value")).alias("first_above_evaluation"),
    )


def case_variants(rows: DataFrame, column: str) -> DataFrame:
    """Values that differ in case alone."""
    out = rows.where(F.col(column).isNotNull()).groupBy(F.lower(column).alias("folded")).agg(F.sort_array(F.collect_set(column)).alias("v"), F.count(F.lit(1)).alias("n"))
    return out.where(F.size("v") > 1).select("folded", F.array_join("v", "|").alias("variants"), "n")


def duplicate_urls(listings: DataFrame) -> DataFrame:
    return listings.groupBy(normalize_url(F.col("source_url")).alias("url")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key")).where("n > 1")


def per_auctioneer(listings: DataFrame) -> DataFrame:
    """Count, first and last date, and listings without an image for each auctioneer."""
    return listings.where("auctioneer_id is not null").groupBy("auctioneer_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.count_if(blocked_image(F.col("image_url"))).alias("no_image")
    )


def image_coverage(listings: DataFrame, dim: str) -> DataFrame:
    return listings.groupBy(dim).agg(*_images())


def image_coverage_overall(listings: DataFrame) -> DataFrame:
    """The same of all listings, in one row."""
    return listings.agg(*_images())


def _images() -> list[Column]:
    n, good = F.count(F.lit(1)), F.count_if(~blocked_image(F.col("image_url")))
    return [n.alias("n"), good.alias("with_image"), percent(n - good, n).alias("pct_missing")]


def distinct_counts(listings: DataFrame, dims: list[str]) -> DataFrame:
    return listings.agg(*(F.countDistinct(d).alias(f"distinct_{d}") for d in dims))


def count_vs_values(listings: DataFrame, column: str) -> DataFrame:
    return listings.agg(F.count(F.lit(1)).alias("n_rows"), F.count(column).alias("n_values"))


def discount_validity(listings: DataFrame) -> DataFrame:
    d = F.col("discount_percentage")
    return listings.agg(F.count_if(d.isNull()).alias("missing"), F.count_if((d >= 0) & (d <= 100)).alias("valid"), F.count_if((d < 0) | (d > 100)).alias("invalid"), F.round(F.max(d).cast("decimal(18,6)"), 2).cast("double").alias("highest"))


def banded(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """A histogram over bands [edge, next edge); the first is below all edges."""
    v, band = F.col(value), F.lit(0)
    for i, edge in enumerate(edges, 1):
        band = F.when(v >= edge, i).otherwise(band)
    return rows.where(v.isNotNull()).groupBy(band.cast("int").alias("band")).agg(F.count(F.lit(1)).alias("n"))


def value_anomalies(listings: DataFrame) -> DataFrame:
    label = F.when(F.col("first_auction_value") < F.col("second_auction_value"), "first_below_second").when(F.col("evaluation_value") < F.col("first_auction_value"), "evaluation_below_first").otherwise("ok")
    return listings.groupBy(label.alias("anomaly")).agg(F.count(F.lit(1)).alias("n"))


def dedup_stats(listings: DataFrame, key: Column) -> DataFrame:
    """Groups of equal keys: how many, the largest, and the per cent of rows beyond the first of a group."""
    groups = listings.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    out = groups.agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 1).alias("groups"), F.max("n").alias("largest"), F.sum(F.col("n") - 1).alias("extra"))
    return out.withColumn("pct_extra", percent(F.col("extra"), F.col("total"), 2))


def json_top(rows: DataFrame, column: str, path: str, most: int = 10) -> DataFrame:
    """The commonest values of a JSON field."""
    return count_by(rows.select(F.get_json_object(column, path).alias("value")), "value", most=most)


def modal(rows: DataFrame, dim: str, value: str) -> DataFrame:
    """The commonest value for each dim; the lowest of those that tie."""
    n = rows.where(F.col(value).isNotNull()).groupBy(dim, value).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(dim).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"))
    return best.select(dim, F.col("b.v").alias("modal"), (-F.col("b.m")).alias("n"))
