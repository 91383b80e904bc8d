"""Operational reports over auctioneers, runs, errors, users and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..functions.urls import host, valid_source_url
from .filters import age_light
from .stats import percent

#: Classes of errors by what their texts hold, in order. Fixed values.
ERRORS = [
    ("timeout", "timeout"), ("404|not found", "not found"), ("403|forbidden", "forbidden"), ("cloudflare", "cloudflare"), ("ssl|certificate", "certificate"), ("connection", "connection"), ("dns|resolve", "dns"),
    ("nenhum imóvel encontrado|no properties|sem imóveis|nenhum imovel", "no listings"), ("duplicate key|unique constraint", "duplicate key"),
]


def counts(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """How many rows have each value; none counts as 'none'."""
    return rows.groupBy(F.coalesce(value, F.lit("none")).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def invalid_urls(listings: DataFrame) -> DataFrame:
    """Listings and invalid addresses of each auctioneer that has any."""
    out = listings.groupBy("auctioneer_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~valid_source_url(F.col("source_url"))).alias("invalid"))
    return out.where("invalid > 0")


def failed_addresses(rows: DataFrame, most: int = 20) -> DataFrame:
    head = F.left("address", F.lit(100)).alias("address")
    return rows.where("geocoding_status = 'failed'").groupBy(head).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("address")).limit(most)


def page_with_total(rows: DataFrame, page: int, size: int, *order: Column) -> DataFrame:
    """One page, and the number of all rows beside each of its rows. The total is an aggregate of one row."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset((page - 1) * size).limit(size).join(F.broadcast(total))


def group_members(rows: DataFrame, by: str, member: str, weight: str) -> DataFrame:
    """Members of each group, a row each, largest weight first, with the group's number of members."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    out = rows.select(F.col(by).alias("_by"), F.col(member).alias("member"), F.col(weight).alias("weight")).join(counts, F.col("_by").eqNullSafe(F.col(by)))
    return out.select(by, "n", "member", "weight").orderBy(by, F.desc("weight"), "member")


def discovery_report(sites: DataFrame) -> DataFrame:
    """sites (online, method, difficulty) by method and difficulty, with each group's online rate."""
    n = F.count(F.lit(1))
    return sites.groupBy("method", "difficulty").agg(n.alias("n"), F.count_if("online").alias("online"), percent(F.count_if("online"), n, 1).alias("pct_online"))


def consolidated(runs: DataFrame) -> DataFrame:
    """A row for each source (source, total, ok) with its total and whether all its
    runs went well, and on each row what holds for all: total, sources, active ones,
    success rate."""
    n = F.count(F.lit(1))
    by_source = runs.groupBy("source").agg(F.sum("total").alias("source_total"), F.min(F.col("ok").cast("int")).alias("_ok"))
    whole = by_source.agg(F.sum("source_total").alias("total"), n.alias("sources"), F.count_if(F.col("source_total") > 0).alias("active"), percent(F.count_if(F.col("_ok") == 1), n, 1).alias("pct_ok"))
    return by_source.join(F.broadcast(whole)).select("source", "source_total", (F.col("_ok") == 1).alias("source_ok"), "total", "sources", "active", "pct_ok")  # one row


def error_class(error: Column) -> Column:
    s, out = F.lower(error), F.when(is_blank(error), "unspecified")
    for words, name in ERRORS:
        out = out.when(s.rlike(words), name)
    return out.otherwise("other")


def dashboard(auctioneers: DataFrame, as_of: str) -> DataFrame:
    """Counts by status, all listings, and how long ago the newest run was, in words."""
    n = lambda s: F.count_if(F.col("scrape_status") == s).alias(s)
    out = auctioneers.agg(F.count(F.lit(1)).alias("auctioneers"), F.sum("property_count").alias("listings"), n("success"), n("error"), n("pending"), F.max("last_scrape").alias("last"))
    return out.withColumn("age", age_in_words(F.col("last"), as_of)).drop("last")


def age_in_words(last: Column, as_of: str) -> Column:
    s = F.timestamp_diff("SECOND", last, F.lit(as_of).cast("timestamp_ntz"))
    whole = lambda by, unit: F.concat(F.floor(s / by).cast("string"), F.lit(unit))
    return F.when(s.isNull(), "never").when(s < 60, "now").when(s < 3600, whole(60, " min")).when(s < 86400, whole(3600, " h")).otherwise(whole(86400, " d"))


def light_counts(auctioneers: DataFrame, as_of: str) -> DataFrame:
    return counts(auctioneers, "light", age_light(F.col("last_scrape"), as_of))


def regrouped(by_category: DataFrame, alias: Column) -> DataFrame:
    """Counts (category, n) added up under display names."""
    return by_category.groupBy(alias.alias("category")).agg(F.sum("n").alias("n"))


def acceptance(items: DataFrame, accepted: Column) -> DataFrame:
    n, good = F.count(F.lit(1)), F.count_if(accepted)
    return items.agg(n.alias("total"), good.alias("accepted"), (n - good).alias("rejected"), percent(good, n, 1).alias("pct_accepted"))


def host_requests(requests: DataFrame, url: str = "url", failed: str = "failed") -> DataFrame:
    """Requests and error rate of each host."""
    n = F.count(F.lit(1))
    return requests.groupBy(host(F.col(url)).alias("host")).agg(n.alias("requests"), F.count_if(failed).alias("errors"), percent(F.count_if(failed), n, 2).alias("pct_errors"))


def run_totals(items: DataFrame) -> DataFrame:
    """Of each auctioneer's imported items (action): how many were inserted, updated or skipped."""
    n = lambda a: F.count_if(F.col("action") == a).alias(a)
    return items.groupBy("auctioneer_id").agg(F.count(F.lit(1)).alias("total"), n("inserted"), n("updated"), n("skipped"))


def diagnoses(sites: DataFrame) -> DataFrame:
    """sites (diagnosis, priority) by diagnosis, with the mean priority (2 places) and the highest."""
    mean = F.round(F.sum(F.col("priority").cast("decimal(18,0)")) / F.count("priority"), 2).cast("double")
    return sites.groupBy("diagnosis").agg(F.count(F.lit(1)).alias("n"), mean.alias("mean_priority"), F.max("priority").alias("max_priority"))


def unnamed(listings: DataFrame) -> DataFrame:
    """Auctioneers without a name, with their listings."""
    return listings.where(is_blank(F.col("auctioneer_name")) & F.col("auctioneer_id").isNotNull()).groupBy("auctioneer_id").agg(F.count(F.lit(1)).alias("n"))


def activity(users: DataFrame, searches: DataFrame, day: str) -> DataFrame:
    """Users by status, and what they searched and viewed on one day, in one row."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    own = searches.where(F.to_date("ts") == F.lit(day).cast("date")).agg(F.count_if(F.col("event_type") == "click").alias("searches"), F.count_if(F.col("event_type") == "view").alias("views"))
    return users.agg(F.count(F.lit(1)).alias("users"), n("active"), n("trial"), n("expired")).join(F.broadcast(own))


def morning_check(listings: DataFrame, auctioneers: DataFrame, as_of: str) -> DataFrame:
    """(check, value) of the catalog and its sources: active rows, new in a day, per
    cents (rounded down) with a place, value and image, and sources that failed or stand still."""
    now = F.lit(as_of).cast("timestamp_ntz")
    active, n = listings.where("is_active"), F.count(F.lit(1))
    floor = lambda c: F.when(n > 0, F.floor(F.count_if(c) * 100 / n)).otherwise(0)
    own = active.agg(
        n.alias("active"), F.count_if(F.col("created_at") >= now - F.expr("interval 1 day")).alias("new"), floor(~is_blank(F.col("city"))).alias("pct_city"),
        floor(F.coalesce("first_auction_value", F.lit(0.0)) > 0).alias("pct_value"), floor(~is_blank(F.col("image_url"))).alias("pct_image"),
    )
    sources = auctioneers.agg(F.count_if(F.col("scrape_status") == "error").alias("failed"), F.count_if((F.col("scrape_status") != "pending") & (F.col("last_scrape") < now - F.expr("interval 1 day"))).alias("idle"))
    both = own.join(F.broadcast(sources))
    return both.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("value")) for c in both.columns))).alias("x")).select("x.*")
