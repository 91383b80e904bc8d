"""Which sites must be looked at again, how they are read, and what ails them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank


def _metric(name: str) -> Column:
    return F.coalesce(F.get_json_object("validation_metrics", f"$.{name}").try_cast("int"), F.lit(0))


def _config_time(name: str) -> Column:
    return F.left(F.get_json_object("scrape_config", f"$.{name}"), F.lit(19)).try_cast("timestamp_ntz")


def eligible(auctioneers: DataFrame, as_of: str, days: int = 30, failures: int = 3) -> DataFrame:
    """Auctioneers with a site and any sign of age: no settings, marked, read long ago or never, or failing."""
    old = F.col("last_discovery_at") < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(days)} day")
    sign = F.col("scrape_config").isNull() | (F.col("discovery_status") == "needs_rediscovery") | old | F.col("last_discovery_at").isNull() | (_metric("consecutive_failures") >= failures)
    return auctioneers.where(~is_blank(F.col("website")) & F.coalesce(sign, F.lit(False)))


def pending(auctioneers: DataFrame) -> DataFrame:
    """Auctioneers with a site that nobody has looked at yet."""
    return auctioneers.where(~is_blank(F.col("website")) & (F.col("discovery_status").isNull() | (F.col("discovery_status") == "pending")))


def rediscovery(auctioneers: DataFrame, as_of: str, large: int = 100) -> DataFrame:
    """id, reason: the first that holds of no settings, expired, old (a week for
    sites of more than `large` listings, a month for others), failures in a row,
    a low success rate, or a mark; null where the settings still do."""
    now = F.lit(as_of).cast("timestamp_ntz")
    days = F.timestamp_diff("DAY", _config_time("discovered_at"), now)
    total, good = _metric("total_extractions"), _metric("successful_extractions")
    reason = (
        F.when(is_blank(F.col("scrape_config")), "no_config").when(_config_time("expires_at") < now, "config_expired").when(days > F.when(F.col("property_count") > large, 7).otherwise(30), "config_old")
        .when(_metric("consecutive_failures") >= 3, "consecutive_failures").when((total >= 5) & (good * 2 < total), "low_success_rate").when(F.col("discovery_status") == "needs_rediscovery", "marked")
    )
    return auctioneers.select("id", reason.alias("reason"))


def expires_at(found: Column, listings: Column, large: int = 100) -> Column:
    """A week after, for sites of more than `large` listings; else a month."""
    return found + F.make_dt_interval(F.when(listings > large, 7).otherwise(30))


def metrics_of(runs: DataFrame, failures: int = 3) -> DataFrame:
    """Validation metrics of each source from its whole history (source, seq, ok, n):
    totals, mean listings of the runs that worked, failures since the last of
    them, and whether it must be looked at again. One window, one aggregate."""
    w = Window.partitionBy("source").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    good = F.col("ok") & (F.col("n") > 0)
    marked = runs.withColumn("good", good).withColumn("since", F.sum(good.cast("int")).over(w))
    out = marked.groupBy("source").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("good").alias("successful"), F.count_if(F.col("since") == 0).alias("consecutive_failures"),
        F.round(F.try_divide(F.sum(F.when(F.col("good"), F.col("n"))).cast("decimal(18,0)"), F.count_if("good").cast("decimal(18,0)")), 4).cast("double").alias("mean_listings"),
    )
    return out.withColumn("needs_rediscovery", F.col("consecutive_failures") >= failures)


def with_scrape_status(auctioneers: DataFrame, results: DataFrame) -> DataFrame:
    """auctioneers after results (id, ok, error, found): status, error (none after
    success) and count, which stays where nothing was found out."""
    r = results.select(F.col("id").alias("_id"), "ok", "error", "found")
    out = auctioneers.join(r, F.col("id") == F.col("_id"), "left")
    tried = F.col("_id").isNotNull()
    return out.withColumns({
        "scrape_status": F.when(tried & F.col("ok"), "success").when(tried, "error").otherwise(F.col("scrape_status")),
        "scrape_error": F.when(tried & F.col("ok"), F.lit(None).cast("string")).when(tried, F.col("error")).otherwise(F.col("scrape_error")),
        "property_count": F.when(tried, F.coalesce("found", "property_count")).otherwise(F.col("property_count")),
    }).drop("_id", "ok", "error", "found")


def estimated_lots(html: Column, most: int = 10_000) -> Column:
    """The largest number below `most` that stands before or after a word for lots."""
    s = F.lower(html)
    found = F.concat(*(F.regexp_extract_all(s, F.lit(p), F.lit(1)) for p in (r"(\d+)\s*im[óo]ve?is?", r"(\d+)\s*lotes?", r"(\d+)\s*resultados?", r"total[:\s]+(\d+)")))
    return F.coalesce(F.array_max(F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda n: n < most)), F.lit(0))


def diagnosis(error: Column, status: Column, blocked: Column, maintenance: Column, dynamic: Column, listed: Column, estimate: Column) -> Column:
    """(name, priority) of the first thing that ails a site: its connection, its
    answer, a wall, upkeep, scripts, then what it lists."""
    row = lambda name, priority: F.struct(F.lit(name).alias("name"), F.lit(priority).alias("priority"))
    return (
        F.when(error == "TIMEOUT", row("timeout", 3)).when(error == "SSL_ERROR", row("certificate", 2)).when(error == "CONNECTION_ERROR", row("dns", 1)).when(error == "REDIRECT_LOOP", row("redirect_loop", 2))
        .when(status == 403, row("forbidden", 3)).when(status == 404, row("not_found", 2)).when(status >= 500, row("server_error", 2)).when(blocked, row("blocked", 4)).when(maintenance, row("maintenance", 1))
        .when(dynamic & ~listed, row("dynamic", 4)).when((status == 200) & listed & (estimate > 0), row("scraper_outdated", 5)).when((status == 200) & listed, row("nothing_listed", 3)).when(status == 200, row("structure_changed", 4)).otherwise(row("unknown", 3))
    )


def method(cloudflare: Column, scripts: Column, pattern: Column) -> Column:
    """(name, difficulty) of the simplest way to read a site."""
    row = lambda name, difficulty: F.struct(F.lit(name).alias("name"), F.lit(difficulty).alias("difficulty"))
    return F.when(cloudflare & scripts, row("browser_stealth", "high")).when(scripts, row("browser", "medium")).when(cloudflare, row("http_stealth", "medium")).when(~is_blank(pattern), row("http", "low")).otherwise(row("investigate", "unknown"))


def backoff_seconds(failures: Column, base: int = 5, free: int = 3, most: int = 300) -> Column:
    """No wait up to `free` failures in a row less one, then doubling up to `most`."""
    return F.when(failures < free, 0.0).otherwise(F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), (failures - free).cast("double"))))


def paired_runs(events: DataFrame) -> DataFrame:
    """Runs (source, run_id) from their start and end events; one that has not ended is open."""
    at = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("ts")))
    out = events.groupBy("source", "run_id").agg(at("start").alias("start_time"), at("end").alias("end_time"))
    return out.where("start_time is not null").withColumn("seconds", F.timestamp_diff("SECOND", F.col("start_time"), F.col("end_time"))).withColumn("is_open", F.col("end_time").isNull())
