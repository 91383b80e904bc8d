"""Health of scrapers from their runs (scraper, day, found, failed, redirected, start_time, ok)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import percent


def run_ratios(runs: DataFrame) -> DataFrame:
    return runs.select("scraper", "day", "found", percent(F.col("found") - F.col("failed"), F.col("found"), 2).alias("pct_ok"), percent(F.col("redirected"), F.col("found"), 2).alias("pct_redirected"))


_RUN = ["day", "found", "failed", "redirected", "ok", "start_time"]


def run_summary(runs: DataFrame, n: int = 10) -> DataFrame:
    """What the reports need of each scraper's history: runs (their number), streak
    (of failures at its end), last_ok and last, the newest n runs, newest first.
    Months are summed up apart and then put together, so no task sees a scraper's
    whole history, and a summary goes on from another (see merge_summaries)."""
    months = runs.groupBy("scraper", F.trunc("day", "month").alias("at")).agg(F.sort_array(F.collect_list(F.struct(*_RUN)), asc=False).alias("r"))
    r = F.col("r")
    first_ok = F.array_position(F.transform(r, lambda x: x["ok"]), True)
    parts = months.select(
        "scraper", "at", F.size(r).cast("long").alias("runs"), F.when(first_ok > 0, first_ok - 1).otherwise(F.size(r)).cast("long").alias("streak"),
        F.array_max(F.transform(F.filter(r, lambda x: x["ok"]), lambda x: x["start_time"])).alias("last_ok"), F.slice(r, 1, n).alias("last"),
    )
    return _together(parts, n)


def merge_summaries(old: DataFrame, new: DataFrame, n: int = 10) -> DataFrame:
    """The summary of a history and of the runs after it."""
    return _together(old.withColumn("at", F.lit(0)).unionByName(new.withColumn("at", F.lit(1))), n)


def _together(parts: DataFrame, n: int) -> DataFrame:
    fields = ["at", "runs", "streak", "last_ok", "last"]
    each = parts.groupBy("scraper").agg(F.sum("runs").alias("all"), F.sort_array(F.collect_list(F.struct(*fields)), asc=False).alias("p"))  # a row for each month
    p = F.col("p")
    nothing = F.struct(
        F.lit(0).cast("long").alias("streak"), F.lit(True).alias("failing"), F.get(F.transform(F.slice(p, 1, 0), lambda x: x["last_ok"]), 0).alias("last_ok"), F.slice(F.get(p, 0)["last"], 1, 0).alias("last"),
    )

    def older(so_far: Column, part: Column) -> Column:
        return F.struct(
            F.when(so_far["failing"], so_far["streak"] + part["streak"]).otherwise(so_far["streak"]).alias("streak"), (so_far["failing"] & (part["streak"] == part["runs"])).alias("failing"),
            F.greatest(so_far["last_ok"], part["last_ok"]).alias("last_ok"), F.slice(F.concat(so_far["last"], part["last"]), 1, n).alias("last"),
        )

    return each.select("scraper", F.col("all").alias("runs"), F.aggregate(p, nothing, older).alias("s")).select("scraper", "runs", "s.streak", "s.last_ok", "s.last")


def _summed(runs: DataFrame, n: int) -> DataFrame:
    """Sums over the newest n runs of each scraper, and over their newer and older half."""
    last = F.col("last")
    half = F.floor(F.size(last) / 2).cast("int")
    total = lambda c, of: F.aggregate(of, F.lit(0).cast("long"), lambda t, x: t + x[c])
    newer, older = F.slice(last, 1, half), F.slice(last, half + 1, F.size(last) - half)
    return run_summary(runs, n).select(
        "scraper", "streak", "last_ok", F.size(last).cast("long").alias("runs"), F.size(F.filter(last, lambda x: x["ok"])).cast("long").alias("works"), *(total(c, last).alias(c) for c in ("found", "failed", "redirected")),
        total("found", newer).alias("new_found"), half.cast("long").alias("new_runs"), total("found", older).alias("old_found"), (F.size(last) - half).cast("long").alias("old_runs"),
    )


def _declined() -> Column:
    """The newer half of the runs found less than half of what the older did; means compared without dividing."""
    return (F.col("runs") >= 4) & (2 * F.col("new_found") * F.col("old_runs") < F.col("old_found") * F.col("new_runs"))


def failure_streak(runs: DataFrame) -> DataFrame:
    """How many of the newest runs failed in a row, and when one last worked."""
    return _summed(runs, 1).select("scraper", "streak", "last_ok")


def decline(runs: DataFrame, n: int = 10) -> DataFrame:
    """Whether the newer half of the last n runs found less than half of what the older half did."""
    return _summed(runs, n).select("scraper", "runs", "new_found", "new_runs", "old_found", "old_runs", _declined().alias("declined"))


def health_report(runs: DataFrame, n: int = 10) -> DataFrame:
    """Status of each scraper over its last n runs, with up to three issues."""
    rate = percent(F.col("works"), F.col("runs"), 2)
    issues = F.array_compact(F.array(
        F.when(F.col("failed") > 5, "many failures"), F.when(F.col("redirected") * 5 > F.col("found"), "redirects"), F.when(_declined(), "decline"), F.when(F.col("found") < 5 * F.col("runs"), "few found"),
    ))
    status = F.when(F.col("streak") >= 3, "FAILING").when(rate >= 80, "HEALTHY").when(rate >= 50, "DEGRADED").otherwise("FAILING")
    return _summed(runs, n).select("scraper", "runs", "streak", rate.alias("pct_good"), status.alias("status"), F.array_join(F.slice(issues, 1, 3), ", ").alias("issues"))


def run_lengths(runs: DataFrame) -> DataFrame:
    """Seconds of each run, and per cents of its valid rows and addresses; 0 of nothing."""
    urls = F.col("urls_validated") + F.col("urls_failed")
    return runs.select(
        "scraper_name", "run_id", F.timestamp_diff("SECOND", F.col("start_time"), F.col("end_time")).alias("seconds"), percent(F.col("properties_valid"), F.col("properties_found"), 2).alias("pct_valid"),
        percent(F.col("urls_validated"), urls, 2).alias("pct_urls"), F.array_join(F.slice(F.array_sort(F.array_distinct("errors")), 1, 5), "; ").alias("errors"),
    )


def system_summary(report: DataFrame) -> DataFrame:
    """Counts by status; the worst one that occurs is the system's."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = report.agg(F.count(F.lit(1)).alias("scrapers"), *(n(s).alias(s.lower()) for s in ("HEALTHY", "DEGRADED", "FAILING")))
    return out.withColumn("overall", F.when(F.col("failing") > 0, "FAILING").when(F.col("degraded") > 0, "DEGRADED").otherwise("HEALTHY"))


def retained(runs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    return runs.where(F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), days))


def alerts(listings: DataFrame, runs: DataFrame, as_of: str) -> DataFrame:
    """(rule, subject) of each rule that fires: failing and idle scrapers; a catalog with many rows without a
    place, fewer than half with a price, or nothing new for a day."""
    idle = runs.groupBy("scraper").agg(F.max("day").alias("d")).where(F.datediff(F.lit(as_of).cast("date"), F.col("d")) > 2).select(F.lit("idle").alias("rule"), F.concat(F.lit("scraper "), "scraper").alias("subject"))
    failing = health_report(runs).where("status = 'FAILING'").select(F.lit("failing").alias("rule"), F.concat(F.lit("scraper "), "scraper").alias("subject"))
    sums = listings.agg(F.count_if(F.col("neighborhood").isNull()).alias("lacking"), F.count_if(F.col("first_auction_value") > 0).alias("priced"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("created_at") >= F.lit(as_of).cast("timestamp_ntz") - F.expr("interval 1 day")).alias("new"))
    rules = F.array_compact(F.array(F.when(F.col("lacking") > 100, "no neighborhood"), F.when(F.col("priced") * 2 < F.col("n"), "half unpriced"), F.when(F.col("new") == 0, "nothing new")))
    return failing.unionByName(idle).unionByName(sums.select(F.explode(rules).alias("subject"), F.lit("catalog").alias("rule")))
