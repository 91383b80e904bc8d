"""Row audits: dates first, then values, each with errors, warnings and corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.places import is_estate, state_in
from ..functions.text import is_blank
from ..functions.urls import blocked_image
from ..schema import STATES
from .stats import percent


def audit(listings: DataFrame, as_of: str, valid_states: list[str] = STATES) -> DataFrame:
    """listings with corrected dates, values and discount, and errors, warnings
    and corrections as sorted text arrays; passed where there is no error."""
    now = F.lit(as_of).cast("timestamp_ntz")
    d1, d2, v1, v2 = (F.col(c) for c in ("first_auction_date", "second_auction_date", "first_auction_value", "second_auction_value"))
    swapped = F.coalesce(d2 < d1, F.lit(False))
    dated = listings.withColumns({
        "_swapped": swapped, "first_auction_date": F.when(swapped, d2).otherwise(d1), "second_auction_date": F.when(swapped, d1).otherwise(d2),
        "first_auction_value": F.when(swapped, v2).otherwise(v1), "second_auction_value": F.when(swapped, v1).otherwise(v2),
    })
    above = F.coalesce(v2 > v1, F.lit(False))  # after the dates
    valued = dated.withColumns({"_above": above, "first_auction_value": F.when(above, v2).otherwise(v1), "second_auction_value": F.when(above, v1).otherwise(v2)})
    exact = F.when((v1 > 0) & v2.isNotNull(), (1 - v2 / v1) * 100)
    d = F.col("discount_percentage")
    off = F.coalesce(F.abs(d - exact) > 1, d.isNull() & exact.isNotNull())
    state = F.upper(F.trim("state"))
    inferred = F.coalesce(F.when(state.isin(*valid_states), state), state_in(F.col("city")))
    errors = F.array_compact(F.array(
        F.when(v1 < 0, "negative_first"), F.when(v2 < 0, "negative_second"), F.when((d < 0) | (d > 100), "discount_out_of_range"),
        F.when(d1 > now + F.expr("interval 365 day"), "date_too_far"), F.when(inferred.isNull(), "unknown_state"),
    ))
    warnings = F.array_compact(F.array(F.when(d1 < now - F.expr("interval 30 day"), "date_past"), F.when(v1 > F.col("evaluation_value"), "first_above_evaluation")))
    fixes = F.array_compact(F.array(F.when(F.col("_swapped"), "dates_swapped"), F.when(F.col("_above"), "values_swapped"), F.when(off, "discount_recomputed")))
    out = valued.withColumns({"errors": F.sort_array(errors), "warnings": F.sort_array(warnings), "corrections": F.sort_array(fixes), "discount_percentage": F.when(off, exact).otherwise(d)})
    return out.withColumn("passed", F.size("errors") == 0).drop("_swapped", "_above")


def audit_summary(audited: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return audited.agg(
        n.alias("n"), F.count_if("passed").alias("passed"), F.count_if(F.size("warnings") > 0).alias("warned"), F.count_if(F.size("corrections") > 0).alias("corrected"),
        percent(F.count_if("passed"), n, 2).alias("pct_passed"), percent(F.count_if(F.size("corrections") > 0), n, 2).alias("pct_corrected"),
    )


def first_failure(listings: DataFrame) -> DataFrame:
    """The first rule that a listing breaks, in order: estate, category, place, image, price; null: none."""
    price = F.greatest(F.coalesce("first_auction_value", F.lit(0.0)), F.coalesce("second_auction_value", F.lit(0.0)), F.coalesce("evaluation_value", F.lit(0.0)))
    reason = (
        F.when(~is_estate(F.col("title"), F.col("source_url")), "not_estate").when(is_blank(F.col("category")), "no_category").when(is_blank(F.col("city")) | is_blank(F.col("state")), "no_place")
        .when(blocked_image(F.col("image_url")), "no_image").when(price <= 0, "no_price")
    )
    return listings.withColumn("failure", reason)


def missing_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """rows with the names of required fields that are null, blank or 0, joined."""
    gone = lambda c: is_blank(F.col(c).cast("string")) | (F.col(c).cast("string").isin("0", "0.0"))
    return rows.withColumn("missing", F.array_join(F.array_compact(F.array(*(F.when(gone(c), c) for c in fields))), ","))
