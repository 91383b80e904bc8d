"""Listing search: filters, order, pages, facets and the map."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.places import listing_category, state_prefix
from ..functions.text import is_blank
from ..schema import SORTABLE


@dataclass(frozen=True)
class SearchRequest:
    """What a search asks for; None means no condition. value_on says which
    value a range holds for: first, second, or either. normalised: state and
    category are brought to their stored forms first, and text is looked for in
    titles alone."""

    state: str | None = None
    city: str | None = None
    neighborhood: str | None = None
    category: str | None = None
    auction_type: str | None = None
    source: str | None = None
    auctioneer_id: object | None = None
    min_value: float | None = None
    max_value: float | None = None
    value_on: str = "first"
    min_discount: float | None = None
    text: str | None = None
    active_only: bool = True
    duplicates: bool = False
    normalised: bool = False
    sort_by: str = "created_at"
    descending: bool = True
    page: int = 1
    size: int = 18


def contains(c: Column, part: str) -> Column:
    """Case-insensitive, with nothing in `part` special."""
    return F.contains(F.lower(c), F.lit(part.lower()))


def conditions(r: SearchRequest) -> list[Column]:
    out: list[Column] = []
    if r.active_only:
        out.append(F.col("is_active"))
    if not r.duplicates:
        out.append(~F.col("is_duplicate"))
    if r.normalised:
        out += [F.col(n) == form(F.lit(v)) for n, v, form in (("state", r.state, state_prefix), ("category", r.category, listing_category)) if v]
    else:
        out += [F.lower(n) == str(v).lower() for n, v in (("state", r.state), ("category", r.category)) if v is not None]
    out += [F.col(n) == v for n, v in (("auction_type", r.auction_type), ("source", r.source), ("auctioneer_id", r.auctioneer_id)) if v is not None]
    out += [contains(F.col(n), v) for n, v in (("city", r.city), ("neighborhood", r.neighborhood)) if v is not None]
    if r.text is not None:
        out.append(contains(F.col("title"), r.text) if r.normalised else contains(F.col("title"), r.text) | contains(F.col("city"), r.text))
    values = {"first": ["first_auction_value"], "second": ["second_auction_value"], "either": ["first_auction_value", "second_auction_value"]}[r.value_on]
    if r.min_value is not None:
        out.append(reduce(Column.__or__, [F.col(v) >= r.min_value for v in values]))
    if r.max_value is not None:
        out.append(reduce(Column.__or__, [F.col(v) <= r.max_value for v in values]))
    if r.min_discount is not None:
        out.append(F.col("discount_percentage") >= r.min_discount)
    if r.sort_by == "discount_percentage":
        out.append((F.col("discount_percentage") > 0) & (F.col("discount_percentage") <= 100))
    return out


def matching(listings: DataFrame, r: SearchRequest) -> DataFrame:
    return reduce(DataFrame.where, conditions(r), listings)


def ordering(r: SearchRequest) -> list[Column]:
    """Nulls last going down, first going up; the id breaks ties. A field that is
    none of the known ones means created_at, but in normalised searches it is an error."""
    if r.normalised and r.sort_by not in SORTABLE:
        raise ValueError(f"not a sort field: {r.sort_by}")
    c = F.col(r.sort_by if r.sort_by in SORTABLE else "created_at")
    return [c.desc_nulls_last() if r.descending else c.asc_nulls_first(), F.col("id")]


def search(listings: DataFrame, r: SearchRequest) -> DataFrame:
    """One page, sorted."""
    return matching(listings, r).orderBy(*ordering(r)).offset((r.page - 1) * r.size).limit(r.size)


def page_info(listings: DataFrame, r: SearchRequest) -> DataFrame:
    """total, pages: one row, by an aggregate of the same filter."""
    n = F.count(F.lit(1))
    return matching(listings, r).agg(n.alias("total"), F.ceil(n / r.size).cast("long").alias("pages"))


def facet(listings: DataFrame, *columns: str, active_only: bool = True) -> DataFrame:
    """Distinct values that are not blank, with how many listings have them."""
    rows = listings.where("is_active") if active_only else listings
    return reduce(DataFrame.where, [~is_blank(F.col(c)) for c in columns], rows).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def on_map(listings: DataFrame, limit: int = 1000) -> DataFrame:
    """Active, no duplicates, with coordinates; zero counts as missing."""
    some = lambda c: F.col(c).isNotNull() & (F.col(c) != 0)
    rows = listings.where(F.col("is_active") & ~F.col("is_duplicate") & some("latitude") & some("longitude"))
    return rows.select("id", "title", "category", "city", "state", "latitude", "longitude").orderBy("id").limit(limit)


def map_bounds(listings: DataFrame, default: tuple[float, float] = (-14.235, -51.9253)) -> DataFrame:
    """Bounding box and its centre; the default centre when nothing is on the map."""
    rows = listings.where(F.col("is_active") & (F.col("latitude") != 0) & (F.col("longitude") != 0))
    lat, lon = F.col("latitude"), F.col("longitude")
    box = rows.agg(F.count(F.lit(1)).alias("n"), F.min(lat).alias("south"), F.max(lat).alias("north"), F.min(lon).alias("west"), F.max(lon).alias("east"))
    mid = lambda a, b, d: F.when(F.col("n") == 0, F.lit(d)).otherwise((F.col(a) + F.col(b)) / 2)
    return box.withColumns({"center_lat": mid("south", "north", default[0]), "center_lon": mid("west", "east", default[1])})


def pending_geocode(listings: DataFrame, limit: int = 50) -> DataFrame:
    missing = F.col("latitude").isNull() | (F.col("latitude") == 0) | F.col("longitude").isNull() | (F.col("longitude") == 0)
    return listings.where(missing & (F.col("state") != "XX") & F.col("is_active")).orderBy(F.desc_nulls_last("created_at"), "id").limit(limit)


def with_position(rows: DataFrame, *order: Column) -> DataFrame:
    """A small, aggregated relation with its rows numbered."""
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)))
