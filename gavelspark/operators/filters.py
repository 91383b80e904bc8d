"""Row filters and orders beside the search: what is kept, and what comes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank

#: Words of real estate and of other goods, and of pages that list lots. Fixed values.
ESTATE = "imovel|imóvel|imóveis|imoveis|apartamento|casa|terreno|comercial|rural|galpão|galpao|sala|loja|fazenda|sítio|sitio|chácara|chacara|prédio|predio|edificio|edifício"
OTHER = "veículo|veiculo|carro|moto|caminhão|caminhao|máquina|maquina|equipamento|móvel|movel|eletrônico|eletronico|jóia|joia|jóias|animal|trator|colheitadeira"
LISTING_WORDS = ["apartamento", "casa", "terreno", "imóvel", "imovel", "leilão", "leilao", "lance", "avaliação", "avaliacao", "r$", "reais", "desconto", "arrematação", "m²", "m2", "metros", "quartos", "dormitórios"]
#: Named orders: (column, descending). Fixed values.
ORDERS = {"recent": ("created_at", True), "price_asc": ("second_auction_value", False), "price_desc": ("second_auction_value", True), "discount": ("discount_percentage", True), "date": ("first_auction_date", False)}


def in_queue(rows: DataFrame, most: int = 3) -> DataFrame:
    """Rows whose geocoding waits and has been tried fewer than `most` times."""
    return rows.where((F.col("geocoding_status") == "pending") & (F.coalesce("geocoding_attempts", F.lit(0)) < most))


def of_estate(category: Column, title: Column) -> Column:
    """Kept: what speaks of real estate, and what has no category and speaks of no other goods."""
    c, t = (F.lower(F.coalesce(x, F.lit(""))) for x in (category, title))
    return c.rlike(ESTATE) | t.rlike(ESTATE) | (~(c.rlike(OTHER) | t.rlike(OTHER)) & (c == ""))


def lists_lots(content: Column, least: int = 3) -> Column:
    """A page with at least `least` of the words that listings use."""
    s = F.lower(F.coalesce(content, F.lit("")))
    return sum((F.contains(s, F.lit(w)).cast("int") for w in LISTING_WORDS), F.lit(0)) >= least


def showable(title: Column, values: list[Column], stub: str = "Imóvel") -> Column:
    """A title that is more than a stub, and some value above zero."""
    return ~is_blank(title) & (F.trim(title) != stub) & (F.greatest(F.lit(0.0), F.lit(0.0), *(F.coalesce(v, F.lit(0.0)) for v in values)) > 0)


def complete_item(required: list[Column], important: list[Column], least: int = 2) -> Column:
    some = lambda c: ~is_blank(c.cast("string"))
    whole = F.lit(True)
    for c in required:
        whole = whole & some(c)
    return whole & (sum((some(c).cast("int") for c in important), F.lit(0)) >= least)


def may_view(role: Column, status: Column, trial_end: Column, views: Column, as_of: str, most: int = 5) -> Column:
    """Admins, active subscribers, and trials that have neither ended nor used their views."""
    return F.coalesce(role == "admin", F.lit(False)) | F.coalesce(status == "active", F.lit(False)) | F.coalesce((status == "trial") & (trial_end > F.lit(as_of).cast("timestamp_ntz")) & (views < most), F.lit(False))


def trial_left(trial_end: Column, views: Column, as_of: str, most: int = 5) -> Column:
    """Views and begun days that remain, none below 0."""
    seconds = F.timestamp_diff("SECOND", F.lit(as_of).cast("timestamp_ntz"), trial_end)
    return F.struct(F.greatest(F.lit(0), F.lit(most) - F.coalesce(views, F.lit(0))).cast("long").alias("views_left"), F.greatest(F.lit(0), F.ceil(seconds / 86400)).cast("long").alias("days_left"))


def age_light(last: Column, as_of: str, days: int = 7) -> Column:
    """green within `days`, red beyond, grey for never."""
    return F.when(last.isNull(), "grey").when(last >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(days)} day"), "green").otherwise("red")


def by_light_and_text(rows: DataFrame, light: Column, wanted: str | None, text: str | None) -> DataFrame:
    if wanted is not None:
        rows = rows.where(light == wanted)
    return rows if text is None else rows.where(F.contains(F.lower("name"), F.lit(text.lower())) | F.contains(F.lower("website"), F.lit(text.lower())))


def by_discount(rows: DataFrame, page: int, size: int) -> DataFrame:
    """Missing discounts count as 0; the id breaks ties."""
    return rows.orderBy(F.coalesce("discount_percentage", F.lit(0.0)).desc(), "id").offset((page - 1) * size).limit(size)


def named_order(name: str) -> list[Column]:
    """Nulls last going down, first going up, as in search; an unknown name is `recent`."""
    column, down = ORDERS.get(name, ORDERS["recent"])
    return [F.col(column).desc_nulls_last() if down else F.col(column).asc_nulls_first(), F.col("id")]


def by_success(rows: DataFrame) -> DataFrame:
    """Scrapers that worked first, then by how much they hold."""
    return rows.orderBy(F.when(F.col("scrape_status") == "success", 0).when(F.col("scrape_status") == "error", 1).otherwise(2), F.desc_nulls_last("property_count"), "id")


def sorted_by(rows: DataFrame, column: str, descending: bool) -> DataFrame:
    """By a column of any type; missing values, dates too, come last both ways, and texts ignore case."""
    c = F.lower(column) if dict(rows.dtypes)[column] == "string" else F.col(column)
    return rows.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "id")


def after_page(rows: DataFrame, column: str, value: object, id: object, size: int) -> DataFrame:
    """The page after (value, id), going down: no row before it is sorted or counted, however deep the page."""
    c = F.col(column)
    return rows.where((c < value) | (c == value) & (F.col("id") > id)).orderBy(c.desc(), "id").limit(size)


def page_overlap(pages: DataFrame) -> DataFrame:
    """pages (page, titles) with the share of its titles that the page before has,
    and whether to stop there: nothing on two pages running, or 80 per cent the same."""
    from pyspark.sql import Window

    w = Window.partitionBy("site").orderBy("page")
    before = F.lag("titles").over(w)
    own, both = F.size("titles"), F.size(F.array_intersect("titles", before))
    share = F.when((own > 0) & before.isNotNull(), both / own).otherwise(0.0)
    return pages.withColumn("overlap", F.round(share, 4)).withColumn("stop", (share >= 0.8) | F.coalesce((own == 0) & (F.size(before) == 0), F.lit(False)))
