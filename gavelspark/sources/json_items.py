"""Listings in JSON of unlike shapes: result files, API answers, page data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import parse_area, parse_money
from ..functions.places import place_in
from ..functions.text import mended_text
from ..functions.urls import absolute_url

#: Where an answer may hold its items, and names of each field, in order of trust. Fixed values.
ITEM_KEYS = ["properties", "imoveis", "items", "offers", "data", "results", "lots", "leiloes", "lotes"]
FIELD_KEYS = {
    "external_id": ["id", "codigo", "lote_id", "offerId"], "title": ["title", "titulo", "name", "nome", "shortDesc", "product.shortDesc"], "price": ["price", "preco", "valor", "valor_minimo", "currentBid"],
    "evaluation": ["evaluation_value", "avaliacao", "valor_avaliacao"], "city": ["city", "cidade", "product.location.city"], "state": ["state", "uf", "estado", "product.location.state"],
    "url": ["url", "link", "href"], "image": ["image_url", "imagem", "image", "product.thumbnailUrl"], "auctioneer": ["auctioneer", "leiloeiro", "store.name"],
}


def items_of(text: Column) -> Column:
    """The first array found under a known key, or the text itself if it is one: an array of JSON texts."""
    arrays = [F.from_json(F.get_json_object(text, f"$.{k}"), "array<variant>") for k in ITEM_KEYS]
    own = F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<variant>"))
    return F.transform(F.coalesce(own, *arrays), lambda v: F.to_json(v))


def normalized(rows: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """One row for each item, with our fields; the first alias that is not blank wins."""
    one = rows.select(source, F.explode(items_of(F.col(text))).alias("item"))
    field = lambda keys: F.coalesce(*(F.nullif(F.trim(F.get_json_object("item", f"$.{k}")), F.lit("")) for k in keys))
    out = one.select(source, "item", *(field(keys).alias(f) for f, keys in FIELD_KEYS.items()))
    return out.withColumns({"price": parse_money(F.col("price")), "evaluation": parse_money(F.col("evaluation")), "id": F.concat_ws("-", source, F.coalesce("external_id", F.left(F.md5(F.col("item").cast("binary")), F.lit(12))))}).drop("item")


def offers(rows: DataFrame, text: str = "text") -> DataFrame:
    """Nested API offers, flattened: the highlighted image, else the first."""
    kind = "array<struct<id: bigint, price: double, product: struct<shortDesc: string, location: struct<city: string, state: string>, galleryJson: array<struct<link: string, highlight: boolean>>, thumbnailUrl: string>, auction: struct<id: bigint>, stores: array<struct<id: int, name: string>>>>"
    o = rows.select(F.explode(F.from_json(F.get_json_object(text, "$.offers"), kind)).alias("o"))
    gallery = F.coalesce("o.product.galleryJson", F.array().cast("array<struct<link: string, highlight: boolean>>"))
    image = F.coalesce(F.get(F.filter(gallery, lambda x: x["highlight"]), 0)["link"], F.get(gallery, 0)["link"], F.col("o.product.thumbnailUrl"))
    return o.select("o.id", F.col("o.product.shortDesc").alias("title"), "o.price", F.col("o.product.location.city").alias("city"), F.col("o.product.location.state").alias("state"), image.alias("image_url"), F.col("o.auction.id").alias("auction_id"), F.get("o.stores", 0)["name"].alias("auctioneer"))


def page_data(html: Column) -> Column:
    """The JSON that a page embeds for its scripts."""
    return F.nullif(F.trim(F.regexp_extract(html, r'(?is)<script[^>]*id=["\']__NEXT_DATA__["\'][^>]*>(.*?)</script>', 1)), F.lit(""))


#: Names of the fields of items as sources give them, the first that holds something counts. Fixed values.
MAPPED = {
    "title": ["titulo", "title", "nome", "name", "descricao_resumida", "description"], "description": ["descricao", "description", "detalhes", "details", "observacao"],
    "price": ["valor", "price", "preco", "lance_inicial", "valor_minimo", "valor_avaliacao", "first_auction_value"], "evaluated_price": ["valor_avaliacao", "avaliacao", "valor_mercado", "evaluation", "evaluation_value"],
    "discount": ["desconto", "discount", "percentual_desconto", "discount_percentage"], "address": ["endereco", "address", "localizacao", "location", "logradouro"], "city": ["cidade", "city", "municipio"],
    "state": ["estado", "state", "uf"], "category": ["tipo", "category", "categoria", "tipo_imovel", "property_type"], "area": ["area", "metragem", "area_total", "area_privativa", "m2"],
    "image_url": ["imagem", "image", "foto", "photo", "thumbnail", "imagem_url", "image_url"], "url": ["url", "link", "href", "detalhes_url", "source_url"],
    "auction_date": ["data_leilao", "auction_date", "data", "date", "data_praca", "first_auction_date"], "external_id": ["id", "codigo", "code", "ref", "referencia", "lote"],
}


def mapped_items(items: DataFrame, item: str, source: Column, base: Column, keep: list[str]) -> DataFrame:
    """keep and the fields of MAPPED for each item (a JSON object as text) that has a
    title or an id. Of a field's names the first counts whose value is there and not
    empty, 0, false or an empty list; addresses are made absolute; an id has its
    source before it, and is a digest of the item where there is none."""
    # The map comes out of an explode: a filter on the fields stays above it, so an item is parsed once, not again for each name that the filter reads.
    values = F.map_filter(F.try_variant_get(F.try_parse_json(item), "$", "map<string, string>"), lambda _, v: ~v.isin("", "0", "0.0", "false", "[]", "{}"))
    parsed = items.select(*dict.fromkeys([*keep, item]), F.explode(F.array(values)).alias("_m"))
    first = lambda names: F.coalesce(*(F.col("_m")[n] for n in names))
    out = parsed.select(*dict.fromkeys([*keep, item]), *(first(names).alias(f) for f, names in MAPPED.items())).where("title is not null or external_id is not null")
    whole = lambda c: F.when(F.col(c).startswith("http"), F.col(c)).otherwise(absolute_url(F.col(c), base))
    own = F.concat_ws("_", source, F.coalesce("external_id", F.left(F.md5(F.col(item).cast("binary")), F.lit(12))))
    return out.withColumns({"image_url": whole("image_url"), "url": whole("url"), "external_id": own}).select(*keep, *MAPPED)


_PAGE_OFFERS = (
    "array<struct<id: string, price: double, offerDescription: struct<offerDescription: string>, product: struct<shortDesc: string, galleryJson: array<struct<link: string, highlight: boolean>>>,"
    " auction: struct<eventPipeline: struct<stages: array<struct<initialBidValue: double>>>>>>"
)


def page_offer(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """keep and the first offer of a page's embedded data: texts mended, place and
    area from its title, the highlighted image, else the first; the values of its
    first two stages (the price where the first has none) and the discount between
    them, in tenths. Pages without an offer give no row."""
    found = F.from_json(F.get_json_object(page_data(F.col(html)), "$.props.pageProps.offerDetails.offers"), _PAGE_OFFERS)
    o = pages.select(*keep, F.get(found, 0).alias("o")).where("o is not null")
    title, text = mended_text(F.col("o.product.shortDesc")), mended_text(F.col("o.offerDescription.offerDescription"))
    gallery, stages = F.col("o.product.galleryJson"), F.col("o.auction.eventPipeline.stages")
    image = F.coalesce(F.nullif(F.get(F.filter(gallery, lambda x: x["highlight"]), 0)["link"], F.lit("")), F.get(gallery, 0)["link"], F.lit(""))
    first, second = (F.get(stages, i)["initialBidValue"] for i in (0, 1))
    area = lambda t: parse_area(F.nullif(F.regexp_extract(t, r"([0-9][0-9.,]*\s*(?:m2|m²|ha\b|hectares?))", 1), F.lit("")))
    out = o.select(*keep, F.col("o.id").alias("id"), title.alias("title"), text.alias("_text"), image.alias("image_url"), F.coalesce(F.nullif(first, F.lit(0.0)), F.col("o.price")).alias("first_auction_value"), second.alias("second_auction_value"))
    place = place_in(F.col("title"))
    off = F.round((1 - F.col("second_auction_value") / F.col("first_auction_value")) * 100, 1)
    return out.select(
        *keep, "id", "title", F.when(F.col("_text") != "", F.left("_text", F.lit(500))).otherwise(F.col("title")).alias("description"), F.regexp_replace(place["city"], r"^(?:.*\s)?em\s+", "").alias("city"), place["state"].alias("state"), "image_url",
        "first_auction_value", "second_auction_value", F.when((F.col("first_auction_value") > 0) & (F.col("second_auction_value") > 0), off).alias("discount_percentage"),
        F.coalesce(area(F.col("title")), area(F.col("_text"))).alias("area"), (F.contains(F.lower("title"), F.lit("ocupad")) | F.contains(F.lower("_text"), F.lit("ocupad"))).alias("is_occupied"),
    )


#: Categories and sales as the bank names them, in the order in which they are looked for. Fixed values.
_BANK_CATEGORIES = [("Apartamento", "apartamento"), ("Casa", "casa"), ("Terreno", "terreno"), ("Comercial", "comercial|loja")]
_BANK_SALES = [("Extrajudicial", "extrajudicial"), ("Judicial", "judicial"), ("Venda Direta", "venda direta")]


def bank_batch(rows: DataFrame, as_of: str) -> DataFrame:
    """The bank API's records as listings that wait for coordinates: values are in
    hundredths; both sales have the first value; a missing discount follows from the
    values, a missing address from its parts. Records without a number are left out."""
    given = lambda c: F.nullif(F.col(c), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    number = lambda c: F.col(c).cast("double") if c in rows.columns else F.lit(None).cast("double")
    named = lambda c, names, rest: F.coalesce(*(F.when(F.lower(c).rlike(w), n) for n, w in names), F.lit(rest))
    first, appraisal, off = (F.nullif(number(c), F.lit(0.0)) for c in ("valor_primeira_praca", "valor_avaliacao", "desconto_percentual"))
    address = F.coalesce(given("endereco"), F.nullif(F.concat_ws(", ", given("logradouro"), given("numero"), given("complemento")), F.lit("")), F.lit("Endereço não informado"))
    now = F.lit(as_of).cast("timestamp_ntz")
    return rows.where(F.col("numero_imovel").isNotNull()).select(
        F.concat(F.lit("caixa-"), F.col("numero_imovel").cast("string")).alias("id"), F.left(address, F.lit(100)).alias("title"), address.alias("address"), F.coalesce("cidade", F.lit("Não informado")).alias("city"),
        F.coalesce("estado", F.lit("SP")).alias("state"), F.col("bairro").alias("neighborhood"), named(F.col("categoria"), _BANK_CATEGORIES, "Outro").alias("category"),
        named(F.col("modalidade"), _BANK_SALES, "Extrajudicial").alias("auction_type"), (appraisal / 100).alias("evaluation_value"), (first / 100).alias("first_auction_value"), (first / 100).alias("second_auction_value"),
        F.coalesce(off, F.round((1 - first / appraisal) * 100, 2)).alias("discount_percentage"), number("area_total").alias("area_total"), number("area_construida").alias("area_privativa"), F.lit(None).cast("string").alias("image_url"),
        F.coalesce("url", F.lit("")).alias("source_url"), F.lit("caixa").alias("auctioneer_id"), F.coalesce(given("leiloeiro_nome"), F.lit("Caixa Econômica Federal")).alias("auctioneer_name"), F.lit("caixa").alias("source"),
        F.lit(True).alias("accepts_financing"), F.lit(True).alias("accepts_fgts"), F.lit("pending").alias("geocoding_status"), F.lit(0).alias("geocoding_attempts"), now.alias("created_at"), now.alias("updated_at"),
    )
