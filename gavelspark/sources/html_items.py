"""Items in HTML pages: by built-in expressions, where pages are split where a card
begins, and by selectors over the page's tree, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import parse_money, prices_in
from ..functions.places import place_in
from ..functions.text import clean_markup
from ..functions.urls import absolute_url, images_in
from .selectors import Tree


def first_match(html: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, pattern, 1)), F.lit(""))


def page_fields(html: Column) -> Column:
    """Title, description, number of links, images and paragraphs, and plain text of a page."""
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    return F.struct(
        clean_markup(first_match(html, r"(?is)<title[^>]*>(.*?)</title>")).alias("title"), first_match(html, r'(?is)<meta[^>]+name=["\']description["\'][^>]+content=["\']([^"\']*)').alias("description"),
        F.regexp_count(html, F.lit(r"(?i)<a\s")).cast("long").alias("links"), F.regexp_count(html, F.lit(r"(?i)<img\s")).cast("long").alias("images"), F.regexp_count(html, F.lit(r"(?i)<p[\s>]")).cast("long").alias("paragraphs"), clean_markup(body).alias("text"),
    )


def cards(pages: DataFrame, begin: str = r'(?i)(?=<(?:div|article|li)[^>]+class=["\'][^"\']*card)', html: str = "html", url: str = "url") -> DataFrame:
    """One row for each card that has a title or a link."""
    parts = pages.select(url, F.posexplode(F.split(F.concat(F.lit(" "), F.col(html)), begin)).alias("place", "card")).where("place > 0")
    c = F.col("card")
    out = parts.select(
        url, "place", clean_markup(first_match(c, r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>")).alias("title"), absolute_url(first_match(c, r'(?i)<a[^>]+href=["\']([^"\']+)'), F.col(url)).alias("link"),
        F.get(prices_in(clean_markup(c)), 0).alias("price"), F.get(images_in(c), 0).alias("image_url"), place_in(clean_markup(c)).alias("where"),
    )
    return out.where("title is not null or link is not null").select(url, "place", "title", "link", "price", "image_url", "where.city", "where.state")


#: Where cards are looked for if a site's settings name no place that is there, and where their fields are. Fixed values.
CARD_PLACES = ['div[class*="card"]', 'div[class*="item"]', 'div[class*="lote"]', "article", 'div[class*="imovel"]']
FIELD_PLACES = {
    "title": ['h2, h3, h4, [class*="title"]', '[class*="title"], [class*="titulo"]'], "price": ['[class*="price"], [class*="valor"]', '[class*="price"], [class*="valor"], [class*="lance"], [class*="preco"]'],
    "location": ['[class*="location"], [class*="cidade"]', '[class*="location"], [class*="local"], [class*="cidade"], [class*="endereco"]'],
}
LOT_LINK = "(?i)/imovel|/lote|/item|/detalhes"


def selected_cards(pages: DataFrame, settings: dict[str, str] | None = None, keep: list[str] | None = None, most_cards: int = 50, most_links: int = 20, least_title: int = 10, html: str = "html", url: str = "url", references: tuple[str, ...] | None = None) -> DataFrame:
    """Items of pages by selectors: keep, place, title, source_url, price, location,
    image_url. The first card selector that names any element (the settings' `card`,
    then CARD_PLACES) gives at most `most_cards` cards, nested ones each; where none
    does, links to lots give at most `most_links`. A field is what the settings'
    selector for it names first, else FIELD_PLACES. Items whose title has fewer than
    `least_title` characters go. A page that is null or has neither gives none. references: see Tree."""
    settings, keep = settings or {}, keep or []
    card_places = [s for s in [settings.get("card", ""), *CARD_PLACES] if s]
    places = {f: ([settings[f]] if f in settings else []) + FIELD_PLACES[f] for f in FIELD_PLACES}
    kinds = {"place": pa.int32(), "title": pa.string(), "href": pa.string(), "price_text": pa.string(), "location": pa.string(), "src": pa.string()}

    def of_page(page: str) -> list[tuple]:
        tree, out = Tree(page, references), []
        found = next((x for x in map(tree.select, card_places) if x), None)
        if found is None:
            linked = [i for i in tree.select("a[href]") if re.search(LOT_LINK, tree.attributes[i]["href"])]
            return [(n, tree.text(i), tree.attributes[i]["href"], None, "", None) for n, i in enumerate(linked[:most_links], 1)]
        for n, card in enumerate(found[:most_cards], 1):
            first = {f: next((tree.text(x[0]) for x in (tree.select(s, card) for s in options) if x), "") for f, options in places.items()}
            link, image = (next((tree.attributes[i][a] for i in tree.select(s, card)), None) for s, a in (("a[href]", "href"), ("img[src]", "src")))
            out.append((n, first["title"], link, first["price"], first["location"], image))
        return out

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [(i, *item) for i, page in enumerate(batch.column("html").to_pylist()) if page for item in of_page(page)]
            at = pa.array([x[0] for x in items], pa.int64())
            columns = [batch.column(c).take(at) for c in own] + [pa.array([x[1 + j] for x in items], k) for j, k in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays(columns, [*own, *kinds])

    given = pages.select(*keep, F.col(url).alias("_url"), F.col(html).alias("html"))
    own = [*keep, "_url"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in given.drop("html").dtypes), "place int, title string, href string, price_text string, location string, src string"])
    out = given.mapInArrow(extract, schema).where(F.length("title") >= least_title)
    amount = F.regexp_extract(F.translate(F.regexp_replace("price_text", r"(?i)R\$\s*", ""), ",.", "."), r"(\d+\.?\d*)", 1)
    return out.select(
        *keep, "place", "title", F.when(F.coalesce("href", F.lit("")) == "", F.col("_url")).otherwise(absolute_url(F.col("href"), F.col("_url"))).alias("source_url"),
        F.nullif(amount, F.lit("")).cast("double").alias("price"), "location", F.when(F.coalesce("src", F.lit("")) == "", "").otherwise(absolute_url(F.col("src"), F.col("_url"))).alias("image_url"),
    )


def configured_cards(pages: DataFrame, config: dict, keep: list[str], html: str = "html", url: str = "url") -> DataFrame:
    """Cards as a site's settings describe them: `card` is a tag and a class, the
    other entries are patterns whose first group is the field. Kept if there is a
    title or a link."""
    tag, kind = config["card"]
    begin = rf'(?i)(?=<{tag}[^>]+class=["\'][^"\']*\b{kind}\b)'
    parts = pages.select(*keep, url, F.posexplode(F.split(F.concat(F.lit(" "), F.col(html)), begin)).alias("place", "card")).where("place > 0")
    field = lambda name: clean_markup(first_match(F.col("card"), config[name])) if name in config else F.lit(None).cast("string")
    out = parts.select(*keep, "place", F.nullif(field("title"), F.lit("")).alias("title"), absolute_url(first_match(F.col("card"), config["link"]), F.col(url)).alias("link"), parse_money(F.nullif(field("price"), F.lit(""))).alias("price"))
    return out.where("title is not null or link is not null")


def links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Distinct absolute links of each page."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?i)<a[^>]+href=["\']([^"\'#]+)'), F.lit(1))
    return pages.select(url, F.explode(F.array_distinct(found)).alias("href")).select(url, absolute_url(F.col("href"), F.col(url)).alias("link")).distinct()


def structure_signature(html: Column) -> Column:
    """A digest of the tags and classes that a page is made of."""
    tags = F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)<([a-z0-9]+(?:[^>]*?class=["\'][^"\']*)?)'), F.lit(1))))
    return F.md5(F.array_join(tags, ",").cast("binary"))
