"""Categories of listings: the ways in which sources' words become one of a closed set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import title_every_letter

#: Spellings that have a name of their own. Fixed values.
PLAIN_NAMES = {
    "apartamento": "Apartamento", "casa": "Casa", "terreno": "Terreno", "comercial": "Comercial", "rural": "Rural", "galpão": "Galpão", "galpao": "Galpão", "loja": "Loja", "sala comercial": "Sala Comercial",
    "prédio": "Prédio", "predio": "Prédio", "chácara": "Chácara", "chacara": "Chácara", "sitio": "Sítio", "sítio": "Sítio", "fazenda": "Fazenda", "cobertura": "Cobertura", "kitnet": "Kitnet", "flat": "Flat", "box": "Box",
    "garagem": "Garagem", "vaga de garagem": "Vaga de Garagem", "estacionamento": "Estacionamento", "outro": "Outro", "outros": "Outro", "industrial": "Industrial", "área": "Área", "area": "Área", "imóvel rural": "Rural", "imovel rural": "Rural", "imovel": "Outro",
}
#: Words of each category, in the order in which they are tried. Fixed values.
VARIANTS = [
    ("Apartamento", "apartamento|apto|ap|flat|kitnet|kitinete|studio|cobertura|duplex|triplex|loft"), ("Casa", "casa|residência|residencia|sobrado|casa térrea|casa terrea|bangalô|bangalo|edícula|edicula"),
    ("Terreno", "terreno|lote|gleba|área|area|fração de terra|fracao de terra"), ("Comercial", "comercial|ponto comercial|imóvel comercial|imovel comercial|estabelecimento"),
    ("Galpão", "galpão|galpao|barracão|barracao|armazém|armazem|depósito|deposito|pavilhão|pavilhao"), ("Fazenda", "fazenda|hacienda|estância|estancia"), ("Sítio", "sítio|sitio"), ("Chácara", "chácara|chacara"),
    ("Sala Comercial", "sala comercial|sala|conjunto comercial|escritório|escritorio"), ("Loja", "loja|box|quiosque"), ("Prédio", "prédio|predio|edifício|edificio"), ("Garagem", "garagem|vaga de garagem|vaga|estacionamento"),
    ("Imóvel Rural", "imóvel rural|imovel rural|rural|propriedade rural"),
]
#: Five groups, told by any of their words. Fixed values.
GROUPS = [
    ("Apartamento", "apartamento|apto|flat|cobertura|kitnet|loft"), ("Casa", "casa|sobrado|residência|residencia|chácara|chacara|sítio|sitio|fazenda"),
    ("Comercial", "comercial|loja|sala|galpão|galpao|prédio|predio|escritório|escritorio|ponto"), ("Terreno", "terreno|lote|área|area|gleba"), ("Estacionamento", "garagem|vaga|estacionamento|box"),
]
#: Words of the bank's category and sale fields. Fixed values.
BANK_CATEGORIES = [("Apartamento", "apartamento"), ("Casa", "casa"), ("Terreno", "terreno"), ("Comercial", "comercial|loja")]
BANK_SALES = [("Extrajudicial", "extrajudicial"), ("Judicial", "judicial"), ("Venda Direta", "venda direta")]
#: Finer categories under those of the catalog. Fixed values.
CATALOG = {
    "Apartamento": "Apartamento", "Casa": "Casa", "Terreno": "Terreno", "Comercial": "Comercial", "Galpão": "Comercial", "Fazenda": "Rural", "Sítio": "Rural", "Chácara": "Rural", "Sala Comercial": "Comercial",
    "Loja": "Comercial", "Prédio": "Comercial", "Garagem": "Estacionamento", "Imóvel Rural": "Rural",
}
#: What a title says, as whole words, in this order. Fixed values.
TITLE_WORDS = [
    ("Casa", "casa|sobrado|residência|residencia|chácara|chacara|sítio|sitio"), ("Apartamento", "apartamento|apto|flat|cobertura|kitnet|loft|studio"), ("Terreno", "terreno|lote|gleba"),
    ("Comercial", "comercial|loja|sala comercial|galpão|galpao|escritório|escritorio|prédio comercial|predio comercial"),
]


def _lookup(c: Column, known: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[c]


def first_group(c: Column, groups: list[tuple[str, str]], otherwise: str | None) -> Column:
    """The first group one of whose words is anywhere in the text."""
    s, out = F.lower(F.coalesce(c, F.lit(""))), F
    for name, words in groups:
        out = out.when(s.rlike(words), name)
    return out.otherwise(otherwise)


def plain_category(c: Column) -> Column:
    """By the table of spellings, else as it is with capitals; nothing is Outro."""
    s = F.lower(F.trim(c))
    return F.when(F.coalesce(s, F.lit("")).isin("", "none"), "Outro").otherwise(F.coalesce(_lookup(s, PLAIN_NAMES), title_every_letter(F.trim(c))))


def variant_category(c: Column) -> Column:
    """By a word itself, else by the first word that holds the text or is held by it."""
    s = F.lower(F.trim(c))
    words = [(w, name) for name, all_words in VARIANTS for w in all_words.split("|")]
    table = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(n).alias("n")) for w, n in words))
    partly = F.get(F.filter(table, lambda x: F.contains(s, x["w"]) | F.contains(x["w"], s)), 0)["n"]
    return F.when(F.coalesce(s, F.lit("")) == "", "Outro").otherwise(F.coalesce(_lookup(s, dict(words)), partly, F.lit("Outro")))


def grouped_category(c: Column) -> Column:
    return first_group(c, GROUPS, "Outros")


def bank_category(c: Column) -> Column:
    return first_group(c, BANK_CATEGORIES, "Outro")


def bank_sale(c: Column) -> Column:
    return first_group(c, BANK_SALES, "Extrajudicial")


def catalog_category(c: Column) -> Column:
    return F.coalesce(_lookup(c, CATALOG), F.lit("Outro"))


def inferred_category(category: Column, title: Column, description: Column) -> Column:
    """A category that is missing or Outro, from the words of title and description."""
    text = F.concat_ws(" ", title, description)
    return F.when(category.isNotNull() & (category != "Outro"), category).otherwise(first_group(text, GROUPS, "Outro"))


def title_category(title: Column) -> Column:
    """What the title's whole words say; null where they say nothing."""
    s, out = F.lower(title), F
    for name, words in TITLE_WORDS:
        out = out.when(s.rlike(rf"(?U)\b({words})\b"), name)
    return out.otherwise(F.lit(None).cast("string"))
