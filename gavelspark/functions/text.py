"""Text expressions: accents, Portuguese title case, slugs, markup, addresses.
Each takes and returns Columns; a null stays null unless said otherwise."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and without; small words that stay in lower case inside a name. Fixed values.
MARKED = "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
PLAIN = "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN"
PARTICLES = ["de", "da", "do", "das", "dos", "e", "em", "na", "no", "nas", "nos", "para", "com"]


def fold_accents(c: Column) -> Column:
    return F.translate(c, MARKED, PLAIN)


def squeeze(c: Column) -> Column:
    """Trimmed, with single spaces."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def title_case(c: Column) -> Column:
    """Words with a capital, but for particles that are not first."""
    words = F.split(F.lower(squeeze(c)), " ")
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*PARTICLES), w).otherwise(capital(w))), " ")


def title_every_letter(c: Column) -> Column:
    """A capital after anything that is no letter, as for o'neil or d-4x."""
    letters = F.filter(F.split(F.lower(c), ""), lambda x: x != "")
    return F.aggregate(
        letters, F.struct(F.lit("").alias("out"), F.lit(False).alias("inside")),
        lambda s, x: F.struct(F.concat(s["out"], F.when(s["inside"], x).otherwise(F.upper(x))).alias("out"), x.rlike(r"^\p{L}$").alias("inside")),
        lambda s: s["out"],
    )


def city_name(c: Column) -> Column:
    """A city without a trailing state code, in title case."""
    return title_case(F.regexp_replace(F.trim(c), r"\s*[-/,]\s*[A-Za-z]{2}$", ""))


#: Cities as they are written, by their names without accents. Fixed values.
CITY_SPELLINGS = [
    "São Paulo", "Rio de Janeiro", "Belo Horizonte", "Porto Alegre", "São José dos Campos", "São Bernardo do Campo", "Santo André", "São Caetano do Sul", "Ribeirão Preto", "Uberlândia", "Contagem", "Juiz de Fora",
    "Joinville", "Florianópolis", "Curitiba", "Goiânia", "Brasília", "Salvador", "Fortaleza", "Recife", "Manaus", "Belém", "Guarulhos", "Campinas", "Osasco", "Niterói", "Maceió", "Natal", "Teresina", "Campo Grande",
    "João Pessoa", "Cuiabá", "Aracaju", "Vitória", "São Luís", "Porto Velho", "Macapá", "Boa Vista", "Rio Branco", "Palmas",
]
_NAME_PARTICLES = ("de", "da", "do", "das", "dos", "e", "em", "na", "no", "nas", "nos")


def name_case(c: Column, particles: tuple[str, ...] = _NAME_PARTICLES) -> Column:
    """Words with one capital, the first letter, but for particles that are not first; blank text is empty, null null."""
    words = F.split(F.lower(squeeze(c)), " ")
    capital = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*particles), w).otherwise(capital(w))), " ")


def city_accented(c: Column) -> Column:
    """A known city with its accents, whatever its case, if it is written without them; else as name_case."""
    bare = [("".join(x for x in unicodedata.normalize("NFD", name) if not unicodedata.combining(x)).upper(), name) for name in CITY_SPELLINGS]
    known = F.create_map(*(F.lit(x) for pair in bare for x in pair))
    return F.when(F.length(c) > 0, F.coalesce(known[F.upper(squeeze(c))], name_case(c)))


#: UTF-8 read as Latin-1, and what it stands for, in the order in which it is mended. Fixed values.
MOJIBAKE = [("Â²", "²"), ("Â", ""), ("Ã³", "ó"), ("Ã£", "ã"), ("Ã©", "é"), ("Ã\u00ad", "í"), ("Ãº", "ú"), ("Ã§", "ç"), ("Ã¡", "á"), ("Ãª", "ê"), ("Ã´", "ô"), ("Ã", "À")]


def mended_text(c: Column) -> Column:
    """Entities as characters, wrong encodings mended, no tags, one space between words; null is empty."""
    out = F.coalesce(c, F.lit(""))
    for entity in [e for e in ENTITIES if e != "&amp;"] + ["&amp;"]:
        out = F.replace(out, F.lit(entity), F.lit(ENTITIES[entity]))
    for wrong, right in MOJIBAKE:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return squeeze(F.regexp_replace(out, "<[^>]+>", " "))


def slug(c: Column, most: int = 80) -> Column:
    words = F.trim(F.regexp_replace(fold_accents(F.lower(c)), "[^a-z0-9]+", " "))
    return F.replace(F.trim(F.left(words, F.lit(most))), F.lit(" "), F.lit("-"))


#: Fixed values.
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&#36;": "$"}


def clean_markup(c: Column) -> Column:
    """Text without tags and with the common entities as characters; `&amp;` last, so nothing is decoded twice."""
    out = F.regexp_replace(c, "<[^>]*>", " ")
    for entity in [e for e in ENTITIES if e != "&amp;"] + ["&amp;"]:
        out = F.replace(out, F.lit(entity), F.lit(ENTITIES[entity]))
    return squeeze(out)


#: Street words as they are shortened for keys, in this order. Fixed values.
SHORT = [
    ("rua", "r"), ("avenida", "av"), ("travessa", "tv"), ("praça", "pc"), ("estrada", "estr"), ("rodovia", "rod"), ("número", "n"), ("nº", "n"), ("apartamento", "apto"), ("apt", "apto"),
    ("bloco", "bl"), ("edifício", "ed"), ("condomínio", "cond"), ("conjunto", "conj"), ("quadra", "qd"), ("lote", "lt"), ("sala", "sl"), ("andar", "and"),
]
#: Short forms as they are written out for comparison, in this order. Fixed values.
LONG = [
    ("av", "avenida"), ("r", "rua"), ("pca", "praca"), ("trav", "travessa"), ("al", "alameda"), ("rod", "rodovia"), ("est", "estrada"), ("lgo", "largo"), ("pq", "parque"), ("jd", "jardim"), ("vl", "vila"),
    ("conj", "conjunto"), ("cond", "condominio"), ("ed", "edificio"), ("edif", "edificio"), ("apto?", "apartamento"), ("lt", "lote"), ("qd", "quadra"), ("bl", "bloco"),
]


def short_address(c: Column) -> Column:
    """For keys: lower case, street words in short form, then without marks."""
    out = F.trim(F.lower(c))
    for long, short in SHORT:
        out = F.regexp_replace(out, rf"(?U)\b{long}\b", short)
    return squeeze(F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"[^\p{L}\p{N}_\s]", ""))


def long_address(c: Column) -> Column:
    """For comparison: lower case, no accents, street words written out, then without marks."""
    out = fold_accents(F.trim(F.lower(c)))
    for short, long in LONG:
        out = F.regexp_replace(out, rf"\b{short}\b\.?", long)
    out = F.regexp_replace(out, r"\bn(?:um|r)?\b[°º.]?\s*(?=\d|o?\s)", "numero ")
    return squeeze(F.regexp_replace(out, "[^a-z0-9_ ]", " "))


#: Fixed values.
STREET_TYPES = ["rua", "avenida", "alameda", "travessa", "praca", "largo", "rodovia", "estrada"]


def address_parts(c: Column) -> Column:
    """street_type, street_name and number of an address, after long_address."""
    s = long_address(c)
    kind = F.regexp_extract(s, rf"\b({'|'.join(STREET_TYPES)})\b", 1)
    number = F.regexp_extract(s, r"numero (\d+)", 1)
    name = F.regexp_extract(s, rf"\b(?:{'|'.join(STREET_TYPES)}) (.+?)(?: numero| \d|$)", 1)
    return F.struct(F.nullif(kind, F.lit("")).alias("street_type"), F.nullif(name, F.lit("")).alias("street_name"), F.nullif(F.when(number != "", number).otherwise(F.regexp_extract(s, r"\b(\d{1,5})\b", 1)), F.lit("")).alias("number"))


def assembled_address(street: Column, number: Column, extra: Column, district: Column) -> Column:
    """The parts that are there, with commas; a district after a dash."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws(", ", some(street), some(number), some(extra), F.concat(F.lit("- "), some(district)))


def without_prefix(title: Column) -> Column:
    """A title without what sites put before it, and what stands after its first dash."""
    s = F.regexp_replace(F.trim(title), r"(?i)^(leil[aã]o( de)?|lote \d+|im[oó]vel)\s*[:-]\s*", "")
    return F.struct(F.trim(F.regexp_extract(s, r"^(.*?)(?: - |$)", 1)).alias("title"), F.nullif(F.trim(F.regexp_extract(s, r"^.*? - (.*)$", 1)), F.lit("")).alias("where"))


def pt_number(c: Column, places: int = 2) -> Column:
    """1234.5 as 1.234,50."""
    return F.translate(F.format_number(c, places), ",.", ".,")


def compact_number(c: Column) -> Column:
    """1.2k and 3.4M, in decimals, half up; null: N/A."""
    d = c.cast("decimal(18,2)")
    short = lambda by, sign: F.concat(F.round(d / by, 1).cast("decimal(18,1)").cast("string"), F.lit(sign))
    return F.when(c.isNull(), "N/A").when(c >= 1_000_000, short(1_000_000, "M")).when(c >= 1_000, short(1_000, "k")).otherwise(c.cast("long").cast("string"))


def geocodable(address: Column) -> Column:
    """(valid, reason): an address that a geocoder can use."""
    a = F.lower(F.coalesce(address, F.lit("")))
    return (
        F.when(F.length(F.trim(a)) < 10, F.struct(F.lit(False).alias("valid"), F.lit("too_short").alias("reason")))
        .when(a.rlike("desconto|oportunidade|clique|leilão online|ocupado"), F.struct(F.lit(False).alias("valid"), F.lit("promotional").alias("reason")))
        .when(a.rlike("escritório do leiloeiro|sede do leiloeiro"), F.struct(F.lit(False).alias("valid"), F.lit("office").alias("reason")))
        .otherwise(F.struct(F.lit(True).alias("valid"), F.lit("ok").alias("reason")))
    )


def clean_for_geocoding(c: Column) -> Column:
    """Without unit, block and postcode parts."""
    out = F.regexp_replace(c, r"(?i)\b(apto|apartamento|bloco|bl|unidade|sala|casa)\.?\s*\w+", "")
    out = F.regexp_replace(out, r"\b\d{5}-?\d{3}\b", "")
    return F.regexp_replace(squeeze(F.regexp_replace(out, r"\s*,(\s*,)+", ",")), r"^[,\s]+|[,\s]+$", "")


def listing_title(category: Column, neighborhood: Column, city: Column, state: Column) -> Column:
    blank = lambda c: F.when(is_blank(c), None).otherwise(F.trim(c))
    return F.concat_ws(" - ", F.concat_ws(" em ", F.coalesce(blank(category), F.lit("Imóvel")), blank(neighborhood)), F.concat_ws("/", blank(city), blank(state)))
