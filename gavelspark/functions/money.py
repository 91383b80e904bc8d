"""Money, discounts and areas out of text. Unreadable text gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let


#: Digits, with groups of three after dots and decimals after a comma, or neither.
_USUAL = r"^[0-9]{1,3}(?:\.[0-9]{3})*,[0-9]+$|^[0-9]+(?:,[0-9]{1,2})?$"


def parse_money(c: Column) -> Column:
    """The last of two kinds of separators marks decimals; a lone dot or comma
    marks them unless exactly three digits follow it (then it groups
    thousands; a lone comma with three digits too)."""
    raw = F.replace(F.coalesce(c, F.lit("")), F.lit("&#36;"), F.lit("$"))
    return let(F.regexp_replace(F.regexp_replace(raw, r"[^0-9.,-]", ""), r"^[.,]+|[.,]+$", ""), amount)


def amount(s: Column) -> Column:
    """The number that digits with separators write; s is evaluated more than once."""
    comma, dot = F.length(s) - F.locate(",", F.reverse(s)), F.length(s) - F.locate(".", F.reverse(s))
    both = s.contains(",") & s.contains(".")
    brazilian = F.translate(s, ",.", ".")
    return (
        F.when(both & (comma > dot), brazilian)
        .when(both, F.replace(s, F.lit(","), F.lit("")))
        .when(s.rlike(r"^-?[0-9]{1,3}([.,][0-9]{3})+$"), F.translate(s, ",.", ""))
        .when(s.contains(","), brazilian)
        .otherwise(s)
    ).try_cast("double")


def positive_money(c: Column) -> Column:
    v = parse_money(c)
    return F.when(v > 0, v)


def discount(evaluation: Column, price: Column, places: int = 2) -> Column:
    """Per cent below the evaluation, at least 0, rounded half up in decimals."""
    e, p = evaluation.cast("decimal(18,2)"), price.cast("decimal(18,2)")
    share = F.try_divide((e - p) * 100, e)
    return F.when(e > 0, F.greatest(F.round(share, places), F.lit(0).cast("decimal(3,0)")).cast("double"))


def parse_percent(c: Column) -> Column:
    v = F.replace(F.regexp_extract(c, r"(-?[0-9]+(?:[.,][0-9]+)?)\s*%?", 1), F.lit(","), F.lit("."))
    return v.try_cast("double")


def valid_discount(c: Column) -> Column:
    return F.when((c >= 0) & (c <= 100), c)


def parse_area(c: Column) -> Column:
    """Square metres; hectares times 10,000."""
    v = parse_money(F.regexp_extract(F.lower(c), r"([0-9][0-9.,]*)\s*(m2|m²|ha|hectares?)?", 1))
    return F.when(F.lower(c).rlike(r"[0-9]\s*(ha|hectares?)\b"), v * 10000).otherwise(v)


def _written(digits: Column) -> Column:
    """The number that a run of digits, dots and commas writes; in the usual way without further looks."""
    return F.when(digits.rlike(_USUAL), F.translate(digits, ",.", ".").try_cast("double")).otherwise(let(F.rtrim(digits, F.lit(".,")), amount))


def prices_in(c: Column) -> Column:
    """All amounts after R$ in a text, in order."""
    return F.array_compact(F.transform(F.regexp_extract_all(c, F.lit(r"R\$\s*([0-9][0-9.,]*)"), F.lit(1)), _written))


#: What announces a value, and the value's name; at most forty other characters stand before R$. Fixed values.
_LABELS = {"evaluation": "avalia[cç][aã]o", "minimum": "lance m[ií]nimo", "first": r"(?:1[ºªo]|primeir[oa])\s*(?:leil[aã]o|pra[cç]a)", "second": r"(?:2[ºªo]|segund[oa])\s*(?:leil[aã]o|pra[cç]a)"}


def labelled_prices(c: Column) -> Column:
    """Appraisal, first and second auction values by their labels; where no label is found, the largest amount is first and the smallest second."""

    def labelled(text: Column) -> Column:
        after = {name: _written(F.regexp_extract(text, rf"(?is){label}[^0-9R]{{0,40}}R\$\s*([0-9][0-9.,]*)", 1)) for name, label in _LABELS.items()}
        return F.struct(prices_in(text).alias("all"), *(v.alias(name) for name, v in after.items()))

    def chosen(p: Column) -> Column:
        low = F.when(F.size(p["all"]) > 1, F.array_min(p["all"]))
        return F.struct(p["evaluation"], p["minimum"], F.coalesce(p["first"], F.array_max(p["all"])).alias("first"), F.coalesce(p["second"], low).alias("second"))

    return let(let(c, labelled), chosen)


def value_similarity(a: Column, b: Column) -> Column:
    """By relative distance: within 10 per cent 1, 20 .8, 30 .6, 50 .4, else .2; .5 where one is missing or 0."""
    off = F.abs(a - b) / F.greatest(a, b)
    return F.when(a.isNull() | b.isNull() | (a == 0) | (b == 0), 0.5).when(off <= 0.1, 1.0).when(off <= 0.2, 0.8).when(off <= 0.3, 0.6).when(off <= 0.5, 0.4).otherwise(0.2)


def clean_discount(c: Column) -> Column:
    """A number up to 1 is a share, up to 100 a percentage; else null."""
    v = c.cast("double")
    return F.when((v > 0) & (v <= 1), v * 100).when((v > 1) & (v <= 100), v)


def reais(cents: Column) -> Column:
    return (cents.cast("decimal(18,0)") / 100).cast("double")


def cents(value: Column) -> Column:
    """Half up, in decimals."""
    return F.round(value.cast("decimal(18,4)") * 100, 0).cast("long")


def script_price(html: Column) -> Column:
    """The number that a page's script assigns to its price, else the first amount after R$."""
    own = F.nullif(F.regexp_extract(html, r"(?i)\b(?:preco|price|valor)\s*[:=]\s*[\"']?([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")
    return F.coalesce(own, F.get(prices_in(html), 0))
