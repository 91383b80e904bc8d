"""Dates out of text. The clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values; the first three letters of a month stand for it, too.
MONTHS = {"janeiro": 1, "fevereiro": 2, "março": 3, "marco": 3, "abril": 4, "maio": 5, "junho": 6, "julho": 7, "agosto": 8, "setembro": 9, "outubro": 10, "novembro": 11, "dezembro": 12}
ISO = r"(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{2}))?"
SLASHED = r"(?<!\d)(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})(?!\d)(?:\D{1,12}?(\d{1,2})[:h](\d{2}))?"
_MONTH = "|".join(sorted(MONTHS, key=len, reverse=True)) + "|" + "|".join(sorted({m[:3] for m in MONTHS}))
LONG = rf"(?i)(\d{{1,2}})\s+(?:de\s+)?({_MONTH})\.?\s+(?:de\s+)?(\d{{4}})(?:\D{{1,12}}?(\d{{1,2}})[:h](\d{{2}}))?"


def _number(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group).try_cast("int")


def _stamp(year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    text = F.format_string("%04d-%02d-%02d %02d:%02d:00", year, month, day, F.coalesce(hour, F.lit(0)), F.coalesce(minute, F.lit(0)))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), text).try_cast("timestamp_ntz")


def parse_date(c: Column, as_of: Column | None = None) -> Column:
    """The first that is found of: ISO, "3 de maio de 2025", day/month/year (two
    digits: of this century), or with as_of a countdown such as "2d 3h 10m"."""
    month = F.element_at(F.create_map(*(x for k, v in ({m[:3]: n for m, n in MONTHS.items()}).items() for x in (F.lit(k), F.lit(v)))), F.left(F.lower(F.regexp_extract(c, LONG, 2)), F.lit(3)))
    year = _number(c, SLASHED, 3)
    found = [
        _stamp(_number(c, ISO, 1), _number(c, ISO, 2), _number(c, ISO, 3), _number(c, ISO, 4), _number(c, ISO, 5)),
        _stamp(_number(c, LONG, 3), month, _number(c, LONG, 1), _number(c, LONG, 4), _number(c, LONG, 5)),
        _stamp(F.when(year < 100, year + 2000).otherwise(year), _number(c, SLASHED, 2), _number(c, SLASHED, 1), _number(c, SLASHED, 4), _number(c, SLASHED, 5)),
    ]
    if as_of is not None:
        part = lambda unit: F.coalesce(_number(c, rf"(?i)(\d+)\s*{unit}", 1), F.lit(0))
        days, hours, minutes = part(r"d(?:ias?)?\b"), part(r"h(?:oras?)?\b"), part(r"m(?:in(?:utos?)?)?\b")
        some = (days + hours + minutes) > 0
        found.append(F.when(some, as_of.cast("timestamp_ntz") + F.make_dt_interval(days, hours, minutes)))
    return F.coalesce(*found)


def all_dates(c: Column) -> Column:
    """Every day/month/year or ISO date in a text, in order, once each."""
    slashed = F.transform(F.regexp_extract_all(c, F.lit(r"\d{1,2}[/.-]\d{1,2}[/.-]\d{4}|\d{4}-\d{2}-\d{2}"), F.lit(0)), lambda x: parse_date(x))
    return F.array_distinct(F.filter(slashed, lambda x: x.isNotNull()))


def auction_dates(c: Column) -> Column:
    """First and second auction dates by label, else by order."""
    label = lambda n, word: F.regexp_extract(c, rf"(?is)(?:{n}[ºªo]|{word})\s*(?:leil[aã]o|pra[cç]a)\D{{0,30}}(\d{{1,2}}/\d{{1,2}}/\d{{4}})", 1)
    dates = all_dates(c)
    return F.struct(
        F.coalesce(parse_date(label(1, "primeir[oa]")), F.get(dates, 0)).alias("first"), F.coalesce(parse_date(label(2, "segund[oa]")), F.get(dates, 1)).alias("second")
    )


def canonical_date(c: Column) -> Column:
    """A whole text that is a date (ISO, or day/month/year or day-month-year, with
    hours or without) as yyyy-MM-dd HH:mm:ss; anything else gives null."""
    s = F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*às\s*", " "), r"\s+", " "))
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?"), F.replace(F.left(s, F.lit(19)), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz"))
    day = r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4})(?: (\d{1,2}):(\d{2})(?::(\d{2}))?)?$"
    part = lambda i: F.regexp_extract(s, day, i).try_cast("int")
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", part(4), part(3), part(1), F.coalesce(part(5), F.lit(0)), F.coalesce(part(6), F.lit(0)), F.coalesce(part(7), F.lit(0)))
    return F.date_format(F.coalesce(iso, F.when(s.rlike(day), text).try_cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")
