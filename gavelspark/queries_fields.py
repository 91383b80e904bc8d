"""Normalisers over the messy fields of all orders, each with SQL that states its rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .functions import categories, dates, geo, money, places, text, urls
from .operators import dedup, discovery, filters, lifecycle, lookup, reports
from .plans.listings import LISTINGS_SQL, listings
from .plans.messy import messy, messy_sql
from .registry import query
from .sources import bank_csv, html_items, json_items


def each(name: str, field: str, expression: Callable[[Column], Column], sql: str | None) -> None:
    """Register `name`: key and expression(field) as result; sql: the same over column x."""
    own = None if sql is None else f"SELECT key, {sql} AS result FROM (SELECT key, {field} AS x FROM messy)"
    query(own, messy_sql(field), name)(lambda spark, sf_dir: messy(spark, sf_dir, field).select("key", expression(F.col(field)).alias("result")))


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _case(rules: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in rules) + f" ELSE {otherwise} END"


def _ladder(groups: list[tuple[str, str]], x: str, otherwise: str, pattern: str = "({})") -> str:
    return _case([(f"regexp_matches(coalesce({x}, ''), '{pattern.format(words)}')", f"'{name}'") for name, words in groups], otherwise)


_FOLD = f"translate({{}}, '{text.MARKED}', '{text.PLAIN}')"
_SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"

# --- money, areas, shares ---

_NUMBER = r"""CASE WHEN contains({s}, ',') AND contains({s}, '.') AND strpos(reverse({s}), ',') < strpos(reverse({s}), '.') THEN replace(replace({s}, '.', ''), ',', '.') WHEN contains({s}, ',') AND contains({s}, '.') THEN replace({s}, ',', '')
 WHEN regexp_full_match({s}, '-?[0-9]{{1,3}}([.,][0-9]{{3}})+') THEN regexp_replace({s}, '[.,]', '', 'g') WHEN contains({s}, ',') THEN replace({s}, ',', '.') ELSE {s} END"""


def _money(x: str) -> str:
    clean = rf"regexp_replace(regexp_replace(replace(coalesce({x}, ''), '&#36;', '$'), '[^0-9.,-]', '', 'g'), '^[.,]+|[.,]+$', '', 'g')"
    return "(SELECT TRY_CAST(" + _NUMBER.format(s="s") + f" AS DOUBLE) FROM (SELECT {clean} AS s))"


each("money_parse", "money", money.parse_money, _money("x"))
each("positive_money", "money", money.positive_money, f"(SELECT CASE WHEN v > 0 THEN v END FROM (SELECT {_money('x')} AS v))")
_AREA = r"regexp_extract(lower(x), '([0-9][0-9.,]*)\s*(m2|m²|ha|hectares?)?', 1)"
each("area_parse", "area", money.parse_area, rf"{_money(_AREA)} * CASE WHEN regexp_matches(lower(x), '[0-9]\s*(ha|hectares?)(\W|$)') THEN 10000 ELSE 1 END")
each("percent_parse", "percent", money.parse_percent, r"TRY_CAST(replace(regexp_extract(x, '(-?[0-9]+([.,][0-9]+)?)', 1), ',', '.') AS DOUBLE)")
each("discount_cleaned", "percent", lambda c: money.clean_discount(money.parse_percent(c)), r"(SELECT CASE WHEN v > 0 AND v <= 1 THEN v * 100 WHEN v > 1 AND v <= 100 THEN v END FROM (SELECT TRY_CAST(replace(regexp_extract(x, '(-?[0-9]+([.,][0-9]+)?)', 1), ',', '.') AS DOUBLE) AS v))")


def _label(words: str) -> str:
    return f"{_money('nullif(regexp_extract(x, ' + chr(39) + '(?is)' + words + '[^0-9R]{0,40}R[$] ?([0-9][0-9.,]*)' + chr(39) + ', 1), ' + chr(39) * 2 + ')')}"


_AMOUNTS = "list_filter(list_transform(regexp_extract_all(x, 'R[$] ?([0-9][0-9.,]*)', 1), lambda v: CAST(replace(replace(v, '.', ''), ',', '.') AS DOUBLE)), lambda v: v IS NOT NULL)"


@query(f"""SELECT key, {_label('avalia[cç][aã]o')} AS evaluation, {_label('lance m[ií]nimo')} AS minimum, coalesce({_label('(?:1[ºªo]|primeir[oa]) *(?:leil[aã]o|pra[cç]a)')}, list_max({_AMOUNTS})) AS first,
  coalesce({_label('(?:2[ºªo]|segund[oa]) *(?:leil[aã]o|pra[cç]a)')}, CASE WHEN len({_AMOUNTS}) > 1 THEN list_min({_AMOUNTS}) END) AS second FROM (SELECT key, notice AS x FROM messy)""", messy_sql("notice"))
def labelled_prices(spark, sf_dir):
    return messy(spark, sf_dir, "notice").select("key", money.labelled_prices(F.col("notice")).alias("p")).select("key", "p.*")


each("script_prices", "page", money.script_price, r"TRY_CAST(regexp_extract(x, 'preco = ([0-9]+[.][0-9]+)', 1) AS DOUBLE)")


@query("SELECT key, CAST(key * 7 % 100000 / 100.0 AS DOUBLE) AS reais, key * 7 % 100000 AS cents, CASE WHEN key % 3000000 >= 1000000 THEN CAST(CAST(round(CAST(key % 3000000 AS DECIMAL(18,2)) / 1000000, 1) AS DECIMAL(18,1)) AS VARCHAR) || 'M' WHEN key % 3000000 >= 1000 THEN CAST(CAST(round(CAST(key % 3000000 AS DECIMAL(18,2)) / 1000, 1) AS DECIMAL(18,1)) AS VARCHAR) || 'k' ELSE CAST(key % 3000000 AS VARCHAR) END AS short, translate(format('{:,.2f}', CAST(key * 1.25 AS DOUBLE)), ',.', '.,') AS long FROM messy", messy_sql("area"))
def number_formats(spark, sf_dir):
    k = F.col("key")
    r = money.reais(k * 7 % 100000)
    return messy(spark, sf_dir).select("key", r.alias("reais"), money.cents(r).alias("cents"), text.compact_number(k % 3000000).alias("short"), text.pt_number((k * 1.25).cast("double")).alias("long"))


# --- dates ---

_DAY = r"try_strptime(lpad(regexp_extract(x, '([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})', 1), 2, '0') || '-' || lpad(regexp_extract(x, '([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})', 2), 2, '0') || '-' || regexp_extract(x, '([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4})', 3), '%d-%m-%Y')"
_CLOCK = "to_minutes(CAST(coalesce(TRY_CAST(regexp_extract(x, '([0-9]{1,2})[:h]([0-9]{2})', 1) AS INTEGER), 0) * 60 + coalesce(TRY_CAST(regexp_extract(x, '([0-9]{1,2})[:h]([0-9]{2})', 2) AS INTEGER), 0) AS INTEGER))"
each("date_parse", "day_text", dates.parse_date, f"{_DAY} + {_CLOCK}")
each("iso_dates", "iso_text", dates.parse_date, "TRY_CAST(left(x, 10) AS TIMESTAMP) + to_minutes(CAST(CASE WHEN x LIKE '%T10:20%' THEN 620 WHEN x LIKE '% 08:15%' THEN 495 ELSE 0 END AS INTEGER))")
_MONTHS = "CASE lower(regexp_extract(x, '[A-Za-zç]{3,}')) " + " ".join(f"WHEN '{m}' THEN {n}" for m, n in {**dates.MONTHS, **{m[:3]: n for m, n in dates.MONTHS.items()}}.items()) + " END"
each("long_dates", "long_date", dates.parse_date, rf"TRY_CAST(regexp_extract(x, '([0-9]{{4}})$', 1) || '-' || lpad(CAST({_MONTHS} AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract(x, '^[0-9]+'), 2, '0') AS TIMESTAMP)")
each("countdowns", "countdown", lambda c: dates.parse_date(c, F.lit("2025-01-01")), "CASE WHEN regexp_extract(x, '([0-9]+)d', 1) || regexp_extract(x, '([0-9]+)h', 1) || regexp_extract(x, '([0-9]+) ?m', 1) <> '000' THEN TIMESTAMP '2025-01-01' + to_days(CAST(regexp_extract(x, '([0-9]+)d', 1) AS INTEGER)) + to_hours(CAST(regexp_extract(x, '([0-9]+)h', 1) AS INTEGER)) + to_minutes(CAST(regexp_extract(x, '([0-9]+) ?m', 1) AS INTEGER)) END")
each("canonical_dates", "day_text", dates.canonical_date, rf"CASE WHEN regexp_full_match(regexp_replace(x, ' às ', ' ', 'g'), '[0-9]{{2}}([/]|-)[0-9]{{2}}([/]|-)[0-9]{{4}}( [0-9]{{2}}:[0-9]{{2}})?') AND x[3] = x[6] THEN strftime({_DAY} + {_CLOCK}, '%Y-%m-%d %H:%M:%S') END")
each("auction_date_labels", "dates_notice", lambda c: F.date_format(dates.auction_dates(c)["second"], "yyyy-MM-dd"), "'2025-06-' || regexp_extract(x, '([0-9]{2})/06/2025', 1)")
each("all_dates", "dates_notice", lambda c: F.array_join(F.transform(dates.all_dates(c), lambda d: F.date_format(d, "MM-dd")), ","), "'05-' || regexp_extract(x, '([0-9]{2})/05/2025', 1) || ',06-' || regexp_extract(x, '([0-9]{2})/06/2025', 1)")

# --- urls and images ---


def _url(keep: str = "FALSE") -> str:
    s = r"regexp_replace(CASE WHEN trim(x) = '' THEN NULL WHEN trim(x) LIKE '//%' THEN 'https:' || trim(x) WHEN regexp_matches(trim(x), '(?i)^https?://') THEN trim(x) ELSE 'https://' || trim(x) END, '#.*$', '')"
    parts = f"list_filter(string_split(regexp_extract(s, '[?](.*)$', 1), '&'), lambda p: p <> '' AND ({keep} OR NOT starts_with(lower(p), 'utm_')))"
    parts = f"list_sort({parts})" if keep == "TRUE" else parts
    return rf"(SELECT lower(regexp_extract(s, '^([A-Za-z]+://[^/?]+)', 1)) || regexp_replace(regexp_extract(s, '^[A-Za-z]+://[^/?]+([^?]*)', 1), '/+$', '') || CASE WHEN len({parts}) > 0 THEN '?' || array_to_string({parts}, '&') ELSE '' END FROM (SELECT {s} AS s))"


each("url_normalize", "url", urls.normalize_url, _url())
each("url_with_tracking", "url", lambda c: urls.normalize_url(c, True), _url("TRUE"))
each("url_host_path", "url", lambda c: urls.host_path(F.trim(c)), r"regexp_replace(lower(regexp_extract(trim(x), '^[A-Za-z]+://([^/?:#]+)', 1)), '^www\.', '') || regexp_replace(regexp_extract(trim(x), '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+$', '')")
each("listing_ids", "url", lambda c: urls.listing_id(F.trim(c)), r"CASE WHEN regexp_extract(trim(x), '(?i)(?:lote|imovel|id|hdnimovel)[/=-]([0-9]+)', 1) <> '' THEN regexp_extract(trim(x), '(?i)(?:lote|imovel|id|hdnimovel)[/=-]([0-9]+)', 1) ELSE list_last(string_split(regexp_replace(regexp_replace(trim(x), '[?#].*$', ''), '/+$', ''), '/')) END")
_SMALL = "coalesce(TRY_CAST(regexp_extract(s, '([0-9]{2,4})x([0-9]{2,4})', 1) AS INTEGER) < 200 OR TRY_CAST(regexp_extract(s, '([0-9]{2,4})x([0-9]{2,4})', 2) AS INTEGER) < 200, FALSE)"
_BLOCKED = rf"(s = '' OR regexp_matches(s, '{urls.BLOCKED_IMAGE}') OR starts_with(s, 'data:') OR regexp_matches(s, '\.svg([?#]|$)') OR {_SMALL} OR NOT regexp_matches(s, '^(https?:)?//|^/'))"
each("image_block", "image", urls.blocked_image, f"(SELECT {_BLOCKED} FROM (SELECT lower(trim(coalesce(x, ''))) AS s))")
each("image_accepted", "image", urls.image_ok, rf"(SELECT NOT {_BLOCKED} AND (regexp_matches(s, '\.(jpe?g|png|webp|gif|avif)([?#].*)?$') OR regexp_matches(s, 'cdn|cloudfront|googleusercontent|amazonaws|/image|/foto|/img')) FROM (SELECT lower(trim(coalesce(x, ''))) AS s))")
_BASE = "https://s.com/x/page.html?q=1"
_HREF = "regexp_replace(x, '[0-9]+$', '')"
each("absolute_urls", "href", lambda c: urls.absolute_url(c, F.lit(_BASE)), _case([(f"{_HREF} = '{a}'", f"'{b}' || regexp_extract(x, '[0-9]+$')") for a, b in (("/a/b", "https://s.com/a/b"), ("c", "https://s.com/x/c"), ("//t.com/d", "https://t.com/d"), ("http://z.com/", "http://z.com/"), ("../img/", "https://s.com/img/"), ("./e", "https://s.com/x/e"), ("?p=", "https://s.com/x/page.html?p="), ("#top", "https://s.com/x/page.html?q=1#top"), ("g/../h/./i", "https://s.com/x/h/i"), ("../../../k", "https://s.com/k"))], "NULL"))
each("valid_source_urls", "url", lambda c: urls.valid_source_url(F.trim(c)), r"coalesce(regexp_matches(trim(x), '(?i)^https?://[^\s/]+\.[^\s]+$') AND NOT regexp_matches(trim(x), '(?i)javascript:|mailto:|localhost|example\.com'), FALSE)")

# --- text, places, categories ---


def _title(x: str) -> str:
    words = f"string_split(lower({_SQUEEZE.format(x)}), ' ')"
    return f"array_to_string(list_transform({words}, lambda w, i: CASE WHEN i > 1 AND list_contains({_list(text.PARTICLES)}, w) THEN w ELSE upper(w[1]) || w[2:] END), ' ')"


each("title_case", "city", text.title_case, _title("x"))
each("city_names", "city", text.city_name, _title(r"regexp_replace(trim(x), '\s*[-/,]\s*[A-Za-z]{2}$', '')"))
each("title_every_letter", "city", text.title_every_letter, "array_to_string(list_transform(string_split(lower(x), ' '), lambda w: array_to_string(list_transform(string_split(w, '/'), lambda v: upper(v[1]) || v[2:]), '/')), ' ')")
_STATE_NAMES = "CASE " + _FOLD.format("lower(trim(x))") + " " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in places.STATE_NAMES.items()) + " ELSE 'XX' END"
each("state_codes", "state", places.state_code, f"CASE WHEN list_contains({_list(places.STATES)}, upper(trim(x))) THEN upper(trim(x)) ELSE {_STATE_NAMES} END")
each("state_short", "state", places.short_state, f"CASE WHEN coalesce(trim(x), '') = '' THEN 'XX' WHEN list_contains({_list(places.STATES)}, upper(trim(x))) OR length(trim(x)) = 2 THEN upper(trim(x)) ELSE {_STATE_NAMES} END")
_LABELS = [(name.lower(), code) for code, name in places.STATE_LABELS.items()]
_PARTLY = "CASE " + " ".join(f"WHEN contains('{n}', lower(s)) OR contains(lower(s), '{n}') THEN '{c}'" for n, c in _LABELS) + " WHEN length(s) >= 2 THEN s[1:2] ELSE '' END"
each("state_named", "state", places.named_state, f"(SELECT CASE WHEN s = '' THEN '' WHEN list_contains({_list(places.STATES)}, s) THEN s ELSE coalesce(CASE lower(s) " + " ".join(f"WHEN '{n}' THEN '{c}'" for n, c in _LABELS) + f" END, {_PARTLY}) END FROM (SELECT upper(trim(coalesce(x, ''))) AS s))")
each("state_prefix", "state", places.state_prefix, f"CASE WHEN list_contains({_list(places.STATES)}, upper(trim(x))[1:2]) THEN upper(trim(x))[1:2] ELSE 'XX' END")
_SPELLED = "CASE lower(trim(coalesce(x, ''))) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in places.CATEGORY_SPELLINGS.items()) + " END"
_PARTS = "CASE " + " ".join(f"WHEN regexp_matches(lower(x), '{w}') THEN '{n}'" for n, w in places.CATEGORY_PARTS) + " ELSE 'Outro' END"
each("category_listing", "category", places.listing_category, f"coalesce({_SPELLED}, {_PARTS})")
each("category_of_title", "title", places.listing_category, f"coalesce({_SPELLED}, {_PARTS})")


def _cased(x: str, particles: str) -> str:
    return f"array_to_string(list_transform(string_split(lower({_SQUEEZE.format(x)}), ' '), lambda w, i: CASE WHEN i > 1 AND list_contains({particles}, w) THEN w ELSE upper(w[1]) || w[2:] END), ' ')"


_SMALL_WORDS = "['de', 'da', 'do', 'das', 'dos', 'e', 'em', 'na', 'no', 'nas', 'nos']"
each("name_case", "address", text.name_case, _cased("x", _SMALL_WORDS))
each("name_case_short", "city", lambda c: text.name_case(c, ("de", "da", "do", "das", "dos", "e")), _cased("x", "['de', 'da', 'do', 'das', 'dos', 'e']"))
each("city_accented", "city", lambda c: text.city_accented(F.translate(c, "ãéâ", "aea")), f"(SELECT CASE WHEN length(y) > 0 THEN coalesce(CASE upper({_SQUEEZE.format('y')}) WHEN 'SAO PAULO' THEN 'São Paulo' WHEN 'CAMPINAS' THEN 'Campinas' WHEN 'RIO DE JANEIRO' THEN 'Rio de Janeiro' WHEN 'SAO JOSE DOS CAMPOS' THEN 'São José dos Campos' WHEN 'BELO HORIZONTE' THEN 'Belo Horizonte' WHEN 'PALMAS' THEN 'Palmas' END, {_cased('y', _SMALL_WORDS)}) END FROM (SELECT translate(x, 'ãéâ', 'aea') AS y))")
_MENDED = "replace(coalesce(x, ''), '&amp;', '&')"
for _wrong, _right in (("Â²", "²"), ("Â", ""), ("Ã³", "ó"), ("Ã£", "ã"), ("Ã©", "é"), ("Ã\u00ad", "í"), ("Ãº", "ú"), ("Ã§", "ç"), ("Ã¡", "á"), ("Ãª", "ê"), ("Ã´", "ô"), ("Ã", "À")):
    _MENDED = f"replace({_MENDED}, '{_wrong}', '{_right}')"
each("mended_text", "broken_text", text.mended_text, _SQUEEZE.format(f"regexp_replace({_MENDED}, '<[^>]+>', ' ', 'g')"))
each("category_map", "title", places.category, "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(x, '')), '(^|[^a-zà-ÿ0-9_])({w})s?([^a-zà-ÿ0-9_]|$)') THEN '{n}'" for n, w in places.CATEGORY_WORDS) + " ELSE 'Outro' END")
_PLAIN = "CASE lower(trim(x)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in categories.PLAIN_NAMES.items()) + " END"
each("category_plain", "category", categories.plain_category, f"CASE WHEN coalesce(lower(trim(x)), '') IN ('', 'none') THEN 'Outro' ELSE coalesce({_PLAIN}, array_to_string(list_transform(string_split(lower(trim(x)), ' '), lambda w: upper(w[1]) || w[2:]), ' ')) END")
_WORDS = [(w, n) for n, ws in categories.VARIANTS for w in ws.split("|")]
_EXACT = "CASE lower(trim(x)) " + " ".join(f"WHEN '{w}' THEN '{n}'" for w, n in _WORDS) + " END"
_PART = "CASE " + " ".join(f"WHEN contains(lower(trim(x)), '{w}') OR contains('{w}', lower(trim(x))) THEN '{n}'" for w, n in _WORDS) + " ELSE 'Outro' END"
each("category_variants", "category", categories.variant_category, f"CASE WHEN coalesce(trim(x), '') = '' THEN 'Outro' ELSE coalesce({_EXACT}, {_PART}) END")
each("category_groups", "category", categories.grouped_category, _ladder(categories.GROUPS, "lower(x)", "'Outros'"))
each("category_bank", "title", categories.bank_category, _ladder(categories.BANK_CATEGORIES, "lower(x)", "'Outro'"))
each("sale_bank", "kind", categories.bank_sale, _ladder(categories.BANK_SALES, "lower(x)", "'Extrajudicial'"))
each("category_catalog", "category", lambda c: categories.catalog_category(categories.variant_category(c)), "CASE " + f"CASE WHEN coalesce(trim(x), '') = '' THEN 'Outro' ELSE coalesce({_EXACT}, {_PART}) END " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in categories.CATALOG.items()) + " ELSE 'Outro' END")
each("auction_types", "kind", places.auction_type, _case([("contains(y, 'extrajudicial')", "'Extrajudicial'"), ("contains(y, 'judicial')", "'Judicial'"), ("contains(y, 'venda direta')", "'Venda Direta'"), ("regexp_matches(y, 'sfi|fiduci')", "'Leilão SFI'")], "'Outros'").replace("y,", _FOLD.format("lower(coalesce(x, ''))") + ","))
each("occupancy_flags", "occupancy", places.occupancy, "CASE WHEN regexp_matches(lower(x), 'desocupad|vago') THEN 'desocupado' WHEN regexp_matches(lower(x), 'ocupad') THEN 'ocupado' END")
_NOT_WORD = "[^a-zà-ÿ0-9_]"
each("real_estate_filter", "title", lambda c: places.is_estate(c, F.lit("https://s.com/x")), f"CASE WHEN regexp_matches(lower(coalesce(x, '')), '(^|{_NOT_WORD})({places.OTHER_GOODS})s?({_NOT_WORD}|$)') THEN FALSE ELSE TRUE END")
each("place_in_text", "title", lambda c: places.place_in(c)["city"], "CASE WHEN regexp_matches(x, 'PR|SP|MG') THEN trim(regexp_extract(x, '([A-Za-zà-ÿÀ-Ý. ]+?) *[-/] *(PR|SP|MG)', 1)) END")


@query(r"""SELECT key, CASE WHEN location LIKE '%, SP' OR location LIKE '%, PR' THEN right(location, 2) WHEN location LIKE '%- SP' THEN 'SP' WHEN location LIKE '%/MG' THEN 'MG' WHEN regexp_matches(place_url, '/(sp|pr)/') THEN upper(regexp_extract(place_url, '/(sp|pr)/', 1)) END AS state,
  CASE WHEN location LIKE '%, SP' THEN 'Campinas' WHEN location LIKE 'Curitiba, PR' THEN 'Curitiba' WHEN location LIKE '%São Paulo - SP' THEN 'São Paulo' WHEN location LIKE '%/MG' THEN 'Belo Horizonte' WHEN regexp_matches(place_url, '/(sp|pr)/')
  THEN CASE regexp_extract(place_url, '/(?:sp|pr)/([a-z-]+)/', 1) WHEN 'sao-paulo' THEN 'Sao Paulo' WHEN 'curitiba' THEN 'Curitiba' ELSE 'Santo Andre' END END AS city FROM messy""", messy_sql("location", "place_url"))
def place_from_parts(spark, sf_dir):
    return messy(spark, sf_dir, "location", "place_url").select("key", places.place_from(F.col("location"), F.col("place_url")).alias("p")).select("key", "p.state", "p.city")


each("slugs", "city", text.slug, f"trim(regexp_replace({_FOLD.format('lower(x)')}, '[^a-z0-9]+', '-', 'g'), '-')")
each("clean_markup", "markup", text.clean_markup, r"trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', ' '), '&#36;', '$'), '&amp;', '&'), '\s+', ' ', 'g'), '^ | $', '', 'g'))")


def _chain(x: str, pairs: list[tuple[str, str]], pattern: str) -> str:
    for a, b in pairs:
        x = f"regexp_replace({x}, '{pattern.format(a)}', '{b}', 'g')"
    return x


_SHORT = _chain("trim(lower(x))", [p for p in text.SHORT if p[0] != "nº"], r"\b{}\b")
each("address_keys", "address", text.short_address, _SQUEEZE.format(rf"regexp_replace({_SHORT}, '[^\p{{L}}\p{{N}}_\s]', '', 'g')"))
_LONG = _chain(_FOLD.format("trim(lower(x))"), text.LONG, r"\b{}\b\.?")
each("address_long", "address", text.long_address, _SQUEEZE.format(f"regexp_replace(regexp_replace({_LONG}, 'n[.](\\d)', 'numero \\1', 'g'), '[^a-z0-9_ ]', ' ', 'g')"))
each("street_types", "address", lambda c: text.address_parts(c)["street_type"], f"nullif(regexp_extract({_LONG}, '({'|'.join(text.STREET_TYPES)})'), '')")
each("street_numbers", "address", lambda c: text.address_parts(c)["number"], r"nullif(regexp_extract(x, 'n[.]([0-9]+)', 1), '')")


@query(r"SELECT key, CASE WHEN length(trim(coalesce(address, ''))) < 10 THEN 'too_short' WHEN regexp_matches(lower(address), 'desconto|oportunidade|clique|leilão online|ocupado') THEN 'promotional' ELSE 'ok' END AS result FROM messy", messy_sql("address"))
def geocodable_addresses(spark, sf_dir):
    return messy(spark, sf_dir, "address").select("key", text.geocodable(F.col("address"))["reason"].alias("result"))


@query(r"SELECT key, CASE WHEN key % 3 > 0 THEN 'Rua ' || (key % 9) || CASE WHEN key % 2 > 0 THEN ', ' || (key % 50) ELSE '' END || CASE WHEN key % 5 > 0 THEN ', - Centro' ELSE '' END ELSE CASE WHEN key % 2 > 0 THEN (key % 50) || CASE WHEN key % 5 > 0 THEN ', - Centro' ELSE '' END WHEN key % 5 > 0 THEN '- Centro' ELSE '' END END AS result FROM messy", messy_sql("area"))
def assembled_addresses(spark, sf_dir):
    k = F.col("key")
    when = lambda m, c: F.when(k % m > 0, c).otherwise(" ")
    return messy(spark, sf_dir).select("key", text.assembled_address(when(3, F.concat(F.lit("Rua "), k % 9)), when(2, (k % 50).cast("string")), F.lit(None).cast("string"), when(5, F.lit("Centro"))).alias("result"))


_SPLIT_TITLE = r"CASE WHEN key % 4 = 0 THEN 'Leilão de: ' WHEN key % 4 = 1 THEN 'Lote 12 - ' ELSE '' END || title"


@query(r"SELECT key, trim(CASE WHEN contains(title, ' - ') THEN left(title, strpos(title, ' - ') - 1) ELSE title END) AS title, CASE WHEN contains(title, ' - ') THEN trim(substr(title, strpos(title, ' - ') + 3)) END AS place FROM (SELECT key, regexp_replace(title, '(?i)^im[oó]vel\s*[:-]\s*', '') AS title FROM messy)", messy_sql("title"))
def title_parts(spark, sf_dir):
    rows = messy(spark, sf_dir, "title")
    k = F.col("key")
    prefixed = F.when(k % 4 == 0, F.concat(F.lit("Leilão de: "), "title")).when((k % 4 == 1) & ~F.col("title").rlike("(?i)^im[oó]vel *[:-]"), F.concat(F.lit("Lote 12 - "), "title")).otherwise(F.col("title"))
    prefixed = F.when(F.col("title").rlike("(?i)^im[oó]vel *[:-]"), F.col("title")).otherwise(prefixed)
    return rows.select("key", text.without_prefix(prefixed).alias("p")).select("key", "p.title", F.col("p.where").alias("place"))


_PLACES = ", ".join(f"({i}, '{c}', '{s}', {a}, {b}, {str(geo.CAPITALS[s] == c).upper()})" for i, (c, s, a, b) in enumerate(geo.PLACES))


@query("""SELECT key, m.latitude, m.longitude, m.matched FROM (SELECT key, min(struct_pack(rank := CASE WHEN g.city = c THEN 0 WHEN contains(g.city, c) OR contains(c, g.city) THEN 1 ELSE 2 END, n := n, latitude := lat, longitude := lon,
  matched := CASE WHEN g.city IS NULL THEN NULL WHEN g.city = c THEN 'city' WHEN contains(g.city, c) OR contains(c, g.city) THEN 'part' ELSE 'capital' END)) AS m FROM m LEFT JOIN g ON g.state = s AND (contains(g.city, c) OR contains(c, g.city) OR g.capital) GROUP BY key)""",
       messy_sql("city", "state") + f", m AS (SELECT key, trim({_FOLD.format('lower(city)')}) AS c, lower(trim(state)) AS s FROM messy), g(n, city, state, lat, lon, capital) AS (SELECT n, city, state, CAST(lat AS DOUBLE), CAST(lon AS DOUBLE), capital FROM (VALUES {_PLACES}) v(n, city, state, lat, lon, capital))")
def geocode_lookup(spark, sf_dir):
    return lookup.located(messy(spark, sf_dir, "city", "state")).select("key", "latitude", "longitude", "matched")


_TITLE_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(lower(title), '(^|{_NOT_WORD})({w})({_NOT_WORD}|$)') THEN '{n}'" for n, w in categories.TITLE_WORDS) + " END"


@query(f"SELECT key, CASE WHEN key % 7 <> 0 AND said IS DISTINCT FROM category AND said IS NOT NULL THEN said ELSE category END AS category, key % 7 <> 0 AND said IS NOT NULL AND said IS DISTINCT FROM category AS changed FROM (SELECT *, {_TITLE_CATEGORY} AS said FROM messy)", messy_sql("title", "category"))
def reclassified(spark, sf_dir):
    return lifecycle.reclassified(messy(spark, sf_dir, "title", "category").withColumn("is_duplicate", F.col("key") % 7 == 0)).select("key", "category", "changed")


@query(f"SELECT key, CASE WHEN category IS NOT NULL AND category <> 'Outro' AND key % 2 = 0 THEN category ELSE {_ladder(categories.GROUPS, 'lower(concat_ws(chr(32), title, address))', chr(39) + 'Outro' + chr(39))} END AS category FROM messy", messy_sql("title", "category", "address"))
def inferred_categories(spark, sf_dir):
    rows = messy(spark, sf_dir, "title", "category", "address")
    return rows.select("key", categories.inferred_category(F.when(F.col("key") % 2 == 0, F.col("category")).otherwise(F.lit("Outro")), F.col("title"), F.col("address")).alias("category"))


# --- filters and reports over the same fields ---

each("lists_lots", "page", filters.lists_lots, "len(list_filter(" + _list(filters.LISTING_WORDS) + ", lambda w: contains(lower(x), w))) >= 3")


@query(f"SELECT key FROM messy WHERE regexp_matches(lower(coalesce(category, '')), '{filters.ESTATE}') OR regexp_matches(lower(coalesce(title, '')), '{filters.ESTATE}') OR (coalesce(category, '') = '' AND NOT regexp_matches(lower(coalesce(title, '')), '{filters.OTHER}'))", messy_sql("category", "title"))
def estate_items(spark, sf_dir):
    rows = messy(spark, sf_dir, "category", "title")
    return rows.where(filters.of_estate(F.col("category"), F.col("title"))).select("key")


@query(f"SELECT count(*) AS total, count(*) FILTER (good) AS accepted, count(*) FILTER (NOT good) AS rejected, CAST(round(count(*) FILTER (good) * 100.0 / count(*), 1) AS DOUBLE) AS pct_accepted FROM (SELECT NOT regexp_matches(lower(coalesce(title, '')), '(^|{_NOT_WORD})({places.OTHER_GOODS})s?({_NOT_WORD}|$)') AS good FROM messy)", messy_sql("title"))
def filter_acceptance(spark, sf_dir):
    return reports.acceptance(messy(spark, sf_dir, "title"), places.is_estate(F.col("title"), F.lit("https://s.com/x")))


_ERROR = "CASE WHEN trim(coalesce(error, '')) = '' THEN 'unspecified' " + " ".join(f"WHEN regexp_matches(lower(error), '{w}') THEN '{n}'" for w, n in reports.ERRORS) + " ELSE 'other' END"


@query(f"SELECT {_ERROR} AS kind, count(*) AS n FROM messy GROUP BY 1", messy_sql("error"))
def error_taxonomy(spark, sf_dir):
    return reports.counts(messy(spark, sf_dir, "error"), "kind", reports.error_class(F.col("error")))


@query("SELECT field, count(*) AS n FROM (SELECT unnest(['state', 'category', 'city']) AS field, unnest([state IS DISTINCT FROM s, category IS DISTINCT FROM c, city IS DISTINCT FROM t]) AS changed FROM (SELECT *, "
       + f"CASE WHEN list_contains({_list(places.STATES)}, upper(trim(state))) THEN upper(trim(state)) ELSE {_STATE_NAMES.replace('trim(x)', 'trim(state)')} END AS s, "
       + f"CASE WHEN coalesce(lower(trim(category)), '') IN ('', 'none') THEN 'Outro' ELSE coalesce({_PLAIN.replace('trim(x)', 'trim(category)')}, array_to_string(list_transform(string_split(lower(trim(category)), ' '), lambda w: upper(w[1]) || w[2:]), ' ')) END AS c, "
       + _title(r"regexp_replace(trim(city), '\s*[-/,]\s*[A-Za-z]{2}$', '')") + " AS t FROM messy)) WHERE changed GROUP BY 1 UNION ALL SELECT 'discount_percentage', count(*) FROM messy WHERE key % 151 > 100", messy_sql("state", "category", "city"))
def migration_changes(spark, sf_dir):
    rows = messy(spark, sf_dir, "state", "category", "city").withColumn("discount_percentage", (F.col("key") % 151).cast("double"))
    return lifecycle.change_counts(lifecycle.migrated(rows))


each("lots_estimated", "location", lambda c: discovery.estimated_lots(F.concat(F.lit("total: 12 de "), F.length(c).cast("string"), F.lit(" lotes 99999 imóveis"))), "CAST(coalesce(greatest(12, length(x)), 0) AS INTEGER)")

# --- sources ---

each("separators", "csv_line", bank_csv.separator_of, "CASE WHEN len(string_split(x, ';')) >= greatest(len(string_split(x, ',')), len(string_split(x, chr(9)))) THEN ';' WHEN len(string_split(x, ',')) >= len(string_split(x, chr(9))) THEN ',' ELSE chr(9) END")
each("page_data", "script_page", json_items.page_data, "regexp_extract(x, '>([{].*[}])<', 1)")


@query(r"""SELECT key, CASE WHEN item_json LIKE '%"nothing"%' THEN NULL ELSE 'T' || regexp_extract(item_json, '"T([0-9]+)"', 1) END AS title, CASE WHEN item_json LIKE '%"nothing"%' THEN NULL ELSE CAST(regexp_extract(item_json, '([0-9]+)[.]000,00', 1) AS DOUBLE) * 1000 END AS price,
  CASE WHEN item_json LIKE '%"Santos"%' AND item_json NOT LIKE '%"nothing"%' THEN 'Santos' END AS city FROM messy""", messy_sql("item_json"))
def json_items_mapped(spark, sf_dir):
    rows = messy(spark, sf_dir, "item_json").withColumn("source", F.col("key").cast("string"))
    found = json_items.normalized(rows, "item_json", "source").select(F.col("source").cast("long").alias("key"), "title", "price", "city")
    return rows.select("key").join(found, "key", "left")


@query(r"""SELECT key, CASE WHEN item_json LIKE '%"nothing"%' THEN NULL ELSE 'T' || regexp_extract(item_json, '"T([0-9]+)"', 1) END AS result FROM messy""", messy_sql("item_json"), name="json_items")
def json_item_titles(spark, sf_dir):
    first = F.get(json_items.items_of(F.col("item_json")), 0)
    title = F.coalesce(*(F.get_json_object(first, f"$.{k}") for k in ("titulo", "name", "title")))
    return messy(spark, sf_dir, "item_json").select("key", title.alias("result"))


_CONFIG = {"card": ("div", "item"), "title": r"(?is)<h3>(.*?)</h3>", "link": r'href="([^"]+)"', "price": r"R\$ ([0-9.,]+)"}


@query(r"""SELECT key, nullif(trim(replace(regexp_extract(page, '<h3>(.*?)</h3>', 1), '&amp;', '&')), '') AS title, 'https://s.com/lote/' || regexp_extract(page, '/lote/([0-9]+)', 1) AS link, CASE WHEN page LIKE '%R$ 1.500,00%' THEN 1500.0 WHEN page LIKE '%R$ 90.000,50%' THEN 90000.5 END AS price FROM messy""", messy_sql("page"))
def configured_cards(spark, sf_dir):
    pages = messy(spark, sf_dir, "page").select("key", F.col("page").alias("html"), F.lit("https://s.com/l?p=1").alias("url"))
    return html_items.configured_cards(pages, _CONFIG, ["key"]).select("key", "title", "link", "price")


# --- keys and measures of duplicates, each by a rule of its own in SQL ---

_BARE = _FOLD.format("lower({})")


@query(f"SELECT key, concat_ws('_', upper(state), left(regexp_replace({_BARE.format('city')}, '[^a-z]', '', 'g'), 20), left(array_to_string(list_filter(string_split({_SQUEEZE.format('regexp_replace(' + _BARE.format('address') + ', ' + chr(39) + '[^a-z ]' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, ' '), lambda w: length(w) > 2)[1:5], ''), 30)) AS k FROM messy", messy_sql("address", "city", "state"))
def dedup_word_keys(spark, sf_dir):
    rows = messy(spark, sf_dir, "address", "city", "state")
    return rows.select("key", dedup.words_key(F.col("address"), F.col("city"), F.col("state")).alias("k"))


_HOST_PATH = r"regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z]+://([^/?:#]+)', 1)), '^www\.', '') || regexp_replace(regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+$', '')"


@query(f"SELECT key, md5(concat_ws(':', CAST(key % 7 AS VARCHAR), {_HOST_PATH})) AS k FROM messy", messy_sql("url"))
def dedup_url_keys(spark, sf_dir):
    return messy(spark, sf_dir, "url").select("key", dedup.url_key(F.col("key") % 7, F.trim("url")).alias("k"))


@query("SELECT id, CASE WHEN a IS NULL OR b IS NULL OR a = 0 OR b = 0 THEN 0.5 ELSE (SELECT CASE WHEN off <= 0.1 THEN 1.0 WHEN off <= 0.2 THEN 0.8 WHEN off <= 0.3 THEN 0.6 WHEN off <= 0.5 THEN 0.4 ELSE 0.2 END FROM (SELECT abs(a - b) / greatest(a, b) AS off)) END::DOUBLE AS alike FROM (SELECT id, CASE WHEN key % 9 = 0 THEN 0 WHEN key % 9 > 1 THEN evaluation_value END AS a, evaluation_value * (key % 12 + 1) / 10 AS b FROM listings)", LISTINGS_SQL)
def value_similarities(spark, sf_dir):
    rows, k = listings(spark, sf_dir, values=False), F.col("key")
    first = F.when(k % 9 == 0, 0.0).when(k % 9 > 1, F.col("evaluation_value"))
    return rows.select("id", money.value_similarity(first, F.col("evaluation_value") * (k % 12 + 1) / 10).alias("alike"))


_SITE = "CASE key % 5 WHEN 0 THEN 'https://s.com/veiculos/9' WHEN 1 THEN 'https://s.com/imoveis/casa' WHEN 2 THEN 'https://s.com/OUTROS' WHEN 3 THEN 'https://s.com/automotivos/1' END"


@query(f"SELECT key, CASE WHEN key % 5 IN (0, 2) THEN FALSE WHEN title IN ('Carro usado', 'Trator e reboque') THEN FALSE WHEN title = 'Lance' THEN FALSE ELSE TRUE END AS strict_or_not FROM (SELECT key, split_part(split_part(split_part(coalesce(title, ''), ' em ', 1), ' - ', 1), ': ', 1) AS title FROM messy)", messy_sql("title"))
def real_estate_by_url(spark, sf_dir):
    """Addresses of other goods decide first, then words of titles."""
    return messy(spark, sf_dir, "title").select("key", places.is_estate(F.col("title"), F.expr(_SITE)).alias("strict_or_not"))
