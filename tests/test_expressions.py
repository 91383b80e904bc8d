"""Expressions on single texts, with the values that they must give."""

import datetime

import pytest
from pyspark.sql import functions as F

from gavelspark.functions import dates, money, places, text, urls
from gavelspark.sources import bank_csv, json_items

CASES = [
    ("money_parse", [("R$ 1.234,56", 1234.56), ("1,234.56", 1234.56), ("100.000", 100000.0), ("R&#36; 250.000,00", 250000.0), ("1,000.00", 1000.0), ("12,5", 12.5), ("12.5", 12.5), ("", None), (None, None), ("abc", None), ("1.234.567", 1234567.0), ("-5", -5.0)], money.parse_money, "DOUBLE"),
    ("area_parse", [("120 m²", 120.0), ("2,5 ha", 25000.0), ("1.200,50 m2", 1200.5), ("casa", None), (None, None)], money.parse_area, "DOUBLE"),
    ("percent_parse", [("35,5%", 35.5), ("40 %", 40.0), ("-3", -3.0), ("x", None)], money.parse_percent, "DOUBLE"),
    ("date_parse", [("2025-03-09", "2025-03-09 00:00:00"), ("9/3/2025 às 14:30", "2025-03-09 14:30:00"), ("dia 3 de março de 2025", "2025-03-03 00:00:00"), ("05/06/25", "2025-06-05 00:00:00"), ("31/02/2025", None), ("sem data", None), (None, None), ("1d 2h 30m", "2025-01-02 02:30:00")], lambda c: dates.parse_date(c, F.lit("2025-01-01")), "TIMESTAMP"),
    ("auction_date_labels", [("1º leilão: 10/05/2025 2º leilão: 20/05/2025", "2025-05-20 00:00:00"), ("10/05/2025 e 12/05/2025", "2025-05-12 00:00:00"), ("nada", None)], lambda c: dates.auction_dates(c)["second"], "TIMESTAMP"),
    ("url_normalize", [(" HTTPS://Site.com/A/?utm_source=x&b=2&a=1#top ", "https://site.com/A?b=2&a=1"), ("site.com/x/", "https://site.com/x"), ("//cdn.site/y", "https://cdn.site/y"), ("", None), (None, None), ("http://a.b?utm_x=1", "http://a.b")], urls.normalize_url),
    ("image_block", [("https://a.b/foto1.jpg", "false"), ("https://a.b/logo.png", "true"), ("", "true"), (None, "true"), ("https://a.b/100x80/x.jpg", "true"), ("https://a.b/800x600/x.jpg", "false"), ("data:image/png;base64,AA", "true"), ("https://a.b/x.svg", "true")], urls.blocked_image, "BOOLEAN"),
    ("absolute_urls", [("/a/b.jpg", "https://s.com/a/b.jpg"), ("c.jpg", "https://s.com/x/c.jpg"), ("//t.com/d", "https://t.com/d"), ("http://z.com", "http://z.com")], lambda c: urls.absolute_url(c, F.lit("https://s.com/x/page.html?q=1"))),
    ("listing_ids", [("https://s.com/lote/123/abc", "123"), ("https://s.com/a/b/casa-9/", "casa-9"), ("https://s.com/d.asp?hdnimovel=777", "777")], urls.listing_id),
    ("title_case", [("RIO DE JANEIRO", "Rio de Janeiro"), ("  são   josé DOS campos ", "São José dos Campos"), ("da silva", "Da Silva"), ("", ""), (None, None)], text.title_case),
    ("title_every_letter", [("o'neil d-4x", "O'Neil D-4X"), ("água fria", "Água Fria")], text.title_every_letter),
    ("city_names", [("CURITIBA - PR", "Curitiba"), ("santo antônio do monte/MG", "Santo Antônio do Monte"), ("Embu das Artes", "Embu das Artes")], text.city_name),
    ("state_codes", [("sp", "SP"), ("Paraná", "PR"), ("São Paulo", "SP"), ("mato grosso do sul", "MS"), ("??", "XX"), (None, "XX")], places.state_code),
    ("category_map", [("Apartamento 2 quartos", "Apartamento"), ("casal procura", "Outro"), ("CASA térrea", "Casa"), ("Lote urbano", "Terreno"), ("Galpão industrial", "Comercial"), ("Vaga de garagem", "Estacionamento"), ("Fazenda", "Rural"), (None, "Outro")], places.category),
    ("auction_types", [("Leilão Extrajudicial", "Extrajudicial"), ("JUDICIAL", "Judicial"), ("venda direta online", "Venda Direta"), ("Alienação fiduciária", "Leilão SFI"), ("", "Outros")], places.auction_type),
    ("occupancy_flags", [("Imóvel desocupado", "desocupado"), ("ocupado por terceiros", "ocupado"), ("x", None)], places.occupancy),
    ("real_estate_filter", [("Casa no centro", "true"), ("Carro 2010", "false"), ("Objeto", "true"), ("Moto e casa", "false"), ("caseiro", "true")], lambda c: places.is_estate(c, F.lit("https://s.com/x")), "BOOLEAN"),
    ("place_in_text", [("Rua A, Curitiba/PR", "Curitiba"), ("Lote em x, São Paulo - SP", "São Paulo"), ("Casa / ZZ", None)], lambda c: places.place_in(c)["city"]),
    ("slugs", [("Casa à venda: São Paulo!", "casa-a-venda-sao-paulo"), ("---", "")], text.slug),
    ("clean_markup", [("<b>Casa</b>&nbsp; &amp; lote", "Casa & lote"), ("a<br/>b", "a b")], text.clean_markup),
    ("address_keys", [("Avenida Brasil, nº 10 - Apartamento 3|X", "av brasil n 10 apto 3x"), ("RUA DAS FLORES", "r das flores")], lambda c: text.short_address(c)),
    ("geocodable_addresses", [("Rua das Flores 100", "ok"), ("curta", "too_short"), ("Oportunidade única no centro", "promotional")], lambda c: text.geocodable(c)["reason"]),
    ("labelled_prices", [("Avaliação: R$ 300.000,00 1º leilão R$ 200.000,00 2º leilão R$ 150.000,00", 200000.0), ("por R$ 90.000,00 ou R$ 80.000,00", 90000.0), ("grátis", None)], lambda c: money.labelled_prices(c)["first"], "DOUBLE"),
    ("separators", [("a;b;c", ";"), ("a,b,c;d", ","), ("a\tb\tc", "\t")], bank_csv.separator_of),
    ("json_items", [('{"items":[{"titulo":"A","preco":"1.000,00"}]}', "A"), ('[{"name":"B"}]', "B"), ('{"x":1}', None)], lambda c: F.coalesce(F.get_json_object(F.get(json_items.items_of(c), 0), "$.titulo"), F.get_json_object(F.get(json_items.items_of(c), 0), "$.name"))),
    ("page_data", [('<script id="__NEXT_DATA__" type="x">{"a":1}</script>', '{"a":1}'), ("<p>", None)], json_items.page_data),
    ("months", [("15 jan 2025", "2025-01-15 00:00:00"), ("15 janeiro 2025", "2025-01-15 00:00:00"), ("15 de jan. de 2025", "2025-01-15 00:00:00"), ("3 Março 2024 às 9h30", "2024-03-03 09:30:00")], dates.parse_date, "TIMESTAMP"),
    ("no date inside a number", [("2020-04-31", None), ("120/3/2025", None)], dates.parse_date, "TIMESTAMP"),
    ("dots", [("../img/a.jpg", "https://s.com/img/a.jpg"), ("?p=2", "https://s.com/x/page.html?p=2"), ("", "https://s.com/x/page.html?q=1"), ("../../../a", "https://s.com/a"), ("./", "https://s.com/x/")], lambda c: urls.absolute_url(c, F.lit("https://s.com/x/page.html?q=1")), "VARCHAR"),
    ("url order", [("http://a.b/?z=1&a=2&UTM_x=3", "http://a.b?z=1&a=2")], urls.normalize_url),
    ("url sorted", [("http://a.b/?z=1&a=2&utm_x=3", "http://a.b?a=2&utm_x=3&z=1")], lambda c: urls.normalize_url(c, True)),
    ("state_named", [("sp", "SP"), ("São Paulo", "SP"), ("estado do paraná", "PR"), ("Rio Grande", "RN"), ("mato grosso do sul", "MS"), ("??", "??"), ("x", ""), ("", ""), (None, ""), ("q", "")], places.named_state),
    ("state_prefix", [("sp", "SP"), ("Rj - capital", "RJ"), ("São Paulo", "XX"), (None, "XX"), ("", "XX")], places.state_prefix),
    ("category_listing", [("BOX", "Garagem"), ("apto 3 quartos", "Apartamento"), ("Sala comercial", "Sala Comercial"), ("salas comerciais", "Sala Comercial"), ("Galpão novo", "Comercial"), ("chácara linda", "Rural"), ("ÁREA", "Área"), ("zzz", "Outro"), (None, "Outro"), (" ", "Outro")], places.listing_category),
    ("city_accented", [("SAO  PAULO", "São Paulo"), ("brasilia", "Brasília"), ("são paulo", "São Paulo"), ("embu DAS artes", "Embu das Artes"), ("", None), (None, None)], text.city_accented),
    ("mended_text", [("SÃ£o  JosÃ© &amp; <b>mÂ²</b>", "São José & m²"), ("voc\u00c3\u00aa", "você"), (None, ""), ("Ãx", "Àx")], text.mended_text),
    ("page_images", [('<img src="/a.jpg?x=1"><p style="background: url(b.png)"> https://c.d/e.jpeg <meta property="og:image" content="https://s.com/a.jpg">', "https://s.com/a.jpg?x=1 https://c.d/e.jpeg https://s.com/x/b.png"), ("<img src='//i.j/logo.png'><img src='/t-90x200.jpg'>", ""), ("", ""), (None, None)], lambda c: F.when(c.isNotNull(), F.array_join(urls.page_images(c, F.lit("https://s.com/x/page.html")), " "))),
    ("short addresses keep accents", [("Estrada Velha, nº 5 Sala 2", "estr velha n 5 sl 2"), ("Praça São José", "pc são josé")], text.short_address, "VARCHAR"),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0])
def test_expression(spark, case):
    name, given, expression, kind = (*case, "VARCHAR")[:4]
    kind = {"VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}[kind]
    rows = spark.createDataFrame([(i, g[0]) for i, g in enumerate(given)], "n int, given string").select("n", expression(F.col("given")).cast(kind).alias("r")).collect()
    value = lambda v: None if v is None else v == "true" if kind == "boolean" else datetime.datetime.fromisoformat(v) if kind == "timestamp_ntz" else v
    assert {r.n: r.r for r in rows} == {i: value(g[1]) for i, g in enumerate(given)}
