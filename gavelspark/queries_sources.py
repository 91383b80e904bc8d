"""Sources' own records, put together from orders, through their readers; and the catalog's upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import stats
from .plans.listings import LISTINGS_SQL as L
from .plans.listings import listings, table
from .registry import query
from .sources import json_items

#: A bank record for each order; the same text is SQL for either side.
_RECORD = {
    "key": "o_orderkey", "numero_imovel": "CASE WHEN o_orderkey % 13 > 0 THEN CAST(o_orderkey AS STRING) END",
    "categoria": "CASE o_orderkey % 6 WHEN 0 THEN 'APARTAMENTO tipo' WHEN 1 THEN 'Casa' WHEN 2 THEN 'terreno urbano' WHEN 3 THEN 'Loja' WHEN 4 THEN 'Galpão' END",
    "modalidade": "CASE o_orderkey % 5 WHEN 0 THEN 'Leilão Judicial' WHEN 1 THEN 'EXTRAJUDICIAL' WHEN 2 THEN 'Venda Direta Online' WHEN 3 THEN '' END",
    "valor_primeira_praca": "CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey * 100 + 37 WHEN o_orderkey % 8 = 0 THEN 0 END", "valor_avaliacao": "CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey * 130 + 11 END",
    "desconto_percentual": "CASE WHEN o_orderkey % 3 = 0 THEN 12.5 WHEN o_orderkey % 3 = 1 THEN 0 END", "endereco": "CASE WHEN o_orderkey % 4 = 0 THEN 'Rua das Flores ' || CAST(o_orderkey AS STRING) WHEN o_orderkey % 4 = 1 THEN '' END",
    "logradouro": "CASE WHEN o_orderkey % 3 > 0 THEN 'Av. Brasil' END", "numero": "CASE WHEN o_orderkey % 9 > 2 THEN CAST(o_orderkey % 300 AS STRING) END", "complemento": "CASE WHEN o_orderkey % 5 = 0 THEN 'ap 2' WHEN o_orderkey % 5 = 1 THEN '' END",
    "cidade": "CASE WHEN o_orderkey % 10 > 0 THEN 'Santos' END", "estado": "CASE WHEN o_orderkey % 11 > 0 THEN 'RJ' END", "bairro": "CASE WHEN o_orderkey % 2 = 0 THEN 'Centro' END",
    "url": "CASE WHEN o_orderkey % 6 > 0 THEN 'https://bank.example/' || CAST(o_orderkey AS STRING) END",
}
_RECORD_SQL = "rec AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _RECORD.items()) + " FROM orders)"


@query("""SELECT id, left(address, 100) AS title, address, coalesce(cidade, 'Não informado') AS city, coalesce(estado, 'SP') AS state, bairro AS neighborhood,
  CASE WHEN contains(lower(categoria), 'apartamento') THEN 'Apartamento' WHEN contains(lower(categoria), 'casa') THEN 'Casa' WHEN contains(lower(categoria), 'terreno') THEN 'Terreno' WHEN contains(lower(categoria), 'loja') OR contains(lower(categoria), 'comercial') THEN 'Comercial' ELSE 'Outro' END AS category,
  CASE WHEN contains(lower(modalidade), 'extrajudicial') THEN 'Extrajudicial' WHEN contains(lower(modalidade), 'judicial') THEN 'Judicial' WHEN contains(lower(modalidade), 'venda direta') THEN 'Venda Direta' ELSE 'Extrajudicial' END AS auction_type,
  av / 100 AS evaluation_value, v / 100 AS first_auction_value, v / 100 AS second_auction_value, coalesce(CAST(nullif(desconto_percentual, 0) AS DOUBLE), round((1 - v / av) * 100, 2)) AS discount_percentage, coalesce(url, '') AS source_url
FROM (SELECT *, 'caixa-' || numero_imovel AS id, CAST(nullif(valor_primeira_praca, 0) AS DOUBLE) AS v, CAST(nullif(valor_avaliacao, 0) AS DOUBLE) AS av,
  coalesce(nullif(endereco, ''), nullif(concat_ws(', ', logradouro, numero, nullif(complemento, '')), ''), 'Endereço não informado') AS address FROM rec WHERE numero_imovel IS NOT NULL)""", _RECORD_SQL)
def bank_batch(spark, sf_dir):
    records = table(spark, sf_dir, "orders").select(*(F.expr(e).alias(c) for c, e in _RECORD.items()))
    out = json_items.bank_batch(records, "2024-03-10")
    return out.select("id", "title", "address", "city", "state", "neighborhood", "category", "auction_type", "evaluation_value", "first_auction_value", "second_auction_value", "discount_percentage", "source_url")


#: Pieces of a page's embedded offer for each order.
_OFFER = {
    "key": "o_orderkey", "title": "CASE o_orderkey % 4 WHEN 0 THEN 'Casa 120 m² em Santos/SP' WHEN 1 THEN 'Lote ocupado' WHEN 2 THEN 'RegiÃ£o sul - Recife/PE' ELSE 'Apto 75,5 m2, Campinas - SP' END",
    "about": "CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Imóvel DESOCUPADO com 2 ha' ELSE 'sem dados' END", "price": "o_orderkey * 10 + 5",
    "gallery": "CASE o_orderkey % 5 WHEN 0 THEN '[]' WHEN 1 THEN '[{\"link\":\"a.jpg\"},{\"link\":\"b.jpg\",\"highlight\":true}]' WHEN 2 THEN '[{\"link\":\"a.jpg\"},{\"link\":\"c.jpg\"}]' ELSE '[{\"link\":\"d.jpg\",\"highlight\":false}]' END",
    "stages": "CASE o_orderkey % 7 WHEN 0 THEN '[]' WHEN 1 THEN '[{\"initialBidValue\":0}]' WHEN 2 THEN '[{\"initialBidValue\":' || CAST(o_orderkey * 9 AS STRING) || '}]' ELSE '[{\"initialBidValue\":' || CAST(o_orderkey * 9 AS STRING) || '},{\"initialBidValue\":' || CAST(o_orderkey * 5 AS STRING) || '}]' END",
}
_PAGE = """'<p>x</p><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"offerDetails":{"offers":' || CASE WHEN key % 17 = 0 THEN '[]' ELSE '[{"id":' || CAST(key AS STRING) || ',"price":' || CAST(price AS STRING) || ',"offerDescription":{"offerDescription":"' || about || '"},"product":{"shortDesc":"' || title || '","galleryJson":' || gallery || '},"auction":{"eventPipeline":{"stages":' || stages || '}}}]' END || '}}}}</script>'"""


@query("""SELECT key, CAST(key AS VARCHAR) AS id, t AS title, CASE WHEN about <> '' THEN about ELSE t END AS description, CASE WHEN key % 4 = 0 THEN 'Santos' WHEN key % 4 = 2 THEN 'Recife' WHEN key % 4 = 3 THEN 'Campinas' END AS city, CASE WHEN key % 4 IN (0, 3) THEN 'SP' WHEN key % 4 = 2 THEN 'PE' END AS state,
  coalesce(CASE WHEN contains(gallery, 'true') THEN json_extract_string(gallery, '$[1].link') ELSE json_extract_string(gallery, '$[0].link') END, '') AS image_url, first AS first_auction_value, second AS second_auction_value,
  CASE WHEN second > 0 THEN round((1 - second / first) * 100, 1) END AS discount_percentage, CASE WHEN key % 4 = 0 THEN 120.0 WHEN key % 4 = 3 THEN 75.5 WHEN key % 3 = 1 THEN 20000.0 END AS area, contains(lower(t), 'ocupad') OR contains(lower(about), 'ocupad') AS is_occupied
FROM (SELECT *, replace(title, 'Ã£', 'ã') AS t, coalesce(nullif(CAST(json_extract_string(stages, '$[0].initialBidValue') AS DOUBLE), 0), CAST(price AS DOUBLE)) AS first, CAST(json_extract_string(stages, '$[1].initialBidValue') AS DOUBLE) AS second FROM o WHERE key % 17 > 0)""",
       "o AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _OFFER.items()) + " FROM orders)")
def page_offers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(*(F.expr(e).alias(c) for c, e in _OFFER.items())).select("key", F.expr(_PAGE).alias("html"))
    return json_items.page_offer(rows, ["key"])


#: An item for each order under names that vary, with empty values before good ones.
_ITEM = """'{"' || CASE o_orderkey % 3 WHEN 0 THEN 'titulo' WHEN 1 THEN 'name' ELSE 'other' END || '":"T' || CAST(o_orderkey AS STRING) || '","valor":' || CASE WHEN o_orderkey % 2 = 0 THEN '0' ELSE '"R$ 5"' END || ',"preco":' || CAST(o_orderkey AS STRING) || ',"cidade":"","municipio":"Santos","uf":"SP","foto":"' || CASE WHEN o_orderkey % 4 = 0 THEN 'http://i.example/a.jpg' ELSE '/p/b.jpg' END || '","href":"lote/' || CAST(o_orderkey AS STRING) || '"' || CASE WHEN o_orderkey % 5 > 0 THEN ',"codigo":"c' || CAST(o_orderkey AS STRING) || '"' ELSE '' END || '}'"""


@query("""SELECT key, CASE WHEN key % 3 < 2 THEN 'T' || key END AS title, CASE WHEN key % 2 = 0 THEN nullif(CAST(key AS VARCHAR), '0') ELSE 'R$ 5' END AS price, 'Santos' AS city, 'SP' AS state, CASE WHEN key % 4 = 0 THEN 'http://i.example/a.jpg' ELSE 'https://s.example/p/b.jpg' END AS image_url,
  'https://s.example/list/lote/' || key AS url, CASE WHEN key % 5 > 0 THEN 'src_c' || key ELSE 'src_' || left(md5(item), 12) END AS external_id FROM i WHERE key % 3 < 2 OR key % 5 > 0""", f"i AS (SELECT o_orderkey AS key, {_ITEM} AS item FROM orders)")
def mapped_items(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.expr(_ITEM).alias("item"))
    out = json_items.mapped_items(rows, "item", F.lit("src"), F.lit("https://s.example/list/index.html"), ["key"])
    return out.select("key", "title", "price", "city", "state", "image_url", "url", "external_id")


# --- upkeep ---

_BAD = L + """, c AS (SELECT * REPLACE (CASE WHEN key % 3 = 0 THEN upper(city) WHEN key % 3 = 1 THEN lower(city) ELSE NULL END AS city, CASE WHEN key % 4 = 0 THEN upper(neighborhood) ELSE neighborhood END AS neighborhood, CASE WHEN key % 5 = 0 THEN 'https://x/logo.png' WHEN key % 5 = 1 THEN '' ELSE image_url END AS image_url,
  CASE WHEN key % 6 = 0 THEN NULL WHEN key % 6 = 1 THEN '' ELSE source_url END AS source_url, CASE WHEN key % 2 = 0 THEN 'caixa-' || key ELSE id END AS id) FROM listings)"""


def _neglected(spark, sf_dir):
    k = F.col("key")
    return listings(spark, sf_dir).withColumns({
        "city": F.when(k % 3 == 0, F.upper("city")).when(k % 3 == 1, F.lower("city")), "neighborhood": F.when(k % 4 == 0, F.upper("neighborhood")).otherwise(F.col("neighborhood")),
        "image_url": F.when(k % 5 == 0, "https://x/logo.png").when(k % 5 == 1, "").otherwise(F.col("image_url")), "source_url": F.when(k % 6 == 1, "").when(k % 6 > 1, F.col("source_url")),
        "id": F.when(k % 2 == 0, F.concat(F.lit("caixa-"), k)).otherwise(F.col("id")),
    })


@query("""SELECT count(*) FILTER (city = upper(city) AND length(city) > 2) AS uppercase_cities, count(*) FILTER (neighborhood = upper(neighborhood) AND length(neighborhood) > 2) AS uppercase_neighborhoods, count(*) FILTER (image_url LIKE '%logo%') AS invalid_images,
  count(*) FILTER (coalesce(source_url, '') = '' AND id LIKE 'caixa-%') AS missing_bank_urls, count(*) FILTER (coalesce(source_url, '') = '' AND id NOT LIKE 'caixa-%') AS missing_other_urls, count(*) AS total, count(*) FILTER (image_url <> '') AS with_image, count(*) FILTER (source_url <> '') AS with_url FROM c""", _BAD)
def maintenance_audit(spark, sf_dir):
    return stats.maintenance(_neglected(spark, sf_dir))


_INITCAP = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


@query(f"SELECT id, CASE WHEN city = upper(city) THEN {_INITCAP.format('city')} ELSE city END AS city, CASE WHEN neighborhood = upper(neighborhood) THEN {_INITCAP.format('neighborhood')} ELSE neighborhood END AS neighborhood, CASE WHEN image_url NOT LIKE '%logo%' THEN image_url END AS image_url, CASE WHEN coalesce(source_url, '') = '' AND id LIKE 'caixa-%' THEN 'https://bank.example/?id=' || replace(id, 'caixa-', '') ELSE source_url END AS source_url FROM c", _BAD)
def maintenance_fixed(spark, sf_dir):
    return stats.maintained(_neglected(spark, sf_dir), "https://bank.example/?id=").select("id", "city", "neighborhood", "image_url", "source_url")


_FIELDS = ["first_auction_value", "image_url", "latitude", "city", "state", "source_url"]


@query("SELECT total, " + ", ".join(f"round(p{i}, 1) AS pct_{f}" for i, f in enumerate(_FIELDS)) + ", round(score, 1) AS score, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'poor' END AS band FROM (SELECT *, (" + " + ".join(f"p{i}" for i in range(6)) + ") / 6 AS score FROM (SELECT count(*) AS total, "
       + ", ".join(f"count(*) FILTER ({f} IS NOT NULL" + (f" AND {f} <> ''" if f not in ("first_auction_value", "latitude") else "") + f") * 100.0::DOUBLE / count(*) AS p{i}" for i, f in enumerate(_FIELDS)) + " FROM c WHERE is_active))", _BAD)
def quality_score(spark, sf_dir):
    return stats.quality_score(_neglected(spark, sf_dir), _FIELDS)


@query("SELECT count(*) AS n, count(image_url) AS with_image, CAST(round((count(*) - count(image_url)) * 100.0 / count(*), 1) AS DOUBLE) AS pct_missing FROM listings", L)
def image_coverage_overall(spark, sf_dir):
    return stats.image_coverage_overall(listings(spark, sf_dir, values=False))
