"""Listing fields as sources write them: one row for each order, with texts put
together from the order's key. The same description gives the Spark columns and
their SQL, so oracles state rules over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .listings import table

KEY = "o_orderkey"


class Pick:
    """The value number (key div `by`) mod the number of values; None is null."""

    def __init__(self, values: list[str | None], by: int = 1):
        self.values, self.by = values, by

    def column(self) -> Column:
        at = F.pmod(F.floor(F.col(KEY) / self.by), F.lit(len(self.values))).cast("int")
        return F.get(F.array(*(F.lit(v).cast("string") for v in self.values)), at)

    def sql(self) -> str:
        values = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in self.values)
        return f"list_extract(CAST([{values}] AS VARCHAR[]), CAST(({KEY} // {self.by}) % {len(self.values)} AS BIGINT) + 1)"


class Number:
    """(key div `by`) mod `mod`, plus `add`, padded with zeros to `width`."""

    def __init__(self, mod: int, by: int = 1, add: int = 0, width: int = 1):
        self.mod, self.by, self.add, self.width = mod, by, add, width

    def column(self) -> Column:
        n = (F.pmod(F.floor(F.col(KEY) / self.by), F.lit(self.mod)) + self.add).cast("string")
        return F.lpad(n, self.width, "0") if self.width > 1 else n

    def sql(self) -> str:
        n = f"CAST(({KEY} // {self.by}) % {self.mod} + {self.add} AS VARCHAR)"
        return f"lpad({n}, {self.width}, '0')" if self.width > 1 else n


def P(*values: str | None, by: int = 1) -> Pick:
    return Pick(list(values), by)


N = Number

FIELDS: dict[str, list] = {
    "address": [P("Rua das Flores", "AV. Brasil", "Avenida São João", "Praça da Sé", "Trav. do Ouro", "R. Augusta", "Estrada Velha", "Alameda Santos", None), ", n.", N(300), P("", " - Apartamento 12", " bloco B", " Quadra 5 Lote 9", "; ENTRE EM CONTATO", ", Centro", by=9)],
    "city": [P("SÃO PAULO", "campinas", "Rio de Janeiro", "são josé DOS campos", "Curitiba - PR", "goiânia/GO", "  Belo   Horizonte ", "embu das artes", None, "", "PALMAS")],
    "state": [P("SP", "sp", "São Paulo", "Paraná", "mato grosso do sul", " RJ ", "??", "x", None, "MG", "Goiás", "TO", "")],
    "category": [P("APARTAMENTO", "casa", "Imóvel Rural", "Sala comercial", "galpão", "Lote urbano", "Vaga de garagem", "Fazenda", "Casa térrea", "prédio", "zzz qqq", None, "", "Loja", "terreno", "none", "Apto")],
    "title": [P("Casa térrea", "Apartamento 2 quartos", "casal procura", "Lote urbano", "Carro usado", "Galpão industrial", "Imóvel", "Sala comercial", "Fazenda Boa Vista", "Trator e reboque", None, "Sobrado com vaga"), P(" em ", " - ", ": ", by=12), P("Curitiba/PR", "Campinas - SP", "lugar nenhum", "Belo Horizonte/MG", by=36), " ", N(50, 5)],
    "money": [P("R$ ", "", "R&#36; ", "US$ ", "- "), P("1.234,56", "250.000,00", "1,234.56", "100.000", "12,5", "12.5", "1.234.567", "abc", "", "99", None, by=5)],
    "area": [N(900, 1, 1), P(" m²", ",5 m2", ".250,50 m2", " ha", ",5 hectares", " metros", " casas", by=3)],
    "percent": [P("", "até ", "-", "desconto "), N(140, 4), P("%", ",5%", " %", ".25", " x", by=8)],
    "day_text": [P("", "dia ", "Leilão: ", "em "), N(31, 1, 1, 2), P("/", "-", ".", by=31), N(12, 31, 1, 2), P("/", "-", ".", by=31), N(6, 7, 2020), P("", " às 14:30", " 9h05", " 14:30", by=4)],
    "iso_text": [N(6, 7, 2020), "-", N(12, 3, 1, 2), "-", N(31, 1, 1, 2), P("", "T10:20:30", " 08:15:00", by=5)],
    "long_date": [N(31, 1, 1), P(" de ", " ", by=2), P("janeiro", "jan", "Março", "abril", "set", "dezembro", "maio", "nov", by=3), P(" de ", " ", by=2), N(6, 7, 2020)],
    "countdown": [P("faltam ", "", "encerra em "), N(9), "d ", N(24, 2), "h ", N(60, 3), P("m", "min", " minutos", by=7)],
    "notice": [P("Avaliação: R$ ", "Valor de avaliação R$ ", "Preço R$ "), N(900, 1, 100), ".000,00", P(" 1º leilão R$ ", " Primeira praça: R$ ", " por R$ ", by=3), N(600, 2, 100), ".500,00", P(" 2º leilão R$ ", " segunda praça R$ ", " ou R$ ", by=9), N(300, 3, 100), ".250,00", P("", " lance mínimo: R$ 90.000,00", by=27)],
    "dates_notice": [P("1º leilão: ", "Primeira praça em ", "datas "), N(28, 1, 1, 2), "/05/2025", P(" 2º leilão: ", " segunda praça em ", " e ", by=3), N(28, 2, 1, 2), "/06/2025"],
    "url": [P(" HTTPS://Site.com/A/", "site.com/x/", "//cdn.site/y", "http://a.b/lote/", "https://www.s.com/d.asp?hdnimovel=", "", None), N(900, 7), P("?utm_source=x&b=2&a=1#top", "", "/", "?utm_x=1", "?z=1&y=2", by=3)],
    "image": [P("https://a.b/foto", "https://a.b/logo", "https://cdn.x/img/", "/fotos/", "data:image/png;base64,", "https://a.b/100x80/", "https://a.b/800x600/", "", None), N(500), P(".jpg", ".png", ".svg", ".webp?w=3", "", by=9)],
    "href": [P("/a/b", "c", "//t.com/d", "http://z.com/", "../img/", "./e", "?p=", "#top", "g/../h/./i", "../../../k"), N(50, 10)],
    "broken_text": [P("SÃ£o JosÃ©", "120 mÂ²", "RegiÃ£o", "Ã\u00adndice", "Ã¡gua", "nenhum", None), P(" &amp; ", " <i>", "  ", by=7), P("vocÃª", "avÃ´", "aÃ§o", "baÃº", "Ãtomo", "plano", by=21), N(40, 5)],
    "markup": ["<b>", P("Casa", "Lote"), "</b>&nbsp; ", P("&amp;", "&lt;x&gt;", "&quot;a&quot;", "&#39;", "<br/>"), " fim ", N(9)],
    "page": ["<html><body><div class=\"item\"><h3>", P("Casa", "Lote", "", "Apto &amp; vaga"), " ", N(90), "</h3><a href=\"/lote/", N(400), "\">ver</a> ", P("R$ 1.500,00", "", "R$ 90.000,50", by=4), "</div><div class=\"other\">", P("imóvel leilão lance", "nada", "casa r$ m²", by=3), "</div><script>var preco = ", N(9000, 2, 100), ".50;</script></body></html>"],
    "item_json": ["{\"", P("items", "offers", "leiloes", "lotes", "data", "nothing"), "\":[{\"", P("titulo", "name", "title", by=6), "\":\"T", N(99), "\",\"", P("preco", "valor", "price", by=2), "\":\"", N(900, 1, 1), ".000,00\",\"cidade\":\"", P("Santos", "", by=5), "\"}]}"],
    "script_page": ["<p>x</p><script id=\"__NEXT_DATA__\" type=\"application/json\">{\"n\":", N(999), "}</script>"],
    "csv_line": [P("", "Lista de imóveis", "N° do imóvel;UF"), N(9000, 1, 100), P(";", ",", "\t", by=3), "SP", P(";", ",", "\t", by=3), "CAMPINAS", P(";", ",", "\t", by=3), "CENTRO"],
    "location": [P("Rua A 10, Centro, Campinas, SP", "Curitiba, PR", "Lote em x, São Paulo - SP", "nada", "Bairro Sul, Belo Horizonte/MG", "Casa / ZZ")],
    "place_url": ["https://www.mega.com/", P("imoveis", "leilao"), "/", P("sp", "pr", "zz", by=2), "/", P("sao-paulo", "curitiba", "santo-andre", by=3), "/lote-", N(99)],
    "error": [P("Timeout after 30s", "HTTP 404", "403 Forbidden", "blocked by Cloudflare", "SSL: bad certificate", "connection reset", "DNS lookup failed", "Nenhum imóvel encontrado", "duplicate key value", None, "boom", "page not found")],
    "occupancy": [P("Imóvel desocupado", "ocupado por terceiros", "sem informação", "Vago", None)],
    "kind": [P("Leilão Extrajudicial", "JUDICIAL", "venda direta online", "Alienação fiduciária", "", None, "outra coisa")],
}


def messy(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """key and the fields asked for, of each order."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x.column()
    columns = [(F.concat(*map(lit, FIELDS[f])) if len(FIELDS[f]) > 1 else lit(FIELDS[f][0])).alias(f) for f in fields]
    return table(spark, sf_dir, "orders").select(F.col(KEY).alias("key"), *columns)


def messy_sql(*fields: str) -> str:
    """The same as a common table expression."""
    lit = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else x.sql()
    return "messy AS (SELECT o_orderkey AS key, " + ", ".join(" || ".join(map(lit, FIELDS[f])) + f" AS {f}" for f in fields) + " FROM orders)"


def auctioneers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One for each customer, with settings, metrics and states that vary with its key."""
    k = F.col("c_custkey")
    pick = lambda *v, by=1: F.get(F.array(*(F.lit(x).cast("string") for x in v)), F.pmod(F.floor(k / by), F.lit(len(v))).cast("int"))
    number = lambda mod, by=1: F.pmod(F.floor(k / by), F.lit(mod))
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 13 > 0, F.col("c_name")).alias("name"), F.when(k % 17 > 0, F.concat(F.lit("https://www.site"), k % 400, F.lit(".com.br"))).alias("website"),
        F.when(k % 5 > 0, F.concat(F.lit('{"site_type":"'), pick("static", "api", "script", by=3), F.lit('","expires_at":"2024-'), F.lpad((number(12) + 1).cast("string"), 2, "0"), F.lit('-15T00:00:00","discovered_at":"2024-01-'), F.lpad((number(28, 2) + 1).cast("string"), 2, "0"), F.lit('T00:00:00"}'))).alias("scrape_config"),
        F.concat(F.lit('{"total_extractions":'), number(12), F.lit(',"successful_extractions":'), F.least(number(12), number(7)), F.lit(',"consecutive_failures":'), number(5, 3), F.lit("}")).alias("validation_metrics"),
        pick("pending", "completed", "needs_rediscovery", None, "failed").alias("discovery_status"), F.when(k % 4 > 0, F.lit("2024-03-01").cast("timestamp_ntz") - F.make_dt_interval(number(70).cast("int"))).alias("last_discovery_at"),
        number(120).cast("int").alias("property_count"), pick("success", "error", "pending", by=2).alias("scrape_status"),
        F.when(F.floor(k / 2) % 3 == 1, pick("Timeout after 30s", "HTTP 404", "403 Forbidden", "Cloudflare", "SSL error", "boom", by=6)).alias("scrape_error"), F.lit("2024-03-10").cast("timestamp_ntz").alias("last_scrape") - F.make_dt_interval(F.lit(0), number(300).cast("int")),
        pick("A", "B", "C", "D", by=5).alias("platform"), number(101).cast("int").alias("priority"),
    ).toDF("id", "name", "website", "scrape_config", "validation_metrics", "discovery_status", "last_discovery_at", "property_count", "scrape_status", "scrape_error", "last_scrape", "platform", "priority")


AUCTIONEERS_SQL = """
auctioneers AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 13 > 0 THEN c_name END AS name, CASE WHEN c_custkey % 17 > 0 THEN 'https://www.site' || (c_custkey % 400) || '.com.br' END AS website,
  CASE WHEN c_custkey % 5 > 0 THEN '{"site_type":"' || ['static','api','script'][CAST((c_custkey // 3) % 3 AS BIGINT) + 1] || '","expires_at":"2024-' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || '-15T00:00:00","discovered_at":"2024-01-' || lpad(CAST((c_custkey // 2) % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00"}' END AS scrape_config,
  '{"total_extractions":' || (c_custkey % 12) || ',"successful_extractions":' || least(c_custkey % 12, c_custkey % 7) || ',"consecutive_failures":' || ((c_custkey // 3) % 5) || '}' AS validation_metrics,
  ['pending','completed','needs_rediscovery',NULL,'failed'][CAST(c_custkey % 5 AS BIGINT) + 1] AS discovery_status, CASE WHEN c_custkey % 4 > 0 THEN TIMESTAMP '2024-03-01' - to_days(CAST(c_custkey % 70 AS INTEGER)) END AS last_discovery_at,
  CAST(c_custkey % 120 AS INTEGER) AS property_count, ['success','error','pending'][CAST((c_custkey // 2) % 3 AS BIGINT) + 1] AS scrape_status,
  CASE WHEN (c_custkey // 2) % 3 = 1 THEN ['Timeout after 30s','HTTP 404','403 Forbidden','Cloudflare','SSL error','boom'][CAST((c_custkey // 6) % 6 AS BIGINT) + 1] END AS scrape_error,
  TIMESTAMP '2024-03-10' - to_hours(CAST(c_custkey % 300 AS INTEGER)) AS last_scrape, ['A','B','C','D'][CAST((c_custkey // 5) % 4 AS BIGINT) + 1] AS platform, CAST(c_custkey % 101 AS INTEGER) AS priority FROM customer)
"""
