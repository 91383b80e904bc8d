"""The bank's per-state CSV files: semicolons, latin-1, title lines before the
header, and headers that vary in spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import discount, parse_money, parse_percent
from ..functions.places import category, state_code
from ..functions.text import city_name, clean_markup, fold_accents, squeeze
from ..functions.urls import listing_id

#: Positions of the fields in files of this kind. Fixed values.
FIELDS = ["number", "state", "city", "district", "address", "price", "appraisal", "discount", "description", "modality", "link"]


def read_bank_csv(spark: SparkSession, path: str, separator: str | None = None, encoding: str = "ISO-8859-1") -> DataFrame:
    """All rows of one or many files as text fields by position. Title, header
    and blank lines are told by content, line by line, so files split freely."""
    lines = spark.read.option("encoding", encoding).option("sep", "\x00").option("quote", "").schema("line string").csv(path)
    return split_lines(lines, separator)


def split_lines(lines: DataFrame, separator: str | None = None) -> DataFrame:
    """Rows among the lines. Without a given separator, each line is split by the
    first of ; tab and comma that gives it enough fields."""
    if separator is None:
        enough = lambda sep: F.size(F.split("line", sep, -1)) >= len(FIELDS) - 1
        parts = F.when(enough(";"), F.split("line", ";", -1)).when(enough("\t"), F.split("line", "\t", -1)).otherwise(F.split("line", ",", -1))
    else:
        parts = F.split("line", separator, -1)
    is_row = (F.size(parts) >= len(FIELDS) - 1) & F.trim(F.get(parts, 0)).rlike("^[0-9][0-9.-]*$")
    return lines.where(is_row).select(*(F.trim(F.get(parts, i)).alias(f) for i, f in enumerate(FIELDS)))


def separator_of(sample: Column) -> Column:
    """The one of ; , and tab that a line has most of."""
    n = lambda s: F.length(sample) - F.length(F.replace(sample, F.lit(s), F.lit("")))
    best = F.greatest(n(";"), n(","), n("\t"))
    return F.when(n(";") == best, ";").when(n(",") == best, ",").otherwise("\t")


#: Spellings of the header, folded, to our names. Fixed values.
ALIASES = {
    "n do imovel": "number", "numero do imovel": "number", "numero": "number", "uf": "state", "estado": "state", "cidade": "city", "bairro": "district", "endereco": "address",
    "preco": "price", "valor de venda": "price", "valor de avaliacao": "appraisal", "avaliacao": "appraisal", "desconto": "discount", "descricao": "description",
    "modalidade de venda": "modality", "modalidade": "modality", "link de acesso": "link", "link": "link",
}


def read_with_header(spark: SparkSession, path: str, separator: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """Files whose header may name and order the fields in any known way, one folder of one header."""
    return renamed(spark.read.option("encoding", encoding).option("sep", separator).option("header", True).csv(path))


def renamed(rows: DataFrame) -> DataFrame:
    """rows with known header spellings under our names; the first of several that is not null wins."""
    import unicodedata

    def folded(c: str) -> str:
        plain = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode().lower()
        return " ".join("".join(x if x.isalnum() else " " for x in plain).split())

    found: dict[str, list[str]] = {}
    for c in rows.columns:
        if name := ALIASES.get(folded(c)):
            found.setdefault(name, []).append(c)
    return rows.select(*(F.coalesce(*(F.col(f"`{c}`") for c in found[f])).alias(f) if f in found else F.lit(None).cast("string").alias(f) for f in FIELDS))


def to_listings(rows: DataFrame) -> DataFrame:
    """Bank rows as listings."""
    price, appraisal = parse_money(F.col("price")), parse_money(F.col("appraisal"))
    number = F.regexp_replace("number", "[^0-9]", "")
    digest = F.left(F.md5(fold_accents(F.lower(F.concat_ws("|", "address", "city", "state"))).cast("binary")), F.lit(12))
    return rows.select(
        F.concat(F.lit("caixa-"), F.coalesce(F.nullif(number, F.lit("")), F.nullif(listing_id(F.col("link")), F.lit("")), digest)).alias("id"),
        category(F.col("description")).alias("category"), state_code(F.col("state")).alias("state"), city_name(F.col("city")).alias("city"), city_name(F.col("district")).alias("neighborhood"),
        squeeze(F.col("address")).alias("address"), clean_markup(F.col("description")).alias("description"), price.alias("first_auction_value"), appraisal.alias("evaluation_value"),
        F.coalesce(parse_percent(F.col("discount")), discount(appraisal, price)).alias("discount_percentage"), F.col("modality").alias("auction_type"), F.col("link").alias("source_url"), F.lit("caixa").alias("source"),
    )
