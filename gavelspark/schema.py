"""Relations as Spark schemas, and closed sets of values."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _B, _I, _TS = T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


PROPERTIES = _struct(
    id=_S, title=_S, category=_S, auction_type=_S, state=_S, city=_S, neighborhood=_S, address=_S, description=_S, area_total=_D, area_privativa=_D,
    evaluation_value=_D, first_auction_value=_D, first_auction_date=_TS, second_auction_value=_D, second_auction_date=_TS, discount_percentage=_D,
    image_url=_S, auctioneer_id=_S, auctioneer_name=_S, auctioneer_url=_S, source=_S, source_url=_S, accepts_financing=_B, accepts_fgts=_B,
    accepts_installments=_B, occupation_status=_S, pending_debts=_S, latitude=_D, longitude=_D, is_duplicate=_B, original_id=_S, dedup_key=_S, is_active=_B,
    created_at=_TS, updated_at=_TS, last_seen_at=_TS, deactivated_at=_TS, previous_first_auction_value=_D, previous_second_auction_value=_D,
    value_changed_at=_TS, geocoding_status=_S, geocoding_attempts=_I, geocoding_error=_S, geocoded_at=_TS,
)
AUCTIONEERS = _struct(id=_S, name=_S, website=_S, is_active=_B, property_count=_I, scrape_status=_S, scrape_error=_S, scrape_config=_S, validation_metrics=_S, discovery_status=_S, last_discovery_at=_TS)
SCRAPER_RUNS = _struct(
    scraper_name=_S, run_id=_S, start_time=_TS, end_time=_TS, properties_found=_I, properties_valid=_I, properties_invalid=_I, urls_validated=_I,
    urls_redirected=_I, urls_failed=_I, rate_limit_hits=_I, errors=T.ArrayType(_S), warnings=T.ArrayType(_S),
)
SEARCH_LOGS = _struct(user_id=_S, session_id=_S, search_filters=_S, results_count=_I, created_at=_TS)
GEOCODE_RESULTS = _struct(id=_S, success=_B, latitude=_D, longitude=_D, error=_S)

#: Fixed values.
STATES = "AC AL AP AM BA CE DF ES GO MA MT MS MG PA PB PR PE PI RJ RN RS RO RR SC SP SE TO".split()
CATEGORIES = ["Apartamento", "Casa", "Terreno", "Comercial", "Estacionamento", "Rural", "Área", "Prédio", "Outro"]
AUCTION_TYPES = ["Judicial", "Extrajudicial", "Venda Direta", "Leilão SFI", "Outros"]
SORTABLE = ["created_at", "updated_at", "first_auction_value", "second_auction_value", "evaluation_value", "discount_percentage", "first_auction_date", "city", "title"]


def closed_sets(spark) -> "DataFrame":  # noqa: F821
    """The closed sets of values as a relation: kind, name."""
    return spark.createDataFrame([("category", c) for c in CATEGORIES] + [("auction_type", t) for t in AUCTION_TYPES], "kind string, name string")
