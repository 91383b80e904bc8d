"""Catalog snapshots and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import AUCTION_TYPES, CATEGORIES, PROPERTIES


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A JSON snapshot; unknown categories and types become the general ones."""
    rows = spark.read.schema(PROPERTIES).json(path)
    closed = lambda c, known, other: F.when(F.col(c).isin(*known), F.col(c)).otherwise(other)
    return rows.withColumns({"category": closed("category", CATEGORIES, "Outro"), "auction_type": closed("auction_type", AUCTION_TYPES, "Outros")})


def write_snapshot(rows: DataFrame, path: str, kind: str = "json") -> None:
    """json, csv (with a header) or parquet, replaced as a whole."""
    out = rows.write.mode("overwrite")
    (out.option("header", True) if kind == "csv" else out).format(kind).save(path)
