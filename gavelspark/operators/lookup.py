"""Lookups of texts in dimensions, as joins: each text once, however many rows
have it, by equality of hashes, so no text meets the whole dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import place_key, places_table


def located(rows: DataFrame, city: str = "city", state: str = "state") -> DataFrame:
    """rows with latitude, longitude and matched: of the city, else of the first of
    the state's places whose name holds the text or is held by it, else of the
    state's capital; null where the state is unknown. An empty city is held by every
    name; a null one is by none."""
    names = rows.select(F.col(city).alias("_city"), F.col(state).alias("_state")).distinct()
    c = F.col("_c")
    names = names.select("_city", "_state", place_key(F.col("_city")).alias("_c"), F.trim(F.lower("_state")).alias("_s"))
    places = places_table(rows.sparkSession)
    met = names.join(F.broadcast(places), F.col("_s") == F.col("place_state"))  # at most eight places a state
    how = F.when(F.col("place_city") == c, 0).when(F.contains("place_city", c) | F.contains(c, F.col("place_city")), 1).when(F.col("is_capital"), 2)
    met = met.withColumn("how", how).where("how is not null")
    best = met.groupBy("_city", "_state").agg(F.min(F.struct("how", "place_order", "lat", "lon")).alias("p"))
    found = best.select("_city", "_state", F.col("p.lat").alias("latitude"), F.col("p.lon").alias("longitude"), F.element_at(F.array(*map(F.lit, ("city", "part", "capital"))), F.col("p.how") + 1).alias("matched"))
    out = rows.drop("latitude", "longitude", "matched").join(found, rows[city].eqNullSafe(F.col("_city")) & rows[state].eqNullSafe(F.col("_state")), "left")
    return out.drop("_city", "_state")


def first_containing(rows: DataFrame, part: Column, dim: DataFrame, text: str, id: str, name: str) -> DataFrame:
    """rows with `name`: the lowest id of dim whose text holds the row's part, A-Z
    as a-z. An empty part is held by every text that is there; a null one by none.

    Texts give their substrings of the lengths that parts have, each once with the
    lowest id; parts meet them by equality. The work follows the texts' lengths, not
    parts times texts."""
    asked = rows.withColumn("_part", F.lower(part))
    parts = asked.select("_part").where("_part is not null").distinct()
    lengths = parts.select(F.length("_part").alias("n")).distinct()
    texts = dim.where(F.col(text).isNotNull() & (F.col(text) != "")).groupBy(F.lower(text).alias("t")).agg(F.min(id).alias("i"))
    most = F.length("t") - F.col("n") + 1
    at = F.explode(F.when(F.col("n") == 0, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), most)))
    pieces = texts.join(F.broadcast(lengths), F.col("n") <= F.length("t")).select("i", "t", "n", at.alias("at"))  # one number for each length
    known = pieces.groupBy(F.substring("t", F.col("at"), F.col("n")).alias("_part")).agg(F.min("i").alias(name))
    return asked.join(parts.join(known, "_part"), "_part", "left").drop("_part")
