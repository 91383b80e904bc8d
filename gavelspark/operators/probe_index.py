"""A stored index of existing texts, which arriving rows are held against: new
with old only, and without reading the old rows themselves.

Three tables lie under one folder, in buckets, so a batch is the only side that
moves: `order`, how often each token was met when the index was made; `texts`,
each text of a block with the lowest id that has it; `tokens`, those of a text of
which every similar text shares one. The order stays as it was made (tokens that
it lacks count as never met), since the two sides of a prefix filter must agree on
it, not on its being up to date. Later rows are appended to texts and tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import stored
from .dedup import distinct_texts, kept_tokens, text_ratio, text_tokens


class ProbeIndex:
    """Rows of one folder. Texts are compared inside a block (null blocks too), by a
    ratio of `least` or more; null texts are in no index and match nothing, empty
    ones match empty ones."""

    def __init__(self, spark: SparkSession, folder: str, block: list[str], text: str, id: str = "id", least: float = 0.85, buckets: int = 32):
        self.spark, self.folder, self.block, self.text, self.id, self.least, self.buckets = spark, folder.rstrip("/"), block, text, id, least, buckets
        self._names: dict[str, str] = {}

    def _table(self, name: str, schema: str, by: str) -> str:
        """The bucketed table of that name, over files that may be there already."""
        if name not in self._names:
            self._names[name] = f"probe_{name}_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self._names[name]} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        return self._names[name]

    def _order(self) -> str:
        return self._table("order", "token bigint, seen bigint", "token")

    def _texts(self, kind: str) -> str:
        return self._table("texts", f"text_key bigint, t string, place bigint, id {kind}", "text_key")

    def _tokens(self) -> str:
        return self._table("tokens", "token bigint, n int, text_key bigint", "token")

    def _kind(self) -> str:
        return self.spark.read.parquet(f"{self.folder}/texts").schema["id"].dataType.simpleString()

    def _distinct(self, rows: DataFrame) -> DataFrame:
        """text_key, place (its block), t and the lowest id of each text of a block."""
        each = distinct_texts(rows, self.block, self.text, self.id)
        place = F.xxhash64(*(F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("")) for c in self.block)) if self.block else F.lit(0).cast("long")
        return stored(each.select(place.alias("place"), "t", "id").withColumn("text_key", F.xxhash64("place", "t")), "texts")  # read more than once

    def _cut(self, texts: DataFrame) -> DataFrame:
        """text_key, n and token of the tokens that decide."""
        own = text_tokens(texts.where("t <> ''").select("text_key", "place", "t", F.col("text_key").alias("id")), ["place"], self.least, ["place"])
        ranked = own.join(self.spark.table(self._order()), "token", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
        return kept_tokens(ranked, ["place"], self.least).select("token", "n", F.col("id").alias("text_key"))

    def create(self, rows: DataFrame) -> ProbeIndex:
        """Make the index of rows in an empty folder."""
        texts = self._distinct(rows)
        tokens = text_tokens(texts.where("t <> ''").select("place", "t", F.col("text_key").alias("id")), ["place"], self.least, ["place"])
        tokens.groupBy("token").agg(F.count(F.lit(1)).alias("seen")).write.insertInto(self._order())
        return self._append(texts, dict(rows.dtypes)[self.id])

    def add(self, rows: DataFrame) -> ProbeIndex:
        """Append further rows."""
        return self._append(self._distinct(rows), dict(rows.dtypes)[self.id])

    def _append(self, texts: DataFrame, kind: str) -> ProbeIndex:
        texts.select("text_key", "t", "place", "id").write.insertInto(self._texts(kind))
        self._cut(texts).write.insertInto(self._tokens())
        return self

    def probe(self, new: DataFrame) -> DataFrame:
        """The id of each new row with original_id: the lowest of the existing rows
        with its text, or one that is similar; null: none."""
        known = self.spark.table(self._texts(self._kind())).select("text_key", F.col("t").alias("old_t"), F.col("place").alias("old_place"), F.col("id").alias("old_id"))
        texts = self._distinct(new)
        same = texts.select("text_key", "t", "place").join(known, "text_key").where("t = old_t and place = old_place").select("text_key", "old_id")
        met = self._cut(texts).join(self.spark.table(self._tokens()).toDF("token", "old_n", "old_key"), "token").where(F.col("text_key") != F.col("old_key"))
        met = met.where(F.least("n", "old_n") * 2 >= F.lit(self.least) * (F.col("n") + F.col("old_n")) - 1e-9).select("text_key", "old_key").distinct()
        pairs = met.join(known.withColumnRenamed("text_key", "old_key"), "old_key").join(texts.select("text_key", "t", "place"), "text_key").where("place = old_place")
        near = pairs.withColumn("ratio", text_ratio("t", "old_t")).where(F.col("ratio") >= self.least).select("text_key", "old_id")
        found = same.union(near).groupBy("text_key").agg(F.min("old_id").alias("original_id"))
        place = F.xxhash64(*(F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("")) for c in self.block)) if self.block else F.lit(0).cast("long")
        keyed = new.select(F.col(self.id).alias("id"), F.when(F.col(self.text).isNotNull(), F.xxhash64(place, self.text)).alias("text_key"))
        return keyed.join(found, "text_key", "left").select("id", "original_id")
