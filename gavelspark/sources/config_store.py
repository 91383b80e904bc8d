"""Settings of sites, kept as a table that only grows: each save or removal is a
row in a partition of its own write, and the newest row of a site is what holds.
Files show up when their job commits, and no two jobs write to one place, so
writers never undo each other, and a failed write leaves nothing; of two that save
one site at once, the one with the later stamp holds. `compact` writes the rows that
hold to another folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "site string, config variant, saved_at timestamp, writer string"


class ConfigStore:
    """Settings (JSON of any shape) by site, in one folder. A site's name is not null."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _append(self, rows: DataFrame) -> None:
        stamped = rows.where("site is not null").select("site", "config", F.current_timestamp().alias("saved_at"))
        stamped.write.parquet(f"{self.folder}/writer={uuid.uuid4().hex}")

    def save(self, configs: DataFrame, site: str = "site", config: str = "config") -> None:
        """Save a text of JSON for each site; of a site's rows any one. A text that is no JSON fails."""
        self._append(configs.dropDuplicates([site]).select(F.col(site).cast("string").alias("site"), F.parse_json(F.coalesce(F.col(config), F.lit("null"))).alias("config")))

    def delete(self, sites: DataFrame, site: str = "site") -> None:
        """Sites that are not there stay so."""
        gone = sites.select(F.col(site).cast("string").alias("site")).distinct()
        self._append(gone.withColumn("config", F.lit(None).cast("variant")))

    def history(self) -> DataFrame:
        """All that was ever saved; a null config is a removal."""
        return self.spark.read.schema(_SCHEMA).parquet(self.folder)

    def all(self) -> DataFrame:
        """site, config and saved_at of what holds: an aggregate, so a site with a long history combines where it stands."""
        newest = self.history().groupBy("site").agg(F.max_by(F.struct("config", "saved_at"), F.struct("saved_at", "writer")).alias("r"))
        return newest.where("r.config is not null").select("site", "r.config", "r.saved_at")

    def names(self) -> DataFrame:
        return self.all().select("site").orderBy("site")

    def get(self, site: str) -> DataFrame:
        """The site's settings, a row or none; the filter reaches the files."""
        rows = self.history().where(F.col("site") == site).orderBy(F.desc("saved_at"), F.desc("writer")).limit(1)
        return rows.where("config is not null").select("site", "config", "saved_at")

    def value(self, path: str, kind: str = "string") -> DataFrame:
        """site and one value of each site's settings; null where it is not there or not of that kind."""
        return self.all().select("site", F.try_variant_get("config", path, kind).alias("value"))

    def compact(self, folder: str) -> ConfigStore:
        """A store in another (empty) folder with the rows that hold; this one stays as it is."""
        self.all().select("site", "config", "saved_at").write.parquet(f"{folder}/writer={uuid.uuid4().hex}")
        return ConfigStore(self.spark, folder)
