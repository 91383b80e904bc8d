"""Tables in the folder that driver and executors share: what a loop reads again
is written there once, so a lost executor costs a task and lineage stays short."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the one given to setCheckpointDir, else, on a
    single machine (as in tests), one of our own. A cluster without any is an error."""
    global _own
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (given.get() if given.isDefined() else None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _own = _own or "file://" + tempfile.mkdtemp(prefix="gavelspark-tables-")
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read from there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
