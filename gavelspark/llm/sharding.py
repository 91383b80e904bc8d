"""Sharding by weighted rendezvous hashing, with DataFrame functions only.

Each (record key, shard) has a hash; the shard with the highest weighted score
wins. A new shard can only win rows for itself, and no other row moves. Nothing
is shuffled to find the shard. Positions inside a shard come from counts of
(shard, cell) where a cell is a small share of the shard, so that no task sees
a whole shard.

Defined results: a null key is a key like any other; a null text has no bytes;
rows with equal keys share a shard, however many they are (their cells differ,
so a hot key is still spread over tasks); of shards with equal scores the last wins; texts of
any length are measured whole; keys may have any type; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard, from 0, of a key. Shares follow the weights; the score of a
    shard is -weight / ln(u) with u a hash of (key, shard) in (0, 1)."""
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))

    def score(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(text, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(shard).alias("shard"))

    scores = [score(i, w) for i, w in enumerate(weights) if w > 0]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def assign_shards(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text", grown_weight: float = 1.0, cells: int = 512) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for each row.

    slot numbers the rows of a shard without a gap: rows of one of `cells`
    cells of the shard are numbered, and the counts of the cells before it are
    added. The table of counts has at most len(weights) * cells rows, whatever
    the data; choose cells so that rows / (shards * cells) fit a task."""
    keyed = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), [*weights, grown_weight]).alias("grown_shard"),
        F.pmod(F.xxhash64(F.col(key), F.monotonically_increasing_id()), F.lit(cells)).cast("int").alias("cell"),
    )
    keyed = written(keyed, "shards")  # the cells are fixed from here on
    counts = keyed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "cell").orderBy("key", "size", "text_crc32")
    return (
        keyed.withColumn("place", F.row_number().over(inside))
        .join(F.broadcast(counts), ["shard", "cell"])  # at most shards * cells rows
        .select(
            F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("base") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard",
        )
    )
