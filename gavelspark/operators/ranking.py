"""Rankings: cumulative shares, priority bands, canonical records, latest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import percent


def cumulative_ranking(counts: DataFrame, name: str, n: str = "n", share: int = 80) -> DataFrame:
    """counts (one row for each name) by size, with running sums and whether the
    row is needed to reach `share` per cent. Only the counts are in one window."""
    w = Window.orderBy(F.desc(n), name)
    run = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(n).over(Window.partitionBy())
    out = counts.select(name, n, F.row_number().over(w).alias("rank"), run.alias("running"), percent(run, total, 2).alias("pct"))
    return out.withColumn("in_head", F.col("pct") <= share)


def priority_bands(counts: DataFrame, name: str, n: str = "n") -> DataFrame:
    """HIGH for the first fifth by position, MEDIUM to the half, LOW beyond."""
    at = F.row_number().over(Window.orderBy(F.desc(n), name))
    total = F.count(F.lit(1)).over(Window.partitionBy())
    out = counts.select(name, n, at.alias("position"), total.alias("total"))
    p, t = F.col("position"), F.col("total")
    return out.select(name, n, "position", F.when(p <= F.floor(t * 0.2), "HIGH").when(p <= F.floor(t * 0.5), "MEDIUM").otherwise("LOW").alias("priority"))


def completeness_points(weights: dict[str, int]) -> Column:
    """Weighted points (whole numbers) for fields that are there."""
    out = F.lit(0)
    for field, weight in weights.items():
        c = F.col(field)
        out = out + F.when(c.isNotNull() & (c.cast("string") != ""), weight).otherwise(0)
    return out


def canonical_records(rows: DataFrame, key: Column, points: Column, oldest: str = "created_at", id: str = "id") -> DataFrame:
    """rows with group_key, group_size, canonical_id and is_canonical. The best
    row of a group is one aggregate, which combines before the shuffle, so a
    group of any size is no single task's sort; it meets its rows in a join."""
    keyed = rows.withColumns({"group_key": key, "points": points})
    best = keyed.groupBy("group_key").agg(
        F.count(F.lit(1)).alias("group_size"), F.min(F.struct((-F.col("points")).alias("p"), F.col(oldest).alias("t"), F.col(id).alias("id"))).alias("best")
    ).select("group_key", "group_size", F.col("best.id").alias("canonical_id"))
    return keyed.join(best, "group_key").withColumn("is_canonical", F.col(id) == F.col("canonical_id"))


def latest(rows: DataFrame, by: str, time: str, n: int) -> DataFrame:
    """The last n rows of each group; Spark limits groups before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(time))
    return rows.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)
