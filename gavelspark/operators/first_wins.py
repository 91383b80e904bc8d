"""First come, first kept: items in order, each kept unless an earlier kept one
stands in its way. Whether an item is kept hangs on what became of all before it,
so one pass of aggregates can't say; rounds over tables can.

In a round every open item that is the lowest at all its keys (or has no lower
open partner) is kept, and whoever shares a key with it goes out; keys of items
that are out no longer count, so in the next round others are the lowest. In
orders that don't follow the keys the rounds grow with the logarithm of the
items. A chain in which each item hangs on the one before is sequential by
nature: once at most `few` rows are open, they are worked through in one task.
Each round ends in a written table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..tables import stored


def first_of_each(items: DataFrame, order: str, keys: list[str], within: list[str] | None = None, existing: DataFrame | None = None, few: int = 50_000) -> DataFrame:
    """items in `order` (unique), without those that share one of their keys, inside
    the same `within`, with an earlier item that is kept, or with an existing one (a
    table with the same key columns). A null or blank key is none; an item without
    keys is kept."""
    within = within or []

    def keyed(rows: DataFrame, *more: str) -> DataFrame:
        parts = [F.struct(F.lit(i).alias("part"), F.xxhash64(F.lit(i), *within, k).alias("a"), F.hash(F.lit(i), *within, k).alias("b"), is_blank(F.col(k)).alias("none")) for i, k in enumerate(keys)]
        return rows.select(*more, F.explode(F.filter(F.array(*parts), lambda x: ~x["none"])).alias("k")).select(*more, F.struct("k.a", "k.b").alias("k"))

    every = keyed(items, order)
    if existing is not None:
        taken = keyed(existing).distinct()
        out = every.join(taken, "k", "left_semi").select(order).distinct()
        gone = [stored(out, "gone")]
        open_ = stored(every.join(gone[0], order, "left_anti"), "open")
    else:
        gone, open_ = [], stored(every, "open")
    while (n := open_.count()) > few:
        low = open_.groupBy("k").agg(F.min(order).alias("low"))
        mine = open_.join(low, "k").groupBy(order).agg(F.bool_and(F.col("low") == F.col(order)).alias("first"))
        kept = stored(mine.where("first").select(order), "kept")
        taken = open_.join(kept, order, "left_semi").select("k")
        met = stored(open_.join(taken, "k", "left_semi").select(order).distinct(), "met")
        gone.append(met.join(kept, order, "left_anti"))
        open_ = stored(open_.join(met, order, "left_anti"), "open")
    if n:
        gone.append(_in_turn(open_.groupBy(order).agg(F.collect_list("k").alias("k")), order))  # an item has len(keys) keys
    for out in gone:
        items = items.join(out, order, "left_anti")
    return items


def _in_turn(rows: DataFrame, order: str) -> DataFrame:
    """Of few rows (order, k), in order, those that share a key with an earlier kept one."""

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken: set = set()
        for batch in batches:
            out = []
            for at, keys in zip(batch[order], batch["k"], strict=True):
                own = {(k["a"], k["b"]) for k in keys}
                if taken & own:
                    out.append(at)
                else:
                    taken |= own
            yield pd.DataFrame({order: out}, columns=[order])

    return rows.coalesce(1).sortWithinPartitions(order).mapInPandas(drop, rows.select(order).schema)


def absorbed(pairs: DataFrame, a: str = "a", b: str = "b", few: int = 50_000) -> DataFrame:
    """(id, original_id) from pairs a < b: in the order of ids, each one that is not
    yet absorbed takes all later ones that it is paired with; an original is the
    first that takes."""
    edges = stored(pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "pairs")
    open_, gone = edges, []
    while (n := open_.count()) > few:
        later = open_.select("b").distinct()
        first = open_.select("a").distinct().join(later, F.col("a") == F.col("b"), "left_anti")
        out = stored(open_.join(first, "a", "left_semi").select("b").distinct(), "out")
        gone.append(out)
        left = open_.join(out, "b", "left_anti").join(out.toDF("a"), "a", "left_anti")
        open_ = stored(left, "open")
    if n:
        gone.append(_absorbed_in_turn(open_))
    lost = gone[0] if gone else edges.select("b").limit(0)
    for out in gone[1:]:
        lost = lost.union(out)
    lost = stored(lost, "lost")
    return edges.join(lost.toDF("a"), "a", "left_anti").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("original_id"))


def _absorbed_in_turn(pairs: DataFrame) -> DataFrame:
    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: set = set()
        for batch in batches:
            out.update(b for a, b in zip(batch["a"], batch["b"], strict=True) if a not in out)
        yield pd.DataFrame({"b": sorted(out)})

    return pairs.coalesce(1).sortWithinPartitions("a", "b").mapInPandas(take, pairs.select("b").schema)
