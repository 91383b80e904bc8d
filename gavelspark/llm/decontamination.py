"""Benchmark items inside documents, through size-partitioned MinHash
containment search.

Items are partitioned by the size of their shingle set, in powers of two. For
each class, documents are cut into overlapping windows of up to four times the item's
size, so an item inside a window has a Jaccard similarity of about a fifth or
more with it, however long the document. A window is a candidate for an item
if any of `hashes` minhashes agree, which misses such an item with a chance of
0.8 ** hashes. Each candidate is verified by the exact share of the item's
shingles that the whole document contains. Items of fewer than eight shingles,
which a window of 16 shows too faintly, are looked up exactly instead: each of
their shingles in the documents' own.

The items are the stated query set: they go to all tasks in blocks of bounded
size, one pass over the documents for each block.

Defined results: null texts are empty; items of fewer than five words have no
shingle and are never found, and neither do such documents contain any;
repeated items each give a row, repeated documents too; an item contained by
just the threshold is found; null keys are carried, keys and item ids may have
any type; texts of any length are searched whole; an empty table on either side
finds nothing; other columns, whatever their names, pass through `decontaminate`
and are otherwise ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Words, ship, shingles, small_batches, utf8, written
from .jaccard_join import minhashes


#: Items of fewer shingles are found by each of them.
_EXACT = 8


class ItemIndex:
    """Items by size class, with their minhashes sorted for each hash; small
    ones with all their shingles, sorted."""

    def __init__(self, texts: list[str | None], size: int, hashes: int):
        self.size, self.hashes = size, hashes
        words = Words(*utf8(pa.array(texts, pa.string())))
        values, first = shingles(words, size)
        enough = np.diff(words.first) >= size
        self.sets = [np.unique(values[a:b]) if ok else np.zeros(0, np.uint64) for a, b, ok in zip(first[:-1], first[1:], enough, strict=True)]
        self.classes = []
        size_of = np.array([len(s) for s in self.sets], dtype=np.int64)
        small = np.flatnonzero((size_of > 0) & (size_of < _EXACT))
        values = np.concatenate([self.sets[i] for i in small]) if len(small) else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        self.small_values, self.small_items = values[order], np.repeat(small, size_of[small])[order]
        for power in range(_EXACT.bit_length() - 1, int(size_of.max(initial=0)).bit_length()):
            own = np.flatnonzero((size_of >= 1 << power) & (size_of < 2 << power))
            if len(own):
                joined = np.concatenate([self.sets[i] for i in own])
                starts = np.concatenate([[0], np.cumsum(size_of[own])[:-1]])
                low = minhashes(joined, starts, hashes)
                order = np.argsort(low, axis=1)
                self.classes.append((max(16, 2 << power), np.take_along_axis(low, order, 1), own[order]))

    def found(self, column: pa.Array, threshold: float) -> list[tuple[int, int, float]]:
        """(row, item, containment) of the items that the texts contain."""
        words = Words(*utf8(column))
        values, first = shingles(words, self.size)
        counts = np.where(np.diff(words.first) >= self.size, np.diff(first), 0)
        rows = np.flatnonzero(counts)
        if not len(rows) or not (self.classes or len(self.small_values)):
            return []
        pairs: set[tuple[int, int]] = set()
        if len(self.small_values):
            left = np.searchsorted(self.small_values, values, side="left")
            right = np.searchsorted(self.small_values, values, side="right")
            at = np.flatnonzero(right > left)
            for i, a, b in zip(np.searchsorted(first, at, side="right") - 1, left[at], right[at], strict=True):
                if counts[i]:
                    pairs.update((int(i), int(q)) for q in self.small_items[a:b])
        for stride, low, items in self.classes:
            parts = -(-counts[rows] // stride)
            row = np.repeat(rows, parts)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            starts = first[row] + inside * stride
            minima = minhashes(values, starts, self.hashes)  # a run ends where the next begins
            same = row[1:] == row[:-1]
            windows = minima.copy()
            windows[:, :-1][:, same] = np.minimum(minima[:, :-1], minima[:, 1:])[:, same]
            for k in range(self.hashes):
                left = np.searchsorted(low[k], windows[k], side="left")
                right = np.searchsorted(low[k], windows[k], side="right")
                for w in np.flatnonzero(right > left):
                    pairs.update((int(row[w]), int(i)) for i in items[k, left[w] : right[w]])
        out = []
        for i, q in sorted(pairs):
            share = float(np.isin(self.sets[q], values[first[i] : first[i + 1]]).mean())
            if share >= threshold - 1e-9:
                out.append((i, q, share))
        return out


def _blocks(items: DataFrame, item: str, text: str, most_bytes: int) -> Iterator[tuple[list, list[str]]]:
    """The items in blocks of about most_bytes of text."""
    n, total = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()
    blocks = max(1, -(-total // most_bytes))
    for b in range(blocks if n else 0):
        part = items.where(F.pmod(F.xxhash64(F.col(item), F.col(text)), F.lit(blocks)) == b).select(item, text).collect()
        if part:
            yield [r[0] for r in part], [r[1] for r in part]


def contained_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 5, threshold: float = 0.8, hashes: int = 48, most_bytes: int = 16 << 20) -> DataFrame:
    """key, item, containment for every item of which a document holds at least
    `threshold` of the shingles."""
    spark = docs.sparkSession
    ship(spark)
    item_type = to_arrow_type(items.schema[item].dataType)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("item", items.schema[item].dataType), T.StructField("containment", T.DoubleType())])

    def found_by(shared: Broadcast) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, index = shared.value
            for whole in batches:
                for batch in small_batches(whole, "text", 1 << 20):
                    hits = index.found(batch.column("text"), threshold)
                    if hits:
                        at = pa.array([i for i, _, _ in hits])
                        yield pa.RecordBatch.from_arrays([batch.column("key").take(at), pa.array([names[q] for _, q, _ in hits], item_type), pa.array([s for _, _, s in hits])], ["key", "item", "containment"])

        return rows.mapInArrow(search, schema)

    out, held = spark.createDataFrame([], schema), None
    for ids, texts in _blocks(items, item, item_text, most_bytes):
        if held is not None:  # more than one block: each is searched and let go before the next comes
            out = out.unionByName(written(found_by(held), "contained"))
            held.destroy()
        held = spark.sparkContext.broadcast((ids, ItemIndex(texts, size, hashes)))
    if held is not None:
        out = out.unionByName(found_by(held))
    return out.select(F.col("key").alias(key), F.col("item").alias(item), "containment")


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 5, threshold: float = 0.8, hashes: int = 48, most_bytes: int = 16 << 20) -> DataFrame:
    """docs without the rows that contain an item."""
    spark, own = docs.sparkSession, docs.columns
    ship(spark)
    held = None
    for _, texts in _blocks(items, item, item_text, most_bytes):
        if held is not None:
            docs = written(_without(docs, held, own.index(text), threshold), "clean")
            held.destroy()
        held = spark.sparkContext.broadcast(ItemIndex(texts, size, hashes))
    return docs if held is None else _without(docs, held, own.index(text), threshold)


def _without(docs: DataFrame, shared: Broadcast, at: int, threshold: float) -> DataFrame:
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            alone = pa.RecordBatch.from_arrays([whole.column(at)], ["text"])
            done = 0
            for batch in small_batches(alone, "text", 1 << 20):
                bad = {i for i, _, _ in shared.value.found(batch.column("text"), threshold)}
                kept = whole.slice(done, len(batch)).filter(pa.array([i not in bad for i in range(len(batch))]))
                done += len(batch)
                if len(kept):
                    yield kept

    return docs.mapInArrow(clean, docs.schema)
