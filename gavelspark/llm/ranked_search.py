"""Ranked lexical search over an index in shards, with blocks of postings whose
boundaries dynamic programming chooses.

The index is a table with a row for each shard, a run of documents that one task
has read: their keys in ascending order, their lengths, and, term by term, the
documents that hold it and how often. Terms are the runs of letters, digits and
characters beyond ASCII, A-Z as a-z, as 64-bit hashes. No posting is shuffled:
what a search needs of all documents (their number and length, and the terms'
document frequencies) are sums over shards.

Postings that are asked for are cut into blocks of differing length. A block's
highest score stands for each of its postings, so its error is length times
highest less the sum; dynamic programming over the postings of a term (in runs
of 256, block lengths from a ladder) finds the cut of least error, a block
counting as much as `overhead` mean scores. An item's bound for a document is the
sum of its terms' weights times the highest scores of the blocks that the
document falls into. The documents of the highest bounds are scored first; their
k-th score, or that of one term alone, is the threshold, and only blocks that
hold a document whose bound reaches it are read further. Nothing that could be
among the k best is skipped, ties included, so the result is exact. Each shard
gives its k best; they meet in groups of shards first, then by item.

Defined results: a null or empty text has no terms and is never a result; an item
without terms has no result; equal scores are by ascending key, null keys last;
repeated rows are results each; rows with equal item ids are one item with all
their terms; texts of any length are read whole; keys and item ids may have any
type that sorts; an empty table on either side gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Words, ship, small_batches, utf8, written

_BYTES = np.arange(256)
_TERM = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES < 58)) | ((_BYTES >= 65) & (_BYTES < 91)) | ((_BYTES >= 97) & (_BYTES < 123))
_TERMS_ALONE = np.where(_TERM, _BYTES, 32).astype(np.uint8)


def terms_of(column: pa.Array) -> Words:
    """The terms of a batch of texts."""
    data, offsets = utf8(column)
    return Words(_TERMS_ALONE[data], offsets)


def _narrow(x: np.ndarray) -> bytes:
    """Numbers in the fewest bytes that hold them all."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if int(x.max(initial=0)) <= np.iinfo(k).max)
    return x.astype(kind).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


# --- index ----------------------------------------------------------------------------------------


class _Shard:
    """Documents of a task until they are enough."""

    def __init__(self):
        self.keys, self.hashes, self.lengths, self.docs, self.terms = [], [], [], 0, 0

    def add(self, keys: pa.Array, words: Words) -> None:
        self.keys.append(keys)
        self.hashes.append(words.hashes)
        self.lengths.append(np.diff(words.first))
        self.docs += len(keys)
        self.terms += len(words.hashes)

    def columns(self) -> list[pa.Array]:
        keys = pa.chunked_array(self.keys).combine_chunks()
        order = pc.sort_indices(pa.table({"key": keys}), sort_keys=[("key", "ascending")], null_placement="at_end")
        place = np.empty(len(keys), np.int64)
        place[order.to_numpy()] = np.arange(len(keys))
        lengths = np.concatenate(self.lengths)
        hashes, docs = np.concatenate(self.hashes), np.repeat(place, lengths)
        by_term = np.argsort(hashes)
        hashes = hashes[by_term]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        terms = hashes[new]
        pairs = np.sort(((np.cumsum(new) - 1) << 32) | docs[by_term])  # by term, then document
        first = np.ones(len(pairs), bool)
        first[1:] = pairs[1:] != pairs[:-1]
        at = np.flatnonzero(first)
        times = np.diff(at, append=len(pairs))
        ends = np.cumsum(np.bincount(pairs[at] >> 32, minlength=len(terms)))
        in_order = np.empty(len(keys), np.int64)
        in_order[place] = lengths
        blobs = (terms.astype("<u8").tobytes(), _narrow(ends), _narrow(pairs[at] & 0xFFFFFFFF), _narrow(times), _narrow(in_order))
        numbers = (len(keys), int((lengths > 0).sum()), int(lengths.sum()), len(terms))
        return [
            *[pa.array([x], pa.int64()) for x in numbers],
            pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys.take(order)), *[pa.array([b], pa.binary()) for b in blobs],
        ]


_INDEX = ["n_docs", "n_with_terms", "n_terms", "n_distinct", "keys", "terms", "ends", "docs", "times", "lengths"]


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_docs: int = 8192, shard_terms: int = 1 << 22) -> DataFrame:
    """The index of all rows, a shard for each `shard_docs` documents of a task
    (fewer, where they hold `shard_terms` terms), as a written table."""
    ship(docs.sparkSession)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, own = TaskContext.get().partitionId(), 0, _Shard()

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + done], pa.int64()), *own.columns()], ["shard", *_INDEX])

        for whole in batches:
            for batch in small_batches(whole, "text", 1 << 20):
                at = 0
                while at < len(batch):
                    piece = batch.slice(at, shard_docs - own.docs)
                    at += len(piece)
                    own.add(piece.column("key"), terms_of(piece.column("text")))
                    if own.docs >= shard_docs or own.terms >= shard_terms:
                        yield closed()
                        done, own = done + 1, _Shard()
        if own.docs:
            yield closed()

    kind = docs.select(key).schema[0].dataType.simpleString()
    schema = f"shard long, n_docs long, n_with_terms long, n_terms long, n_distinct long, keys array<{kind}>, terms binary, ends binary, docs binary, times binary, lengths binary"
    return written(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(index, schema), "index")


# --- blocks ---------------------------------------------------------------------------------------

LADDER = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128])  # lengths of blocks
RUN = 256
_FAR = np.int32(1_000_000_000)


def choose_blocks(scores: np.ndarray, first: np.ndarray, overhead: int = 16, abreast: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks begin (and the end of all), and how many each list has, for the
    lists scores[first[i]:first[i + 1]]. Least sum of (length * highest score) and
    `overhead` mean scores a block, over all cuts with lengths of the ladder."""
    sizes = np.diff(first)
    parts = -(-sizes // RUN)
    of_list = np.repeat(np.arange(len(sizes)), parts)
    begin = first[of_list] + (np.arange(len(of_list)) - np.repeat(np.cumsum(parts) - parts, parts)) * RUN
    length = np.minimum(RUN, first[of_list + 1] - begin)
    order = np.argsort(-length, kind="stable")
    cuts, owners = [], []
    for at in range(0, len(order), abreast):
        runs = order[at : at + abreast]
        n = length[runs]
        longest = int(n[0])
        inside = np.arange(longest)[:, None] < n
        values = np.zeros((longest, len(runs)), np.int32)
        values[inside] = scores[(begin[runs] + np.arange(longest)[:, None])[inside]]
        price = (overhead * values.sum(axis=0, dtype=np.int64) // n).astype(np.int32)
        highest = {1: values}  # over so many values that end here
        width = 1
        while 2 * width <= min(64, longest):
            wider = highest[width].copy()
            wider[width:] = np.maximum(wider[width:], highest[width][:-width])
            highest[2 * width] = wider
            width *= 2
        best = np.full((longest + 1, len(runs)), _FAR, np.int32)
        best[0] = 0
        choice = np.zeros((longest + 1, len(runs)), np.uint8)
        alive = np.searchsorted(-n, -np.arange(1, longest + 1), side="right")  # runs are sorted by length, longest first
        for i in range(1, longest + 1):
            a = int(alive[i - 1])
            low = best[i, :a]
            for k, size in enumerate(LADDER.tolist()):
                if size > i:
                    break
                half = 1 << (size.bit_length() - 1)
                half = min(half, 64)
                top = highest[half][i - 1, :a]
                if size > half:
                    top = np.maximum(top, highest[half][i - 1 - (size - half), :a])
                cost = best[i - size, :a] + size * top + price[:a]
                better = cost < low
                low[better] = cost[better]
                choice[i, :a][better] = k
        column, place = np.arange(len(runs)), n.copy()
        while len(column):
            place -= LADDER[choice[place, column]]
            cuts.append(begin[runs[column]] + place)
            owners.append(of_list[runs[column]])
            column, place = column[place > 0], place[place > 0]
    starts = np.concatenate(cuts) if cuts else np.zeros(0, np.int64)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    return np.append(np.sort(starts), first[-1]), np.bincount(owner, minlength=len(sizes))


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    n = ends - starts
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())


# --- search ---------------------------------------------------------------------------------------


class Items:
    """What a block of items asks for: terms with their weights, and each item's own."""

    def __init__(self, names: list, of_item: np.ndarray, terms: np.ndarray, total_docs: int, total_terms: int):
        self.names, self.total_docs, self.total_terms = names, total_docs, total_terms
        self.terms, own = np.unique(terms, return_inverse=True)
        order = np.argsort(of_item, kind="stable")
        self.own, self.first = own[order], np.searchsorted(of_item[order], np.arange(len(names) + 1))
        self.weights = np.zeros(len(self.terms), np.int64)

    def weigh(self, frequencies: dict[int, int]) -> None:
        df = np.array([frequencies.get(int(t), 0) for t in self.terms.view(np.int64)], np.float64)
        self.weights = np.floor(1000 * np.log((2 * self.total_docs + 2) / (2 * df + 1))).astype(np.int64)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, highest first, equal ones in order."""
    some = np.flatnonzero(scores > 0)
    if len(some) > k:
        least = np.partition(scores[some], len(some) - k)[len(some) - k]
        above, level = some[scores[some] > least], some[scores[some] == least]
        some = np.concatenate([above, level[: k - len(above)]])
    return some[np.lexsort((some, -scores[some]))]


class Postings:
    """A shard's postings of the terms that a block of items asks for, in blocks."""

    def __init__(self, row: dict, items: Items, k: int, overhead: int):
        self.items, self.k = items, k
        own = np.frombuffer(row["terms"], "<u8")
        at = np.searchsorted(own, items.terms)
        here = np.flatnonzero(own[np.minimum(at, len(own) - 1)] == items.terms) if len(own) else np.zeros(0, np.int64)
        self.list_of = np.full(len(items.terms), -1)
        self.list_of[here] = np.arange(len(here))
        self.weights = items.weights[here]
        ends = _wide(row["ends"], row["n_distinct"])
        starts = np.where(at[here] > 0, ends[at[here] - 1], 0)
        n = ends[at[here]] - starts
        total = int(ends[-1]) if len(ends) else 0
        picked = _ranges(starts, ends[at[here]])
        self.docs, times = _wide(row["docs"], total)[picked], _wide(row["times"], total)[picked]
        lengths = _wide(row["lengths"], row["n_docs"])
        self.n_docs = len(lengths)
        m = 100 - 50 + (50 * lengths * items.total_docs) // max(1, items.total_terms)
        self.scores = (1_000_000_000 * times) // (1000 * times + 20 * m[self.docs])
        first = np.concatenate([[0], np.cumsum(n)])
        cuts, blocks = choose_blocks(self.scores, first, overhead)
        self.begin, self.end = cuts[:-1], cuts[1:]
        self.block_first = np.concatenate([[0], np.cumsum(blocks)])
        self.highest = np.maximum.reduceat(self.scores, self.begin) if len(self.begin) else np.zeros(0, np.int64)
        self.low, self.high = self.docs[self.begin], self.docs[self.end - 1]
        self.kth = np.zeros(len(here), np.int64)  # of each term alone
        for i in np.flatnonzero(n >= k):
            self.kth[i] = np.partition(self.scores[first[i] : first[i + 1]], n[i] - k)[n[i] - k]

    def search(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        """The item's k best documents of the shard, and their scores."""
        lists = self.list_of[self.items.own[self.items.first[item] : self.items.first[item + 1]]]
        lists = lists[lists >= 0]
        lists = lists[self.weights[lists] > 0]
        if not len(lists):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        blocks = _ranges(self.block_first[lists], self.block_first[lists + 1])
        weight = np.repeat(self.weights[lists], self.block_first[lists + 1] - self.block_first[lists])
        low, high, most = self.low[blocks], self.high[blocks], weight * self.highest[blocks]
        change = np.zeros(self.n_docs + 1, np.int64)
        np.add.at(change, low, most)
        np.add.at(change, high + 1, -most)
        bound = np.cumsum(change)[:-1]
        scores, threshold = np.zeros(self.n_docs, np.int64), max(1, int((self.weights[lists] * self.kth[lists]).max()))

        def score(wanted: np.ndarray) -> None:
            before = np.concatenate([[0], np.cumsum(wanted)])
            live = before[high + 1] > before[low]
            postings = _ranges(self.begin[blocks[live]], self.end[blocks[live]])
            by = np.repeat(weight[live], self.end[blocks[live]] - self.begin[blocks[live]])
            use = wanted[self.docs[postings]]
            np.add.at(scores, self.docs[postings[use]], by[use] * self.scores[postings[use]])

        probe = 4 * self.k
        first = np.zeros(self.n_docs, bool)
        if self.n_docs > 2 * probe:
            first = bound >= max(threshold, int(np.partition(bound, self.n_docs - probe)[self.n_docs - probe]))
            if 4 * int(first.sum()) < self.n_docs:
                score(first)
                threshold = max(threshold, int(np.partition(scores, self.n_docs - self.k)[self.n_docs - self.k]))
            else:
                first[:] = False
        rest = (bound >= threshold) & ~first
        if rest.any():
            score(rest)
        best = _best(scores, self.k)
        return best, scores[best]


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item and term, once each, of all items."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, "text", 1 << 20):
                words = terms_of(batch.column("text"))
                at = pa.array(np.repeat(np.arange(len(batch)), np.diff(words.first)))
                yield pa.RecordBatch.from_arrays([batch.column("item").take(at), pa.array(words.hashes.view(np.int64))], ["item", "term"])

    kind = items.select(item).schema[0].dataType.simpleString()
    return items.select(F.col(item).alias("item"), F.col(text).alias("text")).mapInArrow(split, f"item {kind}, term long").distinct()


def _frequencies(index: DataFrame, asked: Broadcast) -> dict[int, int]:
    """Documents that hold a term, for the terms asked for."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = asked.value.terms
        for batch in batches:
            for row in batch.to_pylist():
                own, ends = np.frombuffer(row["terms"], "<u8"), _wide(row["ends"], row["n_distinct"])
                at = np.searchsorted(own, terms)
                here = np.flatnonzero(own[np.minimum(at, len(own) - 1)] == terms) if len(own) else np.zeros(0, np.int64)
                n = np.diff(ends, prepend=0)[at[here]]
                yield pa.RecordBatch.from_arrays([pa.array(terms[here].view(np.int64)), pa.array(n)], ["term", "n"])

    found = index.select("terms", "ends", "n_distinct").mapInArrow(count, "term long, n long")
    return {r[0]: r[1] for r in found.groupBy("term").agg(F.sum("n")).collect()}  # as many as the block of items has


def search_index(index: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", item: str = "item_id", item_text: str = "text", overhead: int = 16, most_terms: int = 1 << 20) -> DataFrame:
    """item, rank (from 1), key and score of each item's k best documents. Items go
    to the shards in blocks of about `most_terms` terms, one in memory at a time."""
    spark = items.sparkSession
    ship(spark)
    total_docs, total_terms, shards = index.agg(F.coalesce(F.sum("n_with_terms"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0)), F.count(F.lit(1))).first()
    key_field = T.StructField("key", index.schema["keys"].dataType.elementType)
    item_field = T.StructField("item", items.schema[item].dataType)
    schema = T.StructType([item_field, key_field, T.StructField("score", T.LongType()), T.StructField("shard", T.LongType())])
    item_type, key_type = to_arrow_type(item_field.dataType), to_arrow_type(key_field.dataType)
    asked = written(item_terms(items, item, item_text), "asked")
    n_blocks = -(-asked.count() // most_terms)
    groups = max(1, int(np.ceil(np.sqrt(shards))))

    def found_by(shared: Broadcast) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(len(batch)):
                    part = batch.slice(i, 1)
                    keys = part.column("keys").flatten()
                    row = {c: part.column(c)[0].as_py() for c in part.schema.names if c != "keys"}
                    postings = Postings(row, shared.value, k, overhead)
                    hits = [postings.search(j) for j in range(len(shared.value.names))]
                    sizes = [len(docs) for docs, _ in hits]
                    docs = pa.array(np.concatenate([d for d, _ in hits]) if hits else np.zeros(0, np.int64))
                    names = pa.array(shared.value.names, item_type).take(pa.array(np.repeat(np.arange(len(hits)), sizes)))
                    scores = pa.array(np.concatenate([s for _, s in hits]) if hits else np.zeros(0, np.int64))
                    yield pa.RecordBatch.from_arrays([names, keys.take(docs).cast(key_type), scores, pa.array(np.full(len(docs), row["shard"]))], ["item", "key", "score", "shard"])

        return index.drop("n_with_terms", "n_terms").mapInArrow(search, schema)

    best = [F.desc("score"), F.asc_nulls_last("key")]
    out, held = spark.createDataFrame([], schema), None
    for b in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b).toArrow()
        names = pc.unique(rows.column("item"))
        places = {name: i for i, name in enumerate(names.to_pylist())}
        of_item = np.array([places[i] for i in rows.column("item").to_pylist()], np.int64)
        block = Items(names.to_pylist(), of_item, rows.column("term").to_numpy().view(np.uint64), total_docs, total_terms)
        asking = spark.sparkContext.broadcast(block)
        block.weigh(_frequencies(index, asking))
        asking.destroy()
        if held is not None:  # more than one block: each is searched and let go before the next comes
            out = out.unionByName(written(found_by(held), "ranked"))
            held.destroy()
        held = spark.sparkContext.broadcast(block)
    if held is not None:
        out = out.unionByName(found_by(held))
    few = Window.partitionBy("item", F.pmod(F.xxhash64("shard"), F.lit(groups))).orderBy(*best)
    every = Window.partitionBy("item").orderBy(*best)
    out = out.withColumn("place", F.row_number().over(few)).where(F.col("place") <= k)
    out = out.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= k)
    return out.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """Index all docs, then rank them for each item."""
    return search_index(build_index(docs, key, text), items, k, key, **limits)
