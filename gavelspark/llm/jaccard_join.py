"""Documents whose sets of five-word shingles have a Jaccard similarity of 0.8
or more, through a MinHash LSH forest.

Each tree of the forest sorts documents by a sequence of minhashes; those that
share a prefix share a node of the tree's prefix trie. Matching begins at the
full depth. In a trie node, sketches (the low bytes of all minhashes) tell
which members are likely near; likely neighbours form neighbourhoods. Then the
matched prefixes are shortened, step by step, down to the depth at which a pair
at the threshold itself shares a node in some tree with the target chance. How
far a trie node is matched depends on what longer prefixes have shown: a node
whose members are all of one neighbourhood is done, since every pair of a
neighbourhood is verified anyway, and in others only pairs of different
neighbourhoods are compared. So dense groups are met in long prefixes, in small
nodes, yet no pair of documents is left out at the last depth because either has
other neighbours.
 Each document's shingle set is brought to
its neighbourhood once for each block of it, and every pair there is verified on
whole sets, block against block, so no task holds a large neighbourhood alone.
Documents with equal sets are one class from the start, so exact copies cost
nothing further.

Shingles are 64-bit hashes of words (A-Z as a-z), classes 128-bit digests of
sorted shingle sets.

Defined results: a null text is an empty one; texts without words are copies of
each other and near nothing else; a text of one to four words has one shingle,
of all its words; texts of any length are shingled whole; repeated rows, also
with equal keys, are copies; null keys are rows like others (a class id is the
lowest key that is not null); a pair at the threshold itself is near; keys may
have any type that sorts; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, join_by_heat, mix, ship, shingles, small_batches, utf8, written
from .components import connected_components

TREES, DEEPEST = 16, 8


def prefix_depth(threshold: float, recall: float, trees: int = TREES, deepest: int = DEEPEST) -> int:
    """The longest prefix at which a pair of that similarity shares a node of
    at least one tree with the target chance."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _masks(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return seeds[:n], seeds[n:] | np.uint64(1)


def minhashes(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """n minima for each run of values that begins at starts (none empty): n x runs."""
    flip, times = _masks(n)
    out = np.empty((n, len(starts)), dtype=np.uint64)
    for k in range(n):
        out[k] = np.minimum.reduceat((values ^ flip[k]) * times[k], starts)
    return out


def trie_depths(threshold: float, recall: float) -> list[int]:
    """The prefix lengths that are matched, one after the other."""
    least = prefix_depth(threshold, recall)
    return [*range(DEEPEST, least, -2), least]


def signatures(docs: DataFrame, key: str, text: str, size: int, depths: list[int]) -> DataFrame:
    """key, text_hash, node (the class's digest; zeros: no words), weight
    (shingles), a prefix hash for each depth and tree, and the sketch."""
    schema = f"key {dict(docs.dtypes)[key]}, text_hash long, node binary, weight int, prefixes array<long>, sketch binary"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, "text", 1 << 20):
                values, first = shingles(Words(*utf8(batch.column("text"))), size)
                nodes, weights = [bytes(16)] * len(batch), np.zeros(len(batch), np.int32)
                full = np.flatnonzero(np.diff(first))
                for i in full:
                    own = np.unique(values[first[i] : first[i + 1]])
                    weights[i] = len(own)
                    nodes[i] = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                low = minhashes(values, first[full], TREES * DEEPEST) if len(full) else np.zeros((TREES * DEEPEST, 0), np.uint64)
                paths = low.reshape(TREES, DEEPEST, -1)
                keys, at = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64)[:, None], (TREES, len(full))), {}
                for d in range(DEEPEST):
                    keys = mix(keys * np.uint64(31) + paths[:, d])
                    at[d + 1] = keys
                chosen = np.concatenate([at[d] for d in depths]).T  # a row for each text: depth after depth
                lengths, sketches = np.zeros(len(batch), np.int32), [b""] * len(batch)
                lengths[full] = chosen.shape[1]
                for i, sketch in zip(full, low.astype(np.uint8).T, strict=True):
                    sketches[i] = sketch.tobytes()
                prefixes = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), pa.array(np.ascontiguousarray(chosen).ravel().view(np.int64)))
                columns = [batch.column("key"), batch.column("text_hash"), pa.array(nodes, pa.binary()), pa.array(weights), prefixes, pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "text_hash", "node", "weight", "prefixes", "sketch"])

    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(sign, schema)


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of one width as rows of bytes."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), width)


def _match(threshold: float):
    """Likely neighbours inside trie nodes. Rows are sorted by trie node and
    block pair (p, i, j), so a node's members stand together; only a node that
    continues in the next batch is held back."""
    hashes = TREES * DEEPEST
    likely = threshold - 4 * (threshold * (1 - threshold) / hashes) ** 0.5

    def matched(rows: pa.Table) -> pa.RecordBatch:
        where = np.stack([rows.column(c).to_numpy() for c in ("p", "i", "j")])
        group = np.concatenate([[0], np.cumsum((where[:, 1:] != where[:, :-1]).any(axis=0))])
        block, around = rows.column("block").to_numpy(), rows.column("around").to_numpy()
        inside = where[1] == where[2]
        nodes, sketches = (_fixed(rows.column(c).combine_chunks(), w) for c, w in (("node", 16), ("sketch", hashes)))
        left, right = [], []
        for step in range(1, int(np.bincount(group).max())):
            a = np.flatnonzero((group[:-step] == group[step:]) & (around[:-step] != around[step:]))
            b = a + step
            use = inside[a] | (block[a] != block[b])
            a, b = a[use], b[use]
            near = ((sketches[a] == sketches[b]).mean(axis=1) - 1 / 256) / (1 - 1 / 256) >= likely
            left.append(a[near])
            right.append(b[near])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        label = np.arange(len(group))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        some = np.flatnonzero(label != np.arange(len(group)))
        names = [pa.array(nodes[at].view("V16").ravel().tolist(), pa.binary()) for at in (some, label[some])]
        return pa.RecordBatch.from_arrays(names, ["node", "peer"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if not len(held):
                continue
            last = np.ones(len(held), bool)
            for c in ("p", "i", "j"):
                x = held.column(c).to_numpy()
                last &= x == x[-1]
            done = len(held) - int(last[::-1].argmin()) if not last.all() else 0
            if done:
                yield matched(held.slice(0, done).combine_chunks())
                held = held.slice(done)
        if held is not None and len(held):
            yield matched(held.combine_chunks())

    return match


def neighbourhoods(nodes: DataFrame, depths: list[int], threshold: float, block_rows: int) -> DataFrame:
    """node, root: those of nodes (node, prefixes, sketch) that have likely
    neighbours, with the root of their neighbourhood, from tries whose matched
    prefixes are shortened where members are not yet of one neighbourhood."""
    at = lambda depth: F.explode(F.slice("prefixes", depths.index(depth) * TREES + 1, TREES))
    roots = nodes.select("node", at(depths[-1]).alias("p"))
    shared = roots.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    total = nodes.count() * TREES
    some = join_by_heat(roots, shared, "p", "n", total).select("node").distinct()
    # Only these share a prefix with any other; deeper prefixes are theirs alone.
    nodes = written(nodes.join(some, "node", "left_semi"), "forest")
    total, found = nodes.count() * TREES, None
    for depth in depths:
        known = nodes if found is None else nodes.join(found, "node", "left")
        root = F.col("node") if found is None else F.coalesce("root", "node")
        members = known.select("node", "sketch", F.xxhash64(root).alias("around"), at(depth).alias("p"))
        sizes = members.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("around").alias("low"), F.max("around").alias("high")).where("low < high").select("p", "n")
        placed = join_by_heat(members, sizes, "p", "n", total)
        blocks = F.ceil(F.col("n") / block_rows).cast("int")
        placed = placed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = placed.select("p", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "around", "node", "sketch")
        matched = dealt.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j").mapInArrow(_match(threshold), "node binary, peer binary")
        edges = matched if found is None else matched.union(found)
        found = written(connected_components(edges, "node", "peer"), "around")
    return found


def _labels(near: np.ndarray) -> np.ndarray:
    """The component of each row of a square 0/1 matrix, named by its first row."""
    label = np.full(len(near), -1)
    for i in range(len(near)):
        if label[i] < 0:
            front = np.zeros(len(near), bool)
            front[i] = True
            while front.any():
                label[front] = i
                front = near[front].any(axis=0) & (label < 0)
    return label


def _similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of shingle sets are near: a square matrix without a diagonal."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    if m <= 6:
        shared = np.zeros((m, m))
        for i in range(m):
            for j in range(i):
                shared[i, j] = shared[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        value, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.cumsum(times > 1) - 1  # a shingle of one set alone is shared with none
        row, used = np.repeat(np.arange(m), sizes), (times > 1)[place]
        row, place = row[used], column[place[used]]
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        shared, width = np.zeros((m, m), np.int64), 8192
        for at in range(0, int(place[-1]) + 1 if len(place) else 0, width):
            part = slice(*np.searchsorted(place, [at, at + width]))
            block = np.zeros((m, width), np.float32)
            block[row[part], place[part] - at] = 1
            shared += (block @ block.T).astype(np.int64)  # at most `width`, so exact
    near = shared * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-6
    np.fill_diagonal(near, False)
    return near


def _verify(threshold: float):
    def verify(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, own in group.groupby("root", sort=False):
            own = own.drop_duplicates("node").sort_values("node")
            nodes, block = own["node"].to_numpy(), own["block"].to_numpy()
            near = _similar([np.frombuffer(b, np.uint64) for b in own["shingles"]], threshold)
            if own["i"].iloc[0] != own["j"].iloc[0]:  # pairs inside a block are met in its own group
                near &= block[:, None] != block[None, :]
            links = near.sum(axis=1)
            some = links > 0
            out.append(pd.DataFrame({"node": nodes[some], "peer": nodes[_labels(near)][some], "links": links[some]}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "peer": [], "links": []})

    return verify


def _with_shingles(rows: DataFrame, size: int) -> DataFrame:
    names = ["node", "root", "blocks"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for whole in batches:
            for batch in small_batches(whole, "text", 1 << 20):
                nodes = batch.column("node").to_pylist()
                fresh = [i for i, n in enumerate(nodes) if n not in seen and not seen.add(n)]  # repeated rows stand together
                if fresh:
                    batch = batch.take(pa.array(fresh))
                    values, first = shingles(Words(*utf8(batch.column("text"))), size)
                    sets = [np.unique(values[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sets, pa.binary())], [*names, "shingles"])

    return rows.select(*names, "text").mapInArrow(add, "node binary, root binary, blocks int, shingles binary")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.999, block_rows: int = 1024, block_shingles: int = 4 << 20) -> DataFrame:
    """One row for each row of docs: its key, class_id (the lowest key of all that
    are linked, directly or through others), n_copies (rows with the same
    shingles, itself included), n_links (other shingle sets that are near) and
    is_first: the one row of its class to keep."""
    ship(docs.sparkSession)
    depths = trie_depths(threshold, recall)
    signed = written(signatures(docs, key, text, size, depths), "signed")
    n_rows = signed.count()
    nodes = signed.groupBy("node").agg(
        F.count(F.lit(1)).alias("n_copies"), F.min(F.struct("key", "text_hash")).alias("head"), F.min("key").alias("low"),
        F.first("weight").alias("weight"), F.first("prefixes").alias("prefixes"), F.first("sketch").alias("sketch"),
    )
    nodes = written(nodes, "nodes")
    around = neighbourhoods(nodes.where("weight > 0").select("node", "prefixes", "sketch"), depths, threshold, block_rows)

    inside = written(nodes.join(around, "node").select("node", "root", "weight", "head"), "inside")
    volume = inside.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    volume = volume.select("root", "n", F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("w") / block_shingles)).cast("int").alias("blocks"))
    wanted = join_by_heat(inside, volume, "root", "n", inside.count()).select("node", "root", "blocks", F.col("head.key").alias("k"), F.col("head.text_hash").alias("h"))
    wanted = written(wanted, "wanted")
    total = inside.agg(F.sum("weight")).first()[0] or 0
    bundles = max(64, int(total // (1 << 20)))  # neighbourhoods of one block share tasks
    texts = docs.select(F.col(key).alias("k2"), F.xxhash64(F.col(text)).alias("h2"), F.col(text).alias("text"))
    rows = texts.join(wanted.hint("merge"), F.col("k2").eqNullSafe(F.col("k")) & (F.col("h2") == F.col("h")))
    sets = _with_shingles(rows, size)
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        sets.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "node", "root", "block", "shingles", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
            F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(bundles))).otherwise(F.xxhash64("root")).alias("bundle"), (F.col("blocks") == 1).alias("small"),
        )
    )
    links = written(dealt.groupBy("small", "bundle", "i", "j").applyInPandas(_verify(threshold), "node binary, peer binary, links long"), "links")
    joined = connected_components(links.select("node", "peer"), "node", "peer")
    degree = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    known = (
        nodes.select("node", "n_copies", "head", "low").join(joined, "node", "left").join(degree, "node", "left")
        .withColumn("root", F.coalesce("root", "node")).withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))
    )
    known = written(known, "known")
    classes = known.groupBy("root").agg(F.min("low").alias("class_id"), F.min("head").alias("class_head"), F.count(F.lit(1)).alias("n"))
    known = join_by_heat(known, classes, "root", "n", known.count()).select("node", "class_id", "class_head", "n_copies", "n_links")
    return join_by_heat(signed.select("key", "text_hash", "node"), known, "node", "n_copies", n_rows).select(
        F.col("key").alias(key), "class_id", "n_copies", "n_links",
        (F.col("key").eqNullSafe(F.col("class_head.key")) & F.col("text_hash").eqNullSafe(F.col("class_head.text_hash"))).alias("is_first"), "text_hash",
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """One row of each class, with docs' own columns: the lowest key's; of rows
    with that key and text, any one."""
    first = near_duplicates(docs, key, text, **limits).where("is_first").select(F.col(key).alias("_key"), F.col("text_hash").alias("_hash")).distinct()
    own = docs.columns
    rows = docs.select(F.col(key).alias("_k"), F.xxhash64(F.col(text)).alias("_h"), F.struct(*own).alias("_own"))
    met = first.join(rows, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_h") == F.col("_hash")))
    return met.dropDuplicates(["_k", "_h"]).select("_own.*")
