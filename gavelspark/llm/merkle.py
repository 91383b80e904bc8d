"""A Merkle manifest of a table: proofs for every row, by supersteps over RDDs.

A row's leaf is the hash of its fields. The leaves of a tree (one for each
language) stand in the order of their keys; while a level has more than one
node, every `fanout` consecutive ones, the last run as many as are left, have
their hash for a parent. The trees' tops, in the order of their names, are the
leaves of one more tree, whose top is the root of all.

Vertices (tree, level, index) work in supersteps. Upwards, children message
their hashes to their parents; a parent that has all its children hashes them
and forwards its own. Downwards, parents send to each child the hashes of its
siblings and the path that they got from above, until each leaf holds its proof.
Five levels are dealt to tasks by the ancestor they have in common, so a
superstep inside such a band moves nothing, and a leaf's path is made in the
task that holds the leaf; only each fifth superstep shuffles, 4,096 times fewer
vertices. Levels are checkpointed to the cluster's shared folder.

Positions come from one sort by ranges and counts of (tree, range), so no task
holds a tree, and a language with a third of all rows is spread like any other.

Defined results: null fields are `-` in the hash, so null and empty differ; rows
of a null language are a tree of their own, the first; null keys come first in
their tree; rows with equal keys are in the order of their hashes, and repeated
rows are leaves each; texts of any length are hashed whole; a tree of one leaf is
that leaf; an empty table gives an empty result; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, ship, written

FANOUT, BAND = 8, 5
SIZE = 32  # bytes of a digest

Vertex = tuple[str, int, int]  # tree, level (leaves: 0), index in the level


def digest(parts: bytes) -> bytes:
    """H of digests one after the other, as hex text."""
    return hashlib.sha256(parts.hex().encode()).digest()


def nodes_at(leaves: int, level: int) -> int:
    for _ in range(level):
        leaves = -(-leaves // FANOUT)
    return leaves


def height(leaves: int) -> int:
    level = 0
    while nodes_at(leaves, level) > 1:
        level += 1
    return level


def placing(band: int) -> Callable[[Vertex], int]:
    """Where a vertex stands: with all of its band of levels that have an ancestor, the highest of the band, in common."""

    def task_of(vertex: Vertex) -> int:
        tree, level, index = vertex
        nth = level // band
        top = index // FANOUT ** ((nth + 1) * band - 1 - level)
        return zlib.crc32(f"{nth} {top} {tree}".encode("utf-8", "surrogatepass"))

    return task_of


@dataclass(frozen=True)
class Dealing:
    """How vertices are dealt out: to so many tasks, by whose function, in bands of so many levels."""

    tasks: int
    band: int
    task_of: Callable[[Vertex], int]

    def out(self, rdd: RDD) -> RDD:
        return rdd.partitionBy(self.tasks, self.task_of)

    def met(self, rdd: RDD) -> RDD:
        return rdd.groupByKey(self.tasks, self.task_of)


def fold(own: bytes, index: int, leaves: int, path: bytes) -> tuple[bytes, int]:
    """The top that follows from a leaf and its path, and how much of the path that took."""
    at = 0
    while leaves > 1:
        others = SIZE * (min(FANOUT, leaves - index // FANOUT * FANOUT) - 1)
        cut = at + SIZE * (index % FANOUT)
        own = digest(path[at:cut] + own + path[cut : at + others])
        at, index, leaves = at + others, index // FANOUT, -(-leaves // FANOUT)
    return own, at


# --- supersteps -----------------------------------------------------------------------------------


def _to_parents(children: Iterable[tuple[Vertex, tuple[bytes, int]]]) -> Iterator[tuple[Vertex, tuple[int, bytes, int]]]:
    for (tree, level, index), (own, leaves) in children:
        if nodes_at(leaves, level) > 1:
            yield (tree, level + 1, index // FANOUT), (index % FANOUT, own, leaves)


def _completed(parents: Iterable[tuple[Vertex, Iterable[tuple[int, bytes, int]]]]) -> Iterator[tuple[Vertex, tuple[bytes, int, bytes]]]:
    """Parents with all their children: own hash, leaves of the tree, the children's hashes."""
    for vertex, messages in parents:
        got = sorted(messages)
        tree, level, index = vertex
        leaves = got[0][2]
        if [slot for slot, _, _ in got] != list(range(min(FANOUT, nodes_at(leaves, level - 1) - index * FANOUT))):
            raise ValueError(f"children of {vertex} are missing")
        children = b"".join(own for _, own, _ in got)
        yield vertex, (digest(children), leaves, children)


def _to_children(parents: Iterable[tuple[Vertex, Iterable[tuple]]]) -> Iterator[tuple[Vertex, tuple[bytes, tuple]]]:
    for (tree, level, index), messages in parents:
        children, above = None, None
        for message in messages:
            if len(message) == 1:
                children = message[0]
            else:
                above = message
        path, rest = above
        for slot in range(len(children) // SIZE):
            yield (tree, level - 1, index * FANOUT + slot), (children[: slot * SIZE] + children[(slot + 1) * SIZE :] + path, rest)


def _as_front(state: tuple[bytes, int, bytes]) -> tuple[bytes, int]:
    return state[:2]


def _children_alone(state: tuple[bytes, int, bytes]) -> tuple[bytes]:
    return (state[2],)


def climb(leaves: RDD, most: int, dealing: Dealing) -> list[RDD]:
    """The levels above leaves (vertex, (hash, leaves of its tree)), whose largest
    tree has `most`: (vertex, (hash, leaves of its tree, its children's hashes))."""
    front, levels = leaves, []
    for level in range(1, height(most) + 1):
        messages = front.mapPartitions(_to_parents, preservesPartitioning=level % dealing.band != 0)
        state = dealing.met(messages).mapPartitions(_completed, preservesPartitioning=True)
        state.persist(StorageLevel.MEMORY_AND_DISK)
        state.checkpoint()
        state.count()  # the superstep
        levels.append(state)
        front = state.mapValues(_as_front)
    return levels


def descend(levels: list[RDD], tops: RDD, dealing: Dealing) -> RDD:
    """(leaf, (path, rest)) from tops (vertex, (path, rest)), which may be of any level."""
    tops.persist(StorageLevel.MEMORY_AND_DISK)
    tops.checkpoint()
    tops.count()
    paths = tops.filter(lambda m, level=len(levels): m[0][1] == level)
    for level in range(len(levels), 0, -1):
        met = dealing.met(levels[level - 1].mapValues(_children_alone).union(paths))
        sent = dealing.out(met.mapPartitions(_to_children, preservesPartitioning=level % dealing.band != 0))
        paths = sent.union(tops.filter(lambda m, level=level: m[0][1] == level - 1))
    return paths


# --- tables ---------------------------------------------------------------------------------------


def field_hash(*fields: Column) -> Column:
    """H of fields, each `-` if null, else its bytes' number, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with place (from 0, in its tree, by `order`) and leaves (rows of the tree)."""
    rows = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    rows = written(rows, "sorted").withColumn("range", F.shiftright("at", 33)).withColumn("row", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = rows.groupBy("tree", "range").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("low"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("tree", "range", (before - F.col("low")).alias("base"), F.sum("n").over(tree).alias("leaves"))
    return rows.join(counts, ["tree", "range"]).withColumn("place", F.col("row") + F.col("base")).drop("at", "range", "row", "base")


_SCHEMA = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(docs: DataFrame, fields: list[str], key: str = "doc_id", tree: str = "lang", found: dict[str, Column] | None = None, band: int = BAND) -> DataFrame:
    """key, leaf, subroot, root and proof_sha256 of every row, and its check:
    folded_root is what follows from the proof and the row as it is found now
    (found: for fields that may differ, a column with what is read), verified
    whether that is the root."""
    spark = docs.sparkSession
    ship(spark)
    now = field_hash(*[(found or {}).get(f, F.col(f)) for f in fields])
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.concat(F.lit("+"), F.col(tree).cast("string")), F.lit("")).alias("tree"),
        F.unhex(field_hash(*map(F.col, fields))).alias("leaf"), F.unhex(now).alias("now"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )
    rows = numbered(written(rows, "leaves"), ["key", "leaf", "salt"]).select("tree", "place", "leaves", "key", "leaf", "now")
    rows = written(rows, "numbered")
    total, most = rows.agg(F.count(F.lit(1)), F.max("leaves")).first()
    schema = f"{key} {docs.select(key).schema[0].dataType.simpleString()}, {_SCHEMA}"
    if not total:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(_proved(spark, rows, total, most, band), schema)


def _proved(spark: SparkSession, rows: DataFrame, total: int, most: int, band: int) -> RDD:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    wide = Dealing(max(sc.defaultParallelism, -(-total // 32768)), band, placing(band))
    few = Dealing(min(wide.tasks, 64), band, wide.task_of)
    given = wide.out(rows.rdd.map(lambda r: ((r.tree, 0, r.place), (bytes(r.leaf), r.leaves, r.key, bytes(r.now)))))
    leaves = given.mapValues(lambda x: x[:2])
    levels = climb(leaves, most, wide)

    # The trees' tops are leaves of the last tree, whose name is empty; a row for each language.
    ends = [level.filter(lambda v: height(v[1][1]) == v[0][1]).map(lambda v: (v[0][0], bytearray(v[1][0]), v[1][1])) for level in [leaves, *levels]]
    tops = spark.createDataFrame(sc.union(ends), "name string, top binary, size long").withColumn("tree", F.lit(""))
    tops = written(numbered(written(tops, "tops"), ["name"]), "trees")
    n_trees = tops.count()
    named = few.out(tops.rdd.map(lambda r: (("", 0, r.place), (bytes(r.top), r.leaves, r.name, r.size))))
    last = climb(named.mapValues(lambda x: x[:2]), n_trees, few)
    root = last[-1].first()[1][0] if last else named.first()[1][0]
    start = few.out(sc.parallelize([(("", height(n_trees), 0), (b"", ()))], 1))
    upper = descend(last, start, few)

    def of_tree(met: tuple[Vertex, Iterable[tuple]]) -> tuple[Vertex, tuple[bytes, tuple]]:
        (_, _, index), both = met
        path = own = None
        for x in both:
            path, own = (x, own) if len(x) == 2 else (path, x)
        top, _, name, size = own
        return (name, height(size), 0), (path[0], (index, top))

    below = descend(levels, wide.out(few.met(upper.union(named)).map(of_tree)), wide)

    def checked(vertices: Iterable[tuple[Vertex, Iterable[tuple]]]) -> Iterator[tuple]:
        for (_, _, index), both in vertices:
            path = own = None
            for x in both:
                path, own = (x, own) if len(x) == 2 else (path, x)
            siblings, (tree_index, top) = path
            leaf, n, key, now = own
            at_top, used = fold(now, index, n, siblings)
            folded, _ = fold(at_top, tree_index, n_trees, siblings[used:])
            yield key, leaf.hex(), top.hex(), root.hex(), digest(siblings).hex(), folded.hex(), folded == root

    return wide.met(below.union(given)).mapPartitions(checked)


def manifest(docs: DataFrame, key: str = "doc_id", text: str = "text", band: int = BAND) -> DataFrame:
    """Proofs of documents, checked against a copy in which the texts of a third
    of the keys have lost their capitals."""
    fields = [key, "source", "lang", "n_chars", text]
    hit = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0, F.lit(False))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return proofs(docs, fields, key, "lang", {text: F.when(hit, F.translate(F.col(text), upper, lower)).otherwise(F.col(text))}, band)
