"""What several operators share: tables written to the cluster's shared folder,
and word and shingle hashing over whole Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = "\x20\t\n\x0b\x0c\r"
#: As a Java pattern: what splits words.
SPACE_RUN = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"


_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the
    one given to setCheckpointDir, else, on a single machine (as in tests), one
    of our own. A cluster without any is an error: its executors would each
    write to their own disk."""
    global _own_dir
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (given.get() if given.isDefined() else None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _own_dir = _own_dir or "file://" + tempfile.mkdtemp(prefix="gavelspark-")
    return found.rstrip("/")


_written: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as a table in the shared folder and read from there:
    later uses neither repeat its work nor depend on any executor's disk."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession) -> int:
    """Delete the tables that this application has written, once no result that
    reads them is needed any more. How many there were."""
    n = len(_written)
    for path in _written:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _written.clear()
    return n


def split_by_heat(stats: DataFrame, n: str, total: int, least: int = 256, most: int = 4096) -> tuple[DataFrame, DataFrame]:
    """stats (one row for each key, with its number of rows n) in two: the keys
    that hold more than 1/most of all `total` rows, and the others. There are
    fewer than `most` of the first kind, whatever the data, so they may be
    broadcast; the rows of no other key can swell a task."""
    limit = max(least, total // most)
    return stats.where(F.col(n) > limit), stats.where(F.col(n) <= limit)


def join_by_heat(rows: DataFrame, stats: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined with stats on key: hot keys where their rows stand, the others in a shuffle."""
    hot, cold = split_by_heat(stats, n, total)
    hot = F.broadcast(hot)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that their
    Python finds it wherever it is installed on the driver."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: a lambda's argument is bound,
    where a repeated expression would be evaluated again at each use."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


# --- words and shingles of many texts at once -------------------------------------------------

_U = np.uint64
_CHUNK = 1 << 18
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


_BYTE = mix(_LOWER.astype(_U) + _U(0x51ED27))  # a random-looking number for each byte, A-Z as a-z
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        def table(base: np.uint64) -> np.ndarray:
            x = np.full(max(n, _CHUNK + 4096), base, dtype=_U)
            x[0] = 1
            return np.multiply.accumulate(x)

        _powers = table(_BASE), table(_BASE_INVERSE)
    return _powers


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins and
    the last ends. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of a batch of texts, A-Z as a-z, as 64-bit
    hashes: those of text i are hashes[first[i]:first[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, keep_ends: bool = False):
        hashes, starts, tails = [], [], []
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[offsets] = True
        at = 0
        while at < len(data):
            end = min(len(data), at + _CHUNK)
            while end < len(data) and not (_SPACE[data[end]] or begins[end]):  # finish the word
                stop = min(len(data), end + 4096)
                cut = np.flatnonzero(_SPACE[data[end:stop]] | begins[end:stop])
                end = end + int(cut[0]) if len(cut) else stop
            part = data[at:end]
            space = _SPACE[part]
            word = ~space
            first = word.copy()
            first[1:] &= space[:-1] | begins[at + 1 : end]
            s = np.flatnonzero(first)
            if len(s):
                last = word.copy()
                last[:-1] &= space[1:] | begins[at + 1 : end]
                e = np.flatnonzero(last)
                power, inverse = _power_tables(end - at)
                sums = np.cumsum(_BYTE[part] * power[: end - at], dtype=_U)
                h = sums[e]
                h[s > 0] -= sums[s[s > 0] - 1]
                hashes.append(mix(h * inverse[s]))
                starts.append(s + at)
                if keep_ends:  # the last two bytes and the first two
                    low, more = _LOWER[part].astype(np.int64), e > s
                    last = low[e] * 256 + np.where(more, low[np.maximum(e - 1, 0)], 0)
                    tails.append((last << 16) + low[s] * 256 + np.where(more, low[np.minimum(s + 1, len(low) - 1)], 0))
            at = end
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, _U)
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, offsets)
        if keep_ends:
            self.tails = np.concatenate(tails) if tails else np.zeros(0, np.int64)


_PLACES = mix(np.arange(1, 65, dtype=_U)) | _U(1)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, text after text, and where each
    text's begin. A text of fewer words has one shingle of all it has; a text
    without words has none."""
    first = words.first
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_first = np.concatenate([[0], np.cumsum(n)])
    if not len(words.hashes):
        return np.zeros(0, _U), out_first
    w = words.hashes
    runs = np.zeros(max(0, len(w) - size + 1), dtype=_U)
    for j in range(size if len(runs) else 0):
        runs += w[j : j + len(runs)] * _PLACES[j]
    runs = mix(runs)
    place = np.repeat(first[:-1] - out_first[:-1], n) + np.arange(out_first[-1])
    out = runs[np.minimum(place, len(runs) - 1)] if len(runs) else np.zeros(len(place), _U)
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = w[first[i] : first[i + 1]]
        out[out_first[i]] = mix(np.array([(own * _PLACES[: len(own)]).sum(dtype=_U) + _U(len(own))]))[0]
    return out, out_first


def small_batches(batch: pa.RecordBatch, text: str = "text", most: int = 4 << 20):
    """The batch in slices whose texts hold about `most` bytes together (one
    longer text is a slice of its own), so that arrays stay small."""
    lengths = np.diff(utf8(batch.column(text))[1])
    total = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(at, end - at)
        at = end
