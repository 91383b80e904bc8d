"""Token ids of documents in binary files, packed in 64-bit words.

Coding is word-aligned, after Simple-8b. A word's upper four bits are its
selector: 2 to 15 say that it holds 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2
or 1 ids of 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30 or 60 bits; 1: a run of
one id (12 bits for its length, 48 for the id); 0: an escape, whose lower bits
are the place of a 64-bit id in the document's escape list. Documents are coded
in blocks of 256 ids that begin at a word of their own; the last word of a block
may hold fewer ids than its selector says. Both ways work on whole arrays: block
after block side by side when coding, all words of one selector at once when
decoding.

A file holds a head, words, escapes, an index (the first word of every block;
ids, words and escapes of every document; its key) and a foot of fixed length.
Files are written by the tasks that hold their range of keys, each under a name
of its own attempt; a manifest, written as a table, lists those of the attempts
that counted, so that lost executors and repeated tasks leave no trace in what
is read. Files of attempts that did not count stay in the folder, unread. The
folder is opened with pyarrow's file systems (file, hdfs, s3, gs).

Defined results: a null text is an empty one (its end id alone is written); texts
of any length are tokenised whole; rows are in ascending order of keys, null keys
first, those with equal keys by a hash of their texts, so that one key's rows may
spread over several files; repeated rows are written each; keys are integers or
strings; an empty table gives an empty manifest and an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, ship, small_batches, written

_U = np.uint64
BLOCK = 256
#: Ids in a word and their bits, for selectors 2 to 15.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_LIMITS = (_U(1) << WIDTHS.astype(_U)) - _U(1)
_ESCAPE, _RUN = 0, 1
_RUN_VALUE = _U((1 << 48) - 1)
_LONGEST = int(COUNTS[0])


def _classes(ids: np.ndarray) -> np.ndarray:
    """The narrowest of WIDTHS for each id; len(WIDTHS): none."""
    return np.searchsorted(_LIMITS, ids, side="left").astype(np.uint8)


def encode(ids: np.ndarray, first: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the documents ids[first[i]:first[i + 1]]; the number of words of
    each block, of words of each document, all escapes, and their number by
    document."""
    sizes = np.diff(first)
    parts = -(-sizes // block)
    doc = np.repeat(np.arange(len(sizes)), parts)
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first[doc] + inside * block
    length = np.minimum(block, first[doc + 1] - begin)
    n = len(doc)
    grid = np.zeros((n, block + _LONGEST), _U)  # a block a row, zeros beyond its end
    held = np.arange(block) < length[:, None]
    grid[:, :block][held] = ids
    widest = np.zeros(grid.shape, np.uint8)
    widest[:, :block][held] = _classes(ids)
    # For each place, the first selector whose ids all fit: windows of growing length.
    choice = np.full((n, block), len(COUNTS), np.uint8)
    window, reach = widest, 1
    for k in range(len(COUNTS) - 1, -1, -1):
        while reach < COUNTS[k]:
            more = min(reach, int(COUNTS[k]) - reach)
            window = np.maximum(window[:, : window.shape[1] - more], window[:, more:])
            reach += more
        np.copyto(choice, k, where=window[:, :block] <= k)
    run = np.ones((n, block), np.uint16)
    same = (grid[:, 1:block] == grid[:, : block - 1]) & held[:, 1:]
    for j in range(block - 2, -1, -1):
        run[:, j] += np.where(same[:, j], run[:, j + 1], 0).astype(np.uint16)
    takes = np.append(COUNTS, 1).astype(np.uint16)[choice]
    as_run = (run > takes) & (grid[:, :block] <= _RUN_VALUE)
    takes[as_run] = run[as_run]
    choice[as_run] = 255
    # Follow all blocks from word to word, side by side.
    at, alive, starts, rows = np.zeros(n, np.int64), np.arange(n), [], []
    while len(alive):
        starts.append(at[alive])
        rows.append(alive)
        at[alive] += takes[alive, at[alive]]
        alive = alive[at[alive] < length[alive]]
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    order = np.argsort(row, kind="stable")
    row, place = row[order], (np.concatenate(starts) if starts else np.zeros(0, np.int64))[order]
    kind = choice[row, place]
    words = np.zeros(len(row), _U)
    for k in range(len(COUNTS)):
        some = np.flatnonzero(kind == k)
        word = np.full(len(some), _U(k + 2) << _U(60))
        for j in range(int(COUNTS[k])):
            word |= grid[row[some], place[some] + j] << _U(j * int(WIDTHS[k]))
        words[some] = word
    some = np.flatnonzero(kind == 255)
    words[some] = (_U(_RUN) << _U(60)) | (run[row[some], place[some]].astype(_U) << _U(48)) | grid[row[some], place[some]]
    some = np.flatnonzero(kind == len(COUNTS))
    escapes, of_doc = grid[row[some], place[some]], np.bincount(doc[row[some]], minlength=len(sizes))
    words[some] = np.arange(len(some), dtype=_U) - (np.cumsum(of_doc) - of_doc)[doc[row[some]]].astype(_U)
    return words, np.bincount(row, minlength=n), np.bincount(doc[row], minlength=len(sizes)), escapes, of_doc


def decode(words: np.ndarray, block_words: np.ndarray, block_ids: np.ndarray, escapes: np.ndarray, escape_base: np.ndarray) -> np.ndarray:
    """The ids of blocks, each with its number of words and ids and the place in
    escapes where its document's begin."""
    if not len(words):
        return np.zeros(0, _U)
    kind = (words >> _U(60)).astype(np.int64)
    low = words & _U((1 << 60) - 1)
    count = np.concatenate([[1, 0], COUNTS])[kind]
    runs = kind == _RUN
    count[runs] = (low[runs] >> _U(48)).astype(np.int64)
    last = np.cumsum(block_words) - 1
    before = np.cumsum(count)
    said = before[last] - np.concatenate([[0], before[last[:-1]]])
    count[last] -= said - block_ids
    start = np.cumsum(count) - count
    out = np.zeros(int(block_ids.sum()), _U)
    for k in range(len(COUNTS)):
        some = np.flatnonzero(kind == k + 2)
        for j in range(int(COUNTS[k])):
            own = some if j == 0 else some[count[some] > j]
            if not len(own):
                break
            out[start[own] + j] = (low[own] >> _U(j * int(WIDTHS[k]))) & _LIMITS[k]
    some = np.flatnonzero(runs)
    out[np.repeat(start[some] - np.cumsum(count[some]) + count[some], count[some]) + np.arange(count[some].sum())] = np.repeat(low[some] & _RUN_VALUE, count[some])
    some = np.flatnonzero(kind == _ESCAPE)
    if len(some):
        out[start[some]] = escapes[low[some].astype(np.int64) + np.repeat(escape_base, block_words)[some]]
    return out


# --- files ----------------------------------------------------------------------------------------

_MAGIC, _FOOT = b"TOKIDS01", struct.Struct("<8Q8s")


class FileWriter:
    """One file, written from front to back; only the index is held."""

    def __init__(self, path: str, block: int = BLOCK):
        system, self.path = pafs.FileSystem.from_uri(path)
        system.create_dir(os.path.dirname(self.path), recursive=True)
        self.out, self.block = system.open_output_stream(self.path), block
        self.out.write(_MAGIC)
        self.ids, self.words, self.blocks, self.escapes, self.escapes_of, self.keys = [], [], [], [], [], []

    def add(self, keys: pa.Array, ids: np.ndarray, first: np.ndarray) -> None:
        words, of_block, of_doc, escapes, escapes_of = encode(ids.astype(_U), first, self.block)
        self.out.write(words.astype("<u8").tobytes())
        for held, new in ((self.ids, np.diff(first)), (self.words, of_doc), (self.blocks, of_block), (self.escapes, escapes), (self.escapes_of, escapes_of)):
            held.append(new)
        self.keys.append(keys)

    def close(self) -> tuple[int, int]:
        """Documents and ids of the file."""
        ids, words, blocks, escapes, escapes_of = (np.concatenate(x).astype("<u8") for x in (self.ids, self.words, self.blocks, self.escapes, self.escapes_of))
        sink = pa.BufferOutputStream()
        table = pa.Table.from_arrays([pa.chunked_array(self.keys)], ["key"])
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        keys = sink.getvalue()
        for part in (escapes, ids, words, escapes_of, blocks):
            self.out.write(part.tobytes())
        self.out.write(keys)
        self.out.write(_FOOT.pack(int(words.sum()), len(escapes), len(ids), len(blocks), keys.size, self.block, int(ids.sum()), 0, _MAGIC))
        self.out.close()
        return len(ids), int(ids.sum())


class FileReader:
    """Documents of one file, a slice of them at a time."""

    def __init__(self, path: str):
        system, path = pafs.FileSystem.from_uri(path)
        self.source = system.open_input_file(path)
        size = self.source.size()
        n_words, n_escapes, n_docs, n_blocks, key_bytes, self.block, _, _, magic = _FOOT.unpack(self.source.read_at(_FOOT.size, size - _FOOT.size))
        if magic != _MAGIC:
            raise ValueError(f"{path} is no file of token ids")
        at = len(_MAGIC) + 8 * n_words

        def numbers(n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(self.source.read_at(8 * n, at), "<u8")
            at += 8 * n
            return out

        self.escapes = numbers(n_escapes)
        self.ids, self.words, self.escapes_of, self.blocks = (numbers(n).astype(np.int64) for n in (n_docs, n_docs, n_docs, n_blocks))
        self.keys = pa.ipc.open_stream(self.source.read_at(key_bytes, at)).read_all().column("key").combine_chunks()

    def slices(self, most: int = 1 << 20) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """(keys, ids, their first places) of runs of documents with about `most` ids."""
        parts = -(-self.ids // self.block)
        ends, word_ends, block_ends = np.cumsum(self.ids), np.cumsum(self.words), np.cumsum(parts)
        escape_base = np.cumsum(self.escapes_of) - self.escapes_of
        at = 0
        while at < len(self.ids):
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            w, b = (int(x[at - 1]) if at else 0 for x in (word_ends, block_ends))
            own = slice(at, end)
            raw = self.source.read_at(8 * (int(word_ends[end - 1]) - w), len(_MAGIC) + 8 * w)
            block_ids = np.full(int(parts[own].sum()), self.block)
            full = np.flatnonzero(parts[own])
            block_ids[np.cumsum(parts[own])[full] - 1] -= (parts[own] * self.block - self.ids[own])[full]
            ids = decode(np.frombuffer(raw, "<u8"), self.blocks[b : int(block_ends[end - 1])], block_ids, self.escapes, np.repeat(escape_base[own], parts[own]))
            yield self.keys.slice(at, end - at), ids, np.concatenate([[0], np.cumsum(self.ids[own])])
            at = end


# --- ids of texts ---------------------------------------------------------------------------------

#: How this vocabulary splits lower-case text before merging, for Latin letters alone. Fixed: part of its definition.
_LETTER, _NUMBER = "a-zA-ZªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
LATIN_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+"
NOT_LATIN = "[^\t-\r -~\xa0-ɏ]"


class WordIds:
    """The ids that `tokenizers` gives. Texts of Latin letters alone are split as
    the vocabulary splits them and met piece by piece in a table of pieces; pieces
    not in it go to the tokenizer together, as do other texts, whole."""

    def __init__(self, path: str, most: int = 600_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
        self.last[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.most = most
        self.split, self.foreign = re.compile(LATIN_PIECES).findall, re.compile(NOT_LATIN).search

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str], most: int = 500) -> list[bytes]:
        """Ids of single pieces: many in one text, a blank between them, are parted where a piece's last id stands."""
        ids = self._ids([" ".join(pieces[i : i + most]) for i in range(0, len(pieces), most)])
        ends = np.flatnonzero(self.last[np.frombuffer(joined := b"".join(ids), "<u4")]) + 1
        return [joined[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if pieces else []

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of each text; no special tokens."""
        lowered = [t.lower() for t in texts]
        plain = [not self.foreign(t) for t in lowered]
        pieces = [self.split(t) for t, p in zip(lowered, plain, strict=True) if p]
        if len(self.known) > self.most:
            self.known = {}
        fresh = [p for p in set(chain.from_iterable(pieces)) if p not in self.known]
        self.known.update(zip(fresh, self._pieces(fresh), strict=True))
        get = self.known.__getitem__
        done = iter([b"".join(map(get, p)) for p in pieces])
        others = iter(self._ids([t for t, p in zip(texts, plain, strict=True) if not p]))
        for p in fresh:
            if len(p) > 64:
                del self.known[p]
        return [next(done if p else others) for p in plain]


_encoders: dict[str, WordIds] = {}


def _encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


# --- tables ---------------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = 1) -> DataFrame:
    """Write the ids of all texts, each with end_id after it, in ascending order
    of keys. The manifest: file, part (its place in that order), n_docs, n_ids and
    start (ids in the files before). folder: one of its own in the shared folder."""
    spark = docs.sparkSession
    ship(spark)
    folder = (folder or f"{shared_dir(spark)}/tokens").rstrip("/") + "/" + uuid.uuid4().hex
    if folder.startswith("/"):
        folder = "file://" + folder

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, out = _encoder(tokenizer), None
        part = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        name = f"{folder}/{part:06d}-{uuid.uuid4().hex}.tok"
        for whole in batches:
            for batch in small_batches(whole, "text", 1 << 20):
                out = out or FileWriter(name)
                coded = [x + end for x in ids_of([t or "" for t in batch.column("text").to_pylist()])]
                first = np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded])])
                out.add(batch.column("key"), np.frombuffer(b"".join(coded), "<u4"), first)
        if out is not None:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "part": pa.array([part], pa.int32()), "n_docs": [n_docs], "n_ids": [n_ids]})

    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("h"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"), F.col(text).alias("text"))
    order = ["key", "h", "salt"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    files = written(dealt.mapInArrow(write, "file string, part int, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, key_type: str = "long") -> DataFrame:
    """key, start (ids before it in all files), n_tokens and ids (little-endian,
    32 bits) of every document in the files of a manifest."""
    ship(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                for keys, ids, first in FileReader(file).slices():
                    data = pa.py_buffer(ids.astype("<u4").tobytes())
                    blob = pa.Array.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer((4 * first).astype(np.int64).tobytes()), data]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([keys, pa.array(start + first[:-1]), pa.array(np.diff(first)), blob], ["key", "start", "n_tokens", "ids"])
                    start += int(first[-1])

    files = manifest.select("file", "start", "part")
    spread = files.repartitionByRange(max(1, files.count()), "part")  # a task for each file
    return spread.select("file", "start").mapInArrow(read, f"key {key_type}, start long, n_tokens long, ids binary")


def token_digest(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1) -> DataFrame:
    """Write, read back, and say of each document where it starts, how many ids
    it has, and their checksum."""
    manifest = write_tokens(docs, tokenizer, key=key, text=text, end_id=end_id)
    back = read_tokens(manifest, docs.select(key).schema[0].dataType.simpleString())
    return back.select(F.col("key").alias(key), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
