"""Packing by vector bins: examples share sequences under simultaneous limits
on tokens, segments and loss-bearing tokens.

Each task packs its own rows as they stream by, so nothing is shuffled and no
task holds more than a pool of examples. Full sequences are cut from long
examples at once; what remains of an example enters the pool. A sequence is
filled by the example whose demand has the largest dot product with the room
left in each dimension, until none fits; then, if cutting is allowed, the
largest one is cut to fill the room. Without cutting, the room is padding. At
the end of a task the last tokens go to sequences whose lengths are powers of
two, which need no padding.

Defined results: a null text is an empty one (its end token alone is packed);
repeated rows are packed each; null keys are carried; an example of no tokens
gives no piece; of examples that fit equally well the first of the pool is
placed; keys may have any type; an empty table gives an empty result; other
columns, whatever their names, are ignored; texts are tokenised whole, whatever
their length.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, small_batches


@dataclass(frozen=True)
class Limits:
    """Of a sequence."""

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


@dataclass
class Packer:
    """Sequences of one task. Examples are (name, start, length, loss): `loss`
    says, as an array of running sums, how many of the first tokens bear loss;
    None: all do."""

    limits: Limits
    cut: bool = True
    pool_size: int = 2048
    pool: list = field(default_factory=list)
    ready: list = field(default_factory=list)  # sequences: lists of (name, start, length)

    def add(self, name, length: int, loss: np.ndarray | None = None) -> None:
        whole = self.limits.tokens
        start = 0
        if self.cut:
            while length - start >= whole and loss is None and self.limits.loss >= whole:
                self.ready.append([(name, start, whole)])
                start += whole
            while length - start > whole:
                start = self._flush_part(name, start, loss)
        elif length > whole:
            raise ValueError("an example is longer than a sequence")
        if length > start:
            self.pool.append((name, start, length - start, loss))
        if len(self.pool) >= self.pool_size:
            self._pack(self.pool_size // 4)

    def _loss(self, loss, start: int, length: int) -> int:
        return length if loss is None else int(loss[start + length] - loss[start])

    def _fits(self, loss, start: int, most: int, room_loss: int) -> int:
        """How many tokens from start stay within the room for loss."""
        if loss is None:
            return min(most, room_loss)
        return min(most, int(np.searchsorted(loss, loss[start] + room_loss, side="right")) - 1 - start)

    def _flush_part(self, name, start: int, loss) -> int:
        n = self._fits(loss, start, self.limits.tokens, self.limits.loss)
        self.ready.append([(name, start, n)])
        return start + n

    def _pack(self, leave: int) -> None:
        """Fill sequences until at most `leave` examples are in the pool."""
        lim = self.limits
        size = np.array([p[2] for p in self.pool], dtype=np.int64)
        loss = np.array([self._loss(p[3], p[1], p[2]) for p in self.pool], dtype=np.int64)
        alive = np.ones(len(size), bool)
        left = len(size)
        while left > leave:
            room, segments, room_loss, sequence = lim.tokens, lim.segments, lim.loss, []
            while room and segments:
                fits = alive & (size <= room) & (loss <= room_loss)
                if fits.any():
                    score = np.where(fits, size * (room / lim.tokens**2) + loss * (room_loss / lim.loss**2) + segments / lim.segments**2, -1.0)
                    i = int(score.argmax())
                    name, start, n, running = self.pool[i]
                    sequence.append((name, start, n))
                    room, room_loss, segments, alive[i] = room - n, room_loss - loss[i], segments - 1, False
                    left -= 1
                    continue
                if not self.cut or not left:
                    break
                i = int(np.where(alive, size, -1).argmax())
                name, start, n, running = self.pool[i]
                part = self._fits(running, start, min(room, n), int(room_loss))
                if part <= 0:
                    break
                sequence.append((name, start, part))
                self.pool[i] = (name, start + part, n - part, running)
                size[i], loss[i] = n - part, self._loss(running, start + part, n - part)
                break
            self.ready.append(sequence)
        self.pool = [p for p, a in zip(self.pool, alive, strict=True) if a]

    def finish(self) -> None:
        """Pack what is left; cut the last, partly filled sequence into powers of two."""
        self._pack(0)
        if not self.cut:
            return
        done = []
        for sequence in self.ready:
            n = sum(p[2] for p in sequence)
            while n & (n - 1):
                low = 1 << (n.bit_length() - 1)
                head, tail, got = [], [], 0
                for name, start, length in sequence:
                    take = min(length, low - got)
                    if take:
                        head.append((name, start, take))
                    if length > take:
                        tail.append((name, start + take, length - take))
                    got += take
                done.append(head)
                sequence, n = tail, n - low
            done.append(sequence)
        self.ready = done


#: How byte-level BPE of this family splits a text before merging, and the same for texts of Latin
#: letters alone, with character ranges instead of properties. Fixed: part of the vocabulary's definition.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
LATIN_SPLIT = SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_LETTER}{_NUMBER}]").replace(r"\p{L}", f"[{_LETTER}]").replace(r"\p{N}", f"[{_NUMBER}]")
NOT_LATIN = "[^\t-\r -~\xa0-ɏ]"


class TokenCache(dict):
    """The ids that `tokenizers` gives for this file, as bytes, piece by piece of
    the vocabulary's own splitting. Pieces not met before go to the tokenizer
    together; once `most` are held, those not met since the last such time go. The
    strings of special tokens are ordinary text, as the files' description has it."""

    def __init__(self, path: str, most: int = 600_000):
        import os
        import re

        import regex

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.most, self.old = most, {}
        self.split, self.latin_split = regex.compile(SPLIT).findall, re.compile(LATIN_SPLIT).findall
        self.foreign = re.compile(NOT_LATIN).search

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of each text; no special tokens."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        pieces = [(self.split if self.foreign(t) else self.latin_split)(t) for t in texts]
        new = set().union(*pieces) - self.keys()
        kept = new & self.old.keys()
        self.update((p, self.old[p]) for p in kept)
        fresh = list(new - kept)
        for p, ids in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
            self[p] = array("I", ids.ids).tobytes()
        get = self.__getitem__
        out = [b"".join(map(get, p)) for p in pieces]
        for p in fresh:
            if len(p) > 64:
                del self[p]
        return out


_caches: dict[str, TokenCache] = {}


def _encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    if path not in _caches:
        _caches[path] = TokenCache(path)
    return _caches[path].encode


_PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_texts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1, limits: Limits = Limits()) -> DataFrame:
    """One row for each piece of a text's ids (with end_id at the end): where it
    starts among them, its length and checksum, and its place in a sequence."""
    ship(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = _encoder(tokenizer), Packer(limits)
        next_id = TaskContext.get().partitionId() << 40
        held: dict[int, tuple] = {}  # ids that wait in the pool
        count, kind = 0, None

        def rows() -> pa.RecordBatch:
            nonlocal next_id
            out, keys = [], []
            for sequence in packer.ready:
                offset = 0
                for name, start, length in sequence:
                    key_of, ids, total = held[name]
                    out.append((start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, next_id, offset))
                    keys.append(key_of)
                    offset += length
                next_id += 1
            packer.ready.clear()
            waiting = {p[0] for p in packer.pool}
            for name in [n for n in held if n not in waiting]:
                del held[name]
            columns = np.array(out, dtype=np.int64).reshape(-1, 6).T
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), *map(pa.array, columns)], ["key", *(c.split()[0] for c in _PIECES.split(", "))])

        for whole in batches:
            for batch in small_batches(whole, "text", 1 << 20):
                kind = batch.column("key").type
                texts = [t or "" for t in batch.column("text").to_pylist()]
                for key_of, ids in zip(batch.column("key").to_pylist(), encode(texts), strict=True):
                    ids += end
                    held[count] = (key_of, ids, len(ids) // 4)
                    packer.add(count, len(ids) // 4)
                    count += 1
                yield rows()
        packer.finish()
        if kind is not None:
            yield rows()

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(pack, f"key {dict(docs.dtypes)[key]}, {_PIECES}").withColumnRenamed("key", key)


def pack_examples(examples: DataFrame, key: str, tokens: str, loss: str, limits: Limits = Limits()) -> DataFrame:
    """For instruction data: examples stay whole, with their token and loss
    counts given; each gets a sequence_id and an offset. An example over a limit
    is given back with a null sequence_id. A task holds a pool of examples only."""
    ship(examples.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, next_id, kind = Packer(limits, cut=False), TaskContext.get().partitionId() << 40, None

        def placed(alone: list[tuple]) -> pa.RecordBatch:
            nonlocal next_id
            rows = list(alone)
            for sequence in packer.ready:
                offset = 0
                for (k, n, b), _, _ in sequence:
                    rows.append((k, n, b, next_id, offset))
                    offset += n
                next_id += 1
            packer.ready.clear()
            names, kinds = ["key", "tokens", "loss", "sequence_id", "offset"], [kind, *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

        for batch in batches:
            kind, alone = batch.column("key").type, []
            for k, n, b in zip(*(batch.column(c).to_pylist() for c in ("key", "tokens", "loss")), strict=True):
                n, b = n or 0, min(b or 0, n or 0)
                if n == 0 or n > limits.tokens or b > limits.loss:
                    alone.append((k, n, b, None, None))
                else:
                    running = np.concatenate([np.zeros(n - b + 1, np.int64), np.arange(1, b + 1)])  # the prompt comes first
                    packer.add((k, n, b), n, running)
            yield placed(alone)
        packer.finish()
        if kind is not None:
            yield placed([])

    given = examples.select(F.col(key).alias("key"), F.col(tokens).cast("long").alias("tokens"), F.col(loss).cast("long").alias("loss"))
    schema = f"key {dict(examples.dtypes)[key]}, tokens long, loss long, sequence_id long, offset long"
    return given.mapInArrow(pack, schema).withColumnRenamed("key", key)


def conversation_examples(turns: DataFrame, tokenizer: str, key: str = "conv_id", role: str = "role", text: str = "text", answers: str = "assistant") -> DataFrame:
    """key, tokens and loss of each conversation: ids of all its turns, each with
    an end id, and of those that the model is to learn. Counts are added up where
    the turns stand, so a conversation of any length is no single task's."""
    ship(turns.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for whole in batches:
            for batch in small_batches(whole, "text", 1 << 20):
                n = np.array([len(ids) // 4 + 1 for ids in encode([t or "" for t in batch.column("text").to_pylist()])], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("learn"), pa.array(n)], ["key", "learn", "n"])

    rows = turns.select(F.col(key).alias("key"), F.coalesce(F.col(role) == answers, F.lit(False)).alias("learn"), F.col(text).alias("text"))
    counted = rows.mapInArrow(count, f"key {dict(turns.dtypes)[key]}, learn boolean, n long")
    return counted.groupBy("key").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("learn"), F.col("n")).otherwise(0)).alias("loss")).withColumnRenamed("key", key)
