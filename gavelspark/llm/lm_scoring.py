"""A hashed maximum-entropy language model with class-factored softmax.

A token's probability is that of its class given what precedes it, times that of
its block inside the class given the same, times its own inside the block.
Classes are the most frequent words, each alone, and word endings by hash; blocks
are word beginnings by hash. Both softmaxes sum weights of hashed features: the
previous word, the previous two (n-gram), and the one before the previous (skip)
for classes; the previous word and the one before it, each with the class, for
blocks. Inside a block, a word's probability is (its count + 1) / (tokens +
distinct words + 1), the maximum-entropy solution under its count as the only
constraint; the last 1 is all unseen words'.

The feature rows are dealt into parts by the previous word, so a token meets the
rows of one part only, and parts grow with the training tokens and the distinct
words: no number bounds the rows of the whole model. A shuffle brings the tokens
of all texts, packed to a few bytes each, to the task that holds their part's
rows; it learns from the training texts' tokens and scores all, and a second
shuffle adds each text's sums up. A word with so many tokens that a part would
swell is dealt further, by the word before it and, where that has as many, by the
text's hash; so a skip row belongs to a part, not to all.

In each part, training covers all training tokens in `rounds` synchronous steps,
each over its share of the texts: the gradient (observed less expected class
counts of each feature row) is added up over all of them at the same weights,
then the sums move the weights. So the result depends on the texts, not on how
many tasks read them. Counts of all words are gathered in a shuffle. To the driver
and to all tasks go only tables of bounded size: the counts of the `head` most
frequent words and of the classes' blocks; counts of other words meet their texts
in a join.

Words are compared as 64-bit hashes, A-Z as a-z.

Defined results: a null text is an empty one, of its end token alone; repeated
rows each train and are each scored; a null key is held to be text "null" and is
a training row, keys may have any type; of words as frequent as the last that is
a class alone, those with the lowest hash are; texts of any length are read
whole; an empty table gives an empty result; without training rows every count is
0; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, ship, small_batches, utf8, written

#: The end of a text counts as a token; a zero stands for it, and before a text's beginning.
END = np.uint64(0)
_FEATURES, _INNER = 3, 2
_U = np.uint64


@dataclass(frozen=True)
class Shape:
    """singles: words that are classes alone; endings: further classes, by word
    ending; blocks: parts of a class, by word beginning; most_rows: the most
    hashed feature rows of a part, whose number follows from it; part_tokens:
    training tokens of a part; head: words whose counts all tasks hold."""

    singles: int = 16
    endings: int = 32
    blocks: int = 12
    most_rows: int = 1 << 15
    part_tokens: int = 1 << 21
    head: int = 1 << 16

    @property
    def classes(self) -> int:
        return self.singles + self.endings

    @property
    def outcome_bits(self) -> int:
        return (self.singles + self.endings * self.blocks - 1).bit_length()


@dataclass
class Vocabulary:
    """The most frequent words, sorted by hash, and those that are classes alone."""

    shape: Shape
    words: np.ndarray
    counts: np.ndarray
    single_words: np.ndarray
    single_ids: np.ndarray

    def classes(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = self.shape.singles + (mix((ends >> 16).astype(_U)) % _U(self.shape.endings)).astype(np.int64)
        if len(self.single_words):
            at = np.minimum(np.searchsorted(self.single_words, words), len(self.single_words) - 1)
            same = self.single_words[at] == words
            out[same] = self.single_ids[at[same]]
        return out

    def blocks(self, ends: np.ndarray) -> np.ndarray:
        return (mix((ends & 0xFFFF).astype(_U) + _U(0x77)) % _U(self.shape.blocks)).astype(np.int64)

    def spread(self, words: np.ndarray) -> np.ndarray:
        """Over how many places the tokens after a word are dealt: 1, but for the most frequent."""
        least = self.shape.part_tokens // 8
        wide = np.flatnonzero(self.counts > least)
        out = np.ones(len(words), _U)
        if len(wide):
            at = np.minimum(np.searchsorted(self.words[wide], words), len(wide) - 1)
            same = self.words[wide][at] == words
            out[same] = (1 + self.counts[wide] // max(1, least)).astype(_U)[at[same]]
        return out

    def known(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is a head word, its count)."""
        if not len(self.words):
            return np.zeros(len(words), bool), np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        same = self.words[at] == words
        return same, np.where(same, self.counts[at], 0)


class Tokens:
    """The tokens of a batch of texts: its words and an end after each text's."""

    def __init__(self, column: pa.Array):
        words = Words(*utf8(column), keep_ends=True)
        n = len(words.first) - 1
        self.first = words.first + np.arange(n + 1)  # an end more for each text before
        total = len(words.hashes) + n
        self.words, self.ends = np.full(total, END, dtype=_U), np.zeros(total, np.int64)
        place = np.arange(len(words.hashes)) + np.repeat(np.arange(n), np.diff(words.first))
        self.words[place], self.ends[place] = words.hashes, words.tails
        self.one, self.two = np.zeros_like(self.words), np.zeros_like(self.words)  # the word before, and before that
        self.one[1:], self.two[2:] = self.words[:-1], self.words[:-2]
        begin, second = self.first[:-1], self.first[:-1] + 1
        self.one[begin] = self.two[begin] = END
        self.two[second[second < self.first[1:]]] = END


def _softmax(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], logs: bool = True) -> np.ndarray:
    """The probabilities that the sums of these rows give, or their logarithms."""
    scores = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        scores += weights.take(r, axis=0)
    scores += bias
    scores -= scores.max(axis=1, keepdims=True)
    if logs:
        scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
    else:
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=1, keepdims=True)
    return scores


@dataclass
class Model:
    """A part's weights of the class rows and of the block rows, biases, and log10
    of each block's denominator. What all parts share is the rest.

    An event is a token packed into a number: the hashes of the previous word and
    of the one before it, as rows, then its class and block."""

    vocabulary: Vocabulary
    parts: int
    rows: int
    outer: np.ndarray
    outer_bias: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    totals: np.ndarray

    def blank(self) -> Model:
        shape = self.vocabulary.shape
        return replace(self, outer=np.zeros((self.rows, shape.classes), np.float32), inner=np.zeros((self.rows, shape.blocks), np.float32))

    @property
    def row_bits(self) -> int:
        return self.rows.bit_length() - 1

    @property
    def event_bytes(self) -> int:
        return (2 * self.row_bits + self.vocabulary.shape.outcome_bits + 7) // 8

    def routes(self, tokens: Tokens, texts: np.ndarray) -> np.ndarray:
        """The part of each token, given a hash of each token's text."""
        out = mix(tokens.one + _U(0x3B))
        one, two = self.vocabulary.spread(tokens.one), self.vocabulary.spread(tokens.two)
        wide = np.flatnonzero(one > 1)
        if len(wide):
            both = np.minimum(one[wide], two[wide])
            out[wide] = mix(out[wide] + mix(tokens.two[wide] + _U(0x3C)) % one[wide] + (mix(texts[wide] + _U(0x3D)) % both << _U(32)))
        return (out % _U(self.parts)).astype(np.uint16 if self.parts <= 1 << 16 else np.int64)

    def contexts(self, tokens: Tokens, part: slice | np.ndarray = slice(None)) -> np.ndarray:
        mask = _U(self.rows - 1)
        return (mix(tokens.one[part] + _U(0xA5)) & mask) << _U(self.row_bits) | mix(tokens.two[part] + _U(0xC3C3)) & mask

    def events(self, tokens: Tokens) -> np.ndarray:
        shape = self.vocabulary.shape
        classes, blocks = self.vocabulary.classes(tokens.words, tokens.ends), self.vocabulary.blocks(tokens.ends)
        outcomes = np.where(classes < shape.singles, classes, shape.singles + (classes - shape.singles) * shape.blocks + blocks)
        return self.contexts(tokens) << _U(shape.outcome_bits) | outcomes.astype(_U)

    def outcomes(self, events: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes of events, and their blocks (of no meaning in classes of one word)."""
        shape = self.vocabulary.shape
        outcomes = (events & _U((1 << shape.outcome_bits) - 1)).astype(np.int64)
        cells = np.maximum(outcomes - shape.singles, 0)
        return np.where(outcomes < shape.singles, outcomes, shape.singles + cells // shape.blocks), cells % shape.blocks

    def class_rows(self, contexts: np.ndarray) -> list[np.ndarray]:
        mask = _U(self.rows - 1)
        pair = mix(contexts * _U(0x9E3779B97F4A7C15) + _U(0x5A))
        return [(x & mask).astype(np.int64) for x in (contexts >> _U(self.row_bits), pair, contexts)]

    def block_rows(self, contexts: np.ndarray, classes: np.ndarray) -> list[np.ndarray]:
        mask, salt = _U(self.rows - 1), mix(classes.astype(_U) + _U(0x1000))
        return [(mix(x + salt * _U(k)) & mask).astype(np.int64) for k, x in ((1, contexts >> _U(self.row_bits)), (3, contexts & mask))]

    def outer_rows(self, tokens: Tokens, part: slice) -> list[np.ndarray]:
        return self.class_rows(self.contexts(tokens, part))

    def inner_rows(self, tokens: Tokens, part: np.ndarray, classes: np.ndarray) -> list[np.ndarray]:
        return self.block_rows(self.contexts(tokens, part), classes)

    def softmaxes(self, events: np.ndarray, size: int, logs: bool = True) -> Iterator[tuple]:
        """Slices of rising events with what both softmaxes give, once for each
        context and for each class in it: (slice, each event's context in it,
        class rows and class softmax of contexts; places of events in blocks, each
        one's class of a context, the classes, their block rows and block softmax)."""
        shape = self.vocabulary.shape
        contexts = events >> _U(shape.outcome_bits)
        begins = np.flatnonzero(np.diff(contexts, prepend=~contexts[:1]))
        for at in range(0, len(begins), size):
            part = slice(begins[at], begins[at + size] if at + size < len(begins) else len(events))
            own, first = contexts[part], begins[at : at + size] - part.start
            of = np.repeat(np.arange(len(first)), np.diff(first, append=len(own)))
            classes, _ = self.outcomes(events[part])
            inside = np.flatnonzero(classes >= shape.singles)
            begin = np.zeros(len(inside), bool)
            begin[:1] = True
            begin[1:] = (np.diff(of[inside]) != 0) | (np.diff(classes[inside]) != 0)
            deep_classes = classes[inside[begin]]
            rows, deep = self.class_rows(own[first]), self.block_rows(own[inside[begin]], deep_classes)
            yield part, of, rows, _softmax(self.outer, self.outer_bias, rows, logs), inside, np.cumsum(begin) - 1, deep_classes, deep, _softmax(self.inner, self.inner_bias[deep_classes], deep, logs)

    def event_scores(self, events: np.ndarray, size: int) -> np.ndarray:
        """log10 of the probability of each of rising events, but for the word's own count + 1."""
        out = np.zeros(len(events))
        all_classes, all_blocks = self.outcomes(events)
        for part, of, _, logs, inside, deep_of, _, _, deep in self.softmaxes(events, size):
            classes, blocks = all_classes[part], all_blocks[part][inside]
            out[part] = logs[of, classes] / np.log(10) - np.where(classes < self.vocabulary.shape.singles, self.totals[classes, 0], 0.0)
            out[part.start + inside] += deep[deep_of, blocks] / np.log(10) - self.totals[classes[inside], blocks]
        return out

    def scores(self, tokens: Tokens, size: int) -> np.ndarray:
        """log10 of each token's probability, but for the word's own count + 1."""
        events, place = np.unique(self.events(tokens), return_inverse=True)
        return self.event_scores(events, size)[place]


def _add_rows(into: np.ndarray, seen: np.ndarray, rows: np.ndarray, off: np.ndarray, n: np.ndarray) -> None:
    """into[:, r] += the sum of off[:, t] over the places t that have row r; seen[r] += that of n[t]."""
    for own, values in zip(into, off, strict=True):
        own += np.bincount(rows, values, len(own))
    seen += np.bincount(rows, n, len(seen))


def _prepared(docs: DataFrame, key: str, text: str, held: int, folds: int) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary")) % folds
    return docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), (fold == held).alias("held_out"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"))


def word_counts(rows: DataFrame) -> DataFrame:
    """word, tail, n over rows (text): each task adds up its own words in parts
    of bounded size, and a shuffle adds up the tasks'."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tails, counts = [], [], []

        def merged(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal words, tails, counts
            if words:
                w, at, place = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
                n = np.bincount(place, weights=np.concatenate(counts), minlength=len(w)).astype(np.int64)
                t = np.concatenate(tails)[at]
                if final or len(w) > 1 << 20:
                    words, tails, counts = [], [], []
                    yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(t), pa.array(n)], ["word", "tail", "n"])
                else:
                    words, tails, counts = [w], [t], [n]

        for whole in batches:
            for batch in small_batches(whole, "text"):
                tokens = Tokens(batch.column("text"))
                w, at, n = np.unique(tokens.words, return_index=True, return_counts=True)
                words.append(w)
                tails.append(tokens.ends[at])
                counts.append(n)
                if len(words) >= 8:
                    yield from merged(False)
        yield from merged(True)

    parts = rows.select("text").mapInArrow(count, "word long, tail long, n long")
    return parts.groupBy("word").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int):
    """The words, by falling count, of as many of the highest steps of count
    (an eighth of a power of two) as hold no more than `most` words together.
    A histogram of a few hundred steps finds them, where a sort of all words
    would send `most` of each task's to one."""
    step = F.floor(F.log2("n") * 8)
    least, held = None, 0
    for at, n in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        held += n
        if held > most:
            break
        least = at
    chosen = counts.where(step >= least) if least is not None else counts.where("false")
    return chosen.select("word", "n").toPandas().sort_values(["n", "word"], ascending=[False, True])


def _gradient(model: Model, events: np.ndarray, counts: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(summed gradient, tokens) of class rows, their bias, block rows and biases
    of classes' blocks, over rising events and how often each occurs."""
    shape, n_rows = model.vocabulary.shape, model.rows
    sizes = [(shape.classes, n_rows), (shape.classes, 1), (shape.blocks, n_rows), (shape.blocks, shape.classes)]
    sums, seen = [np.zeros(s) for s in sizes], [np.zeros(s[1]) for s in sizes]
    all_classes, all_blocks = model.outcomes(events)

    def observe(kind: int, targets: np.ndarray, rows: np.ndarray, n: np.ndarray) -> None:
        sums[kind] += np.bincount(targets * sums[kind].shape[1] + rows, n, sums[kind].size).reshape(sums[kind].shape)

    contexts = events >> _U(shape.outcome_bits)
    inside = np.flatnonzero(all_classes >= shape.singles)
    for rows in model.class_rows(contexts):
        observe(0, all_classes, rows, counts)
    for rows in model.block_rows(contexts[inside], all_classes[inside]):
        observe(2, all_blocks[inside], rows, counts[inside])
    observe(1, all_classes, np.zeros(len(events), np.int64), counts)
    observe(3, all_blocks[inside], all_classes[inside], counts[inside])
    for part, of, rows, p, deep_at, deep_of, deep_classes, deep_rows, deep_p in model.softmaxes(events, size, logs=False):
        n, deep_n = np.bincount(of, counts[part]), np.bincount(deep_of, counts[part][deep_at], len(deep_classes))
        for at, own, number, rows_ in ((0, p, n, rows), (2, deep_p, deep_n, deep_rows)):
            expected = np.multiply(own.T, -number, order="C")
            for r in rows_:
                _add_rows(sums[at], seen[at], r, expected, number)
            if at == 0:
                sums[1][:, 0] += expected.sum(axis=1)
                seen[1][0] += number.sum()
            else:
                _add_rows(sums[3], seen[3], deep_classes, expected, number)
    return list(zip(sums, seen, strict=True))


def _step(weights: np.ndarray, bias: np.ndarray, n: np.ndarray, g: np.ndarray, share: float, prior: float) -> np.ndarray:
    """How far each weight moves. Expected counts of a row are those of its
    weights alone; a gradient g on top of them moves the weight by the logarithm
    of their ratio, held back by `prior` counts and shared by the features that
    each token has."""
    scores = bias + weights
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    expected = n[:, None] * p / p.sum(axis=1, keepdims=True) + prior
    return share * np.clip(np.log(np.maximum(1 + g / expected, 0.05)), -2.0, 4.0)


def train(model: Model, steps: list[tuple[np.ndarray, np.ndarray]], prior: float, size: int) -> Model:
    """A part's model after a step over each of these: distinct rising events, with their counts."""
    shape, model = model.vocabulary.shape, model.blank()
    for distinct, n in steps:
        if not len(distinct):
            continue
        outer, inner, outer_bias, inner_bias = model.outer.copy(), model.inner.copy(), model.outer_bias.copy(), model.inner_bias.copy()
        for kind, (g, seen) in enumerate(_gradient(model, distinct, n, size)):
            at = np.flatnonzero(seen)
            tokens, move = seen[at], g[:, at].T
            if kind == 0:
                outer[at] += _step(model.outer[at], model.outer_bias, tokens, move, 1 / (_FEATURES + 1), prior)
            elif kind == 1:
                outer_bias += _step(np.zeros((1, shape.classes), np.float32), model.outer_bias, tokens, move, 1 / (_FEATURES + 1), prior)[0]
            elif kind == 2:
                mean = np.log(np.exp(model.inner_bias[shape.singles :]).mean(axis=0))
                inner[at] += _step(model.inner[at], mean, tokens, move, 1 / (_INNER + 1), prior)
            else:
                inner_bias[at] += _step(np.zeros((len(at), shape.blocks), np.float32), model.inner_bias[at], tokens, move, 1 / (_INNER + 1), prior)
        model = replace(model, outer=outer, outer_bias=outer_bias, inner=inner, inner_bias=inner_bias)
    return model


def parts_and_rows(total: int, distinct: int, shape: Shape) -> tuple[int, int]:
    """How many parts, and the feature rows of each: together at least a quarter
    of the distinct words, and `most_rows` for every `part_tokens` tokens."""
    parts = max(1, -(-total // shape.part_tokens), -(-distinct // (4 * shape.most_rows)))
    return parts, feature_rows(distinct if parts == 1 else 4 * shape.most_rows, shape.most_rows)


def feature_rows(distinct: int, most: int) -> int:
    """A power of two, about a quarter of the distinct words of a part, from 2**10 up to most."""
    return min(most, 1 << max(10, max(1, distinct // 4).bit_length()))


def start(counts: DataFrame, parts: int, rows_n: int, shape: Shape) -> Model:
    """What all parts share, before any step."""
    top = most_frequent(counts, shape.head)
    words, n = top["word"].to_numpy(np.int64).view(_U), top["n"].to_numpy(np.int64)
    order, single = np.argsort(words), np.argsort(words[: shape.singles])
    vocabulary = Vocabulary(shape, words[order], n[order], words[: shape.singles][single], single)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shape.classes * shape.blocks
        for batch in batches:
            w, ends, n = batch.column("word").to_numpy().view(_U), batch.column("tail").to_numpy(), batch.column("n").to_numpy()
            c = vocabulary.classes(w, ends)
            cell = c * shape.blocks + np.where(c < shape.singles, 0, vocabulary.blocks(ends))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(np.bincount(cell, n, cells).astype(np.int64)), pa.array(np.bincount(cell, minlength=cells))], ["cell", "tokens", "words"])

    found = counts.mapInArrow(classify, "cell long, tokens long, words long").groupBy("cell").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).toPandas()
    totals = np.zeros((shape.classes, shape.blocks))
    totals.ravel()[found["cell"].to_numpy()] = (found["tokens"] + found["words"]).to_numpy()
    totals[shape.singles :] += 1  # of unseen words; a class of one word has none
    totals = np.maximum(totals, 1)
    whole = totals.sum(axis=1)
    return Model(
        vocabulary, parts, rows_n, np.zeros((0, shape.classes), np.float32), np.log(whole / whole.sum()).astype(np.float32),
        np.zeros((0, shape.blocks), np.float32), np.log(totals / whole[:, None]).astype(np.float32), np.log10(totals),
    )


def _binaries(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Bytes of values[first[i]:first[i + 1]] for each i."""
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * values.dtype.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _values(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of _binaries, and how many each row has."""
    data = np.frombuffer(b"".join(column.to_pylist()), kind)
    return data, pc.binary_length(column).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize


_MADE = "n_tokens long, head_known long, head_logs double, rare array<long>"


def packed(rows: DataFrame, model: Model, rounds: int) -> DataFrame:
    """Two kinds of rows over rows (key, text, held_out, hash): texts with what the
    head's counts give, and for each batch of texts and each part its tokens, as
    events, with codes: (place of the text in the batch) * (rounds + 1) + step."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = dict(rows.dtypes)["key"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, width = shared.value, rounds + 1
        row, most = TaskContext.get().partitionId() << 40, (1 << 16) // width
        schema = None
        for whole in (b.slice(at, most) for b in batches for at in range(0, len(b), most)):
            for batch in small_batches(whole, "text"):
                n, tokens = len(batch), Tokens(batch.column("text"))
                known, counts = model.vocabulary.known(tokens.words)
                logs = np.where(known, np.log10(counts + 1.0), 0.0)
                first = tokens.first[:-1]
                rare = np.flatnonzero(~known)
                ends = np.searchsorted(rare, tokens.first)
                texts = pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, int(mix(np.array([row], _U))[0]) % model.parts, np.int32)), pa.array(np.full(n, row)), pa.array(row + np.arange(n)), batch.column("key"), batch.column("held_out"),
                        pa.array(np.diff(tokens.first)), pa.array(np.add.reduceat(known.astype(np.int64), first)), pa.array(np.add.reduceat(logs, first)),
                        pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(tokens.words[rare].view(np.int64))), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
                    ],
                    ["part", "batch", "row", "key", "held_out", "n_tokens", "head_known", "head_logs", "rare", "codes", "data"],
                )
                schema = schema or texts.schema
                yield texts

                hashes = batch.column("hash").to_numpy()
                step = np.where(batch.column("held_out").to_numpy(zero_copy_only=False), rounds, hashes % rounds)
                of = np.repeat(np.arange(n), np.diff(tokens.first))
                routes = model.routes(tokens, hashes.view(_U)[of])
                order = np.argsort(routes, kind="stable")
                parts, begins = np.unique(routes[order], return_index=True)
                begins, k = np.append(begins, len(order)), len(parts)
                codes = (np.arange(n) * width + step).astype(np.uint16)[of[order]]
                data = np.ascontiguousarray(model.events(tokens)[order].view(np.uint8).reshape(-1, 8)[:, : model.event_bytes]).ravel()
                made = {"part": pa.array(parts.astype(np.int32)), "batch": pa.array(np.full(k, row)), "codes": _binaries(codes, begins), "data": _binaries(data, begins * model.event_bytes)}
                yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.nulls(k, f.type) for f in schema], schema=schema)
                row += n

    return rows.mapInArrow(pack, f"part int, batch long, row long, key {kind}, held_out boolean, {_MADE}, codes binary, data binary")


def _add_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rising events and their counts, over several such."""
    if len(parts) == 1:
        return parts[0]
    events, place = np.unique(np.concatenate([e for e, _ in parts]), return_inverse=True)
    return events, np.bincount(place, np.concatenate([n for _, n in parts]), len(events))


class PartEvents:
    """The events of a part, as rows of packed() bring them: kept packed, and
    counted for each step and for the texts held out."""

    def __init__(self, model: Model, rounds: int):
        self.model, self.rounds, self.lots, self.counts = model, rounds, [], [[] for _ in range(rounds + 1)]

    def add(self, rows: pa.RecordBatch, most: int = 1 << 20) -> None:
        total, at = np.cumsum(pc.binary_length(rows.column("codes")).to_numpy(zero_copy_only=False) // 2), 0
        while at < len(rows):  # some `most` events at a time
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
            lot = rows.slice(at, end - at)
            at = end
            codes, lengths = _values(lot.column("codes"), np.uint16)
            data = np.frombuffer(b"".join(lot.column("data").to_pylist()), np.uint8)
            self.lots.append((lot.column("batch").to_numpy().copy(), codes, lengths, data))
            events, step = self._events(data), codes % np.uint16(self.rounds + 1)
            for own, parts in enumerate(self.counts):
                parts.append(np.unique(events[step == own], return_counts=True))
                if sum(len(e) for e, _ in parts[1:]) > max(most, len(parts[0][0])):
                    parts[:] = [_add_counts(parts)]

    def _events(self, data: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(data) // self.model.event_bytes, 8), np.uint8)
        wide[:, : self.model.event_bytes] = data.reshape(len(wide), -1)
        return wide.view(_U).ravel()

    def trained(self, prior: float, size: int) -> Model:
        self.counts = [[_add_counts(parts)] if parts else [(np.zeros(0, _U), np.zeros(0))] for parts in self.counts]
        return train(self.model, [parts[0] for parts in self.counts[: self.rounds]], prior, size)

    def sums(self, model: Model, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each lot of rows: batches, where the texts of each begin, their
        places in the batch, and the sum of their events' scores."""
        events, _ = _add_counts([x for parts in self.counts for x in parts])
        scores = model.event_scores(events, size)
        for batches, codes, lengths, data in self.lots:
            own, place = np.unique(self._events(data), return_inverse=True)
            logs = scores[np.searchsorted(events, own)][place]
            text, of = codes // np.uint16(self.rounds + 1), np.repeat(np.arange(len(batches)), lengths)
            first = np.flatnonzero((np.diff(text, prepend=0) != 0) | (np.diff(of, prepend=-1) != 0))
            yield batches, np.searchsorted(of[first], np.arange(len(batches) + 1)), text[first], np.add.reduceat(logs, first)


def fit(rows: DataFrame, counts: DataFrame, total: int, distinct: int, shape: Shape, rounds: int, prior: float, batch_tokens: int) -> Model:
    """The model of rows (text), whose word counts are given, as a single part."""
    ship(rows.sparkSession)
    model = start(counts, 1, feature_rows(distinct, shape.most_rows), shape)
    if not total:
        return model.blank()
    names = ["outer", "outer_bias", "inner", "inner_bias"]

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PartEvents(model, rounds)
        for batch in batches:
            own.add(batch)
        made = own.trained(prior, batch_tokens)
        yield pa.RecordBatch.from_arrays([pa.array([getattr(made, x).tobytes()]) for x in names], names)

    events = packed(_prepared(rows.withColumn("key", F.lit(0)), "key", "text", -1, 7), model, rounds).where("data is not null")
    found = events.coalesce(1).mapInArrow(weights, ", ".join(f"{x} binary" for x in names)).first()
    return replace(model, **{x: np.frombuffer(found[x], np.float32).reshape((-1, *getattr(model, x).shape[1:])) for x in names})


def text_sums(rows: DataFrame, model: Model, rounds: int, prior: float, batch_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Texts (row, key, held_out, ...) and row, model: the log10 that the model gives
    each text, but for the counts of its words. Each part is learnt and meets its
    tokens in one task."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = dict(rows.dtypes)["key"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, PartEvents] = {}
        schema = None
        for batch in batches:
            schema = schema or pa.schema([f for f in batch.schema if f.name != "part"])
            made = pc.is_valid(batch.column("data"))
            texts, events = batch.filter(pc.invert(made)), batch.filter(made)
            if len(texts):
                yield texts.select(schema.names)
            for part in pc.unique(events.column("part")).to_pylist():
                parts.setdefault(part, PartEvents(shared.value, rounds)).add(events.filter(pc.equal(events.column("part"), part)))
        for part in sorted(parts):
            own = parts.pop(part)
            for ids, begins, places, sums in own.sums(own.trained(prior, batch_tokens), batch_tokens):
                made = {"batch": pa.array(ids), "codes": _binaries(places.astype(np.uint16), begins), "data": _binaries(sums.astype(np.float32), begins)}
                yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.nulls(len(ids), f.type) for f in schema], schema=schema)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, sums, batch = [], [], None
        for rows in batches:
            if len(rows):
                batch = rows.column("batch")[0].as_py()
                places.append(_values(rows.column("codes"), np.uint16)[0])
                sums.append(_values(rows.column("data"), np.float32)[0])
        total = np.bincount(np.concatenate(places), np.concatenate(sums))  # every text has an end, so all places occur
        yield pa.RecordBatch.from_arrays([pa.array(batch + np.arange(len(total))), pa.array(total)], ["row", "model"])

    dealt = packed(rows, model, rounds).repartitionById(model.parts, F.col("part"))
    scored = written(dealt.mapInArrow(meet, f"batch long, row long, key {kind}, held_out boolean, {_MADE}, codes binary, data binary"), "scored")
    sums = scored.where("data is not null").select("batch", "codes", "data").groupBy("batch").applyInArrow(add_up, "row long, model double")
    return scored.where("data is null").drop("batch", "codes", "data"), sums


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", held: int = 2, folds: int = 7, shape: Shape = Shape(), rounds: int = 3, prior: float = 4.0, batch_tokens: int = 1 << 15) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score (unigrams with
    one added) and score (log10 of the text's probability under the model)."""
    spark = docs.sparkSession
    ship(spark)
    rows = _prepared(docs, key, text, held, folds)
    counts = written(word_counts(rows.where(~F.col("held_out"))), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    model = start(counts, *parts_and_rows(total, distinct, shape), shape)
    scored, sums = text_sums(rows, model, rounds, prior, batch_tokens)
    # A word that is not in the head has few tokens, so none of these keys is hot; in a table where all words fit, nothing is left to join.
    tail = scored.select("row", F.explode("rare").alias("word")).join(counts.select("word", "n"), "word")
    tail = tail.groupBy("row").agg(F.count(F.lit(1)).alias("tail_known"), F.sum(F.log10(F.col("n") + 1)).alias("tail_logs"))
    logs = F.col("head_logs") + F.coalesce("tail_logs", F.lit(0.0))
    return scored.drop("rare").join(sums, "row").join(tail, "row", "left").select(
        F.col("key").alias(key), "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"), (F.col("model") + logs).alias("score"),
    )
