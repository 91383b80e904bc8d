"""Duplicate listings: keys, fuzzy pairs in blocks, scores, and which row stays."""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import value_similarity
from ..functions.text import address_parts, fold_accents, long_address, short_address, squeeze
from ..functions.urls import host_path
from ..tables import stored
from .first_wins import absorbed
from .matching import ratios


def address_key(address: Column, city: Column, state: Column) -> Column:
    """Address, city and state, normalised."""
    return F.concat_ws("|", short_address(F.coalesce(address, F.lit(""))), *(F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (city, state)))


def plain_key(address: Column, city: Column, state: Column) -> Column:
    return F.concat_ws("|", *(F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (address, city, state)))


def words_key(text: Column, city: Column, state: Column) -> Column:
    """STATE_city_words: the first five words of more than two letters, numbers of units left out."""
    words = F.filter(F.split(squeeze(F.regexp_replace(fold_accents(F.lower(text)), "[^a-z ]", " ")), " "), lambda w: F.length(w) > 2)
    return F.concat_ws("_", F.upper(state), F.left(F.regexp_replace(fold_accents(F.lower(city)), "[^a-z]", ""), F.lit(20)), F.left(F.array_join(F.slice(words, 1, 5), ""), F.lit(30)))


def url_key(auctioneer: Column, url: Column) -> Column:
    return F.md5(F.concat_ws(":", auctioneer.cast("string"), host_path(url)).cast("binary"))


@F.pandas_udf(T.DoubleType())
def text_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Twice the matching characters over all characters, as difflib counts them. No built-in gives this."""
    match, known = difflib.SequenceMatcher(autojunk=False), {}
    for a, b in batches:
        out = []
        for x, y in zip(a, b, strict=True):
            ratio = known.get((x, y))
            if ratio is None:
                match.set_seqs(x or "", y or "")
                ratio = match.ratio()
                if len(known) >= 50_000:
                    known.clear()
                known[x, y] = ratio
            out.append(ratio)
        yield pd.Series(out, dtype=float)


def distinct_texts(rows: DataFrame, block: list[str], text: str, id: str) -> DataFrame:
    """One row for each text of a block: id (the lowest that has it), t, copies."""
    return rows.where(F.col(text).isNotNull()).groupBy(*block, F.col(text).alias("t")).agg(F.min(id).alias("id"), F.count(F.lit(1)).alias("copies"))


def _bounds(least: float) -> tuple[float, float, int, int]:
    """What a ratio means for three-letter grams: the share of a pair's characters
    that are shared grams, that of its longer text, and the lengths from which grams,
    and up to which letters are compared.

    Texts of a ratio r and T characters together match in M >= rT/2 of them, in at
    most (1 - r)T + 1 runs, so they share at least T(2.5r - 2) - 2 three-letter
    grams, counted with repeats, and rT/2 letters. The partner of a text of n
    characters has at least nr / (2 - r)."""
    per, whole = 2.5 * least - 2, 2 / (2 - least)
    by_grams = math.floor(2 / per / 2) + 1 if per > 0.02 else 1 << 30  # both of this length: a shared gram for sure
    return per, whole, by_grams, math.ceil((by_grams - 1) * (2 - least) / least)


def text_tokens(texts: DataFrame, keep: list[str], least: float, within: list[str] = []) -> DataFrame:  # noqa: B006
    """keep, id, n (length), kind and token for each gram, and for short texts each
    letter, of texts (t); repeats are tokens of their own. within: columns that are part of the token."""
    _, _, by_grams, longest_short = _bounds(least)
    n = F.length("t")
    grams = F.when(n >= by_grams, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(F.col("t"), i, F.lit(3))))
    letters = F.when(n <= longest_short, F.filter(F.split("t", ""), lambda x: x != ""))
    kinds = F.array(F.struct(F.lit("g").alias("kind"), grams.alias("tokens")), F.struct(F.lit("l").alias("kind"), letters.alias("tokens")))
    each = texts.select(*keep, "id", n.alias("n"), F.explode(kinds).alias("k")).select(*keep, "id", "n", "k.kind", F.explode("k.tokens").alias("token"))
    counted = each.groupBy(*keep, "id", "n", "kind", "token").agg(F.count(F.lit(1)).alias("times"))
    tokens = counted.select(*keep, "id", "n", "kind", F.explode(F.transform(F.sequence(F.lit(1), F.col("times").cast("int")), lambda i: F.struct(F.col("token").alias("token"), i.alias("i")))).alias("x"))
    return tokens.select(*keep, "id", "n", "kind", F.xxhash64("kind", "x.token", "x.i", *within).alias("token"))


def kept_tokens(ranked: DataFrame, of_text: list[str], least: float) -> DataFrame:
    """Of tokens with `seen`, those of which two similar texts share one: if each
    text's stand in one order, the rarest first, all but the last few."""
    per, whole, _, _ = _bounds(least)
    place = F.row_number().over(Window.partitionBy("id", "kind", *of_text).orderBy("seen", "token"))  # of one text
    size = F.when(F.col("kind") == "g", F.col("n") - 2).otherwise(F.col("n"))
    shared = F.when(F.col("kind") == "g", F.ceil(F.col("n") * (whole * per) - 2 - 1e-9)).otherwise(F.ceil(F.col("n") * (whole * least / 2) - 1e-9))
    return ranked.withColumn("place", place).where(F.col("place") <= size - F.greatest(shared, F.lit(1)) + 1)


def _prefixes(texts: DataFrame, block: list[str], least: float) -> DataFrame:
    """block, id, n (length) and the tokens of which similar texts share one; texts
    too short for a gram bound are met by letters."""
    tokens = text_tokens(texts, block, least)
    known = tokens.groupBy(*block, "token").agg(F.count(F.lit(1)).alias("seen"))
    a, b = tokens.alias("a"), known.hint("merge").alias("b")
    ranked = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in block] + [F.col("a.token") == F.col("b.token")]).select("a.*", "b.seen")
    return kept_tokens(ranked, block, least).where("seen > 1").select(*block, "id", "n", "token")


def similar_pairs(texts: list[str], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places i and j and the ratio of texts i < j that are similar by `least`. Matching
    characters stand in one order in both texts, so there are at most as many as in
    their longest common subsequence. Its length, from bits of 64 characters at a time
    for many pairs at once, says of which pairs the ratio is taken."""
    if len(texts) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    size, every, found = np.array([len(t) for t in texts]), range(len(texts)), []
    low, high = min(texts), max(texts)  # what all begin and end with is common to all pairs
    begin = next((i for i, c in enumerate(low) if high[i : i + 1] != c), len(low))
    ends = [t[begin:][::-1] for t in texts]
    low, high = min(ends), max(ends)
    end = next((i for i, c in enumerate(low) if high[i : i + 1] != c), len(low))
    inner = [t[begin : len(t) - end] for t in texts]
    letters = {c: i for i, c in enumerate(sorted(set("".join(inner))), 1)}  # 0: past the end
    codes = np.zeros((len(texts), max(map(len, inner))), np.int64)
    for i, t in enumerate(inner):
        codes[i, : len(t)] = [letters[c] for c in t]
    masks = []
    for at in range(0, codes.shape[1], 64):
        mask, part = np.zeros((len(letters) + 1, len(texts)), np.uint64), codes[:, at : at + 64]
        for j in range(part.shape[1]):
            mask[part[:, j], every] |= np.uint64(1 << j)
        mask[0] = 0
        masks.append(mask)
    step = max(1, (1 << 16) // len(texts))
    for first in range(0, len(texts), step):
        mine = codes[first : first + step]
        common = np.full((len(mine), len(texts) - first), begin + end)
        for mask in masks:
            open_ = np.full(common.shape, ~np.uint64(0))
            for column in mine[:, : int((mine > 0).sum(axis=1).max())].T:
                met = open_ & mask[column, first:]
                open_ = (open_ + met) | (open_ - met)
            common += np.bitwise_count(~open_)
        near = 2 * common >= least * (size[first : first + step, None] + size[None, first:]) - 1e-9
        i, j = np.nonzero(np.triu(near, 1))
        ratio = ratios(texts, first + i, first + j)
        kept = ratio >= least
        found.append((first + i[kept], first + j[kept], ratio[kept]))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _pairs_of_blocks(texts: DataFrame, block: list[str], least: float) -> DataFrame:
    """Pairs of blocks whose texts fit one task."""
    kind = texts.schema["id"].dataType
    blocks = texts.groupBy(*block).agg(F.sort_array(F.collect_list(F.struct("id", "t"))).alias("x")).select(F.col("x.id").alias("id"), F.col("x.t").alias("t"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, own in zip(batch.column("id"), batch.column("t").to_pylist(), strict=True):
                i, j, ratio = similar_pairs(own, least)
                yield pa.RecordBatch.from_arrays([ids.values.take(pa.array(i)), ids.values.take(pa.array(j)), pa.array(ratio)], ["a", "b", "ratio"])

    tasks = max(32, 4 * texts.sparkSession.sparkContext.defaultParallelism)  # much work in few bytes
    return blocks.repartition(tasks).mapInArrow(compare, T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("ratio", T.DoubleType())]))


def blocked_pairs(rows: DataFrame, block: list[str], text: str, id: str, least: float = 0.85, most: int = 2048) -> DataFrame:
    """Pairs (a < b) of texts of one block that differ and are similar by `least`,
    with the ratio; a and b are the lowest ids that have them (see distinct_texts
    for the others)."""
    return text_pairs(stored(distinct_texts(rows, block, text, id), "texts"), block, least, most)


def text_pairs(texts: DataFrame, block: list[str], least: float, most: int = 2048) -> DataFrame:
    """blocked_pairs of stored distinct texts (block, t, id). In blocks of at most
    `most` texts all are held against all by bounds that cost little (similar_pairs):
    texts of a block that have much in common share so many grams that meeting by
    grams makes more rows than there are pairs. In larger blocks texts meet by their
    rarest grams. No pair is lost in either."""
    large = texts.groupBy(*block).agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > most)
    if large.isEmpty():
        return _pairs_of_blocks(texts, block, least)
    a, b = texts.alias("a"), stored(large, "large").alias("b")
    same = F.lit(True)
    for c in block:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return _pairs_of_blocks(a.join(b, same, "left_anti"), block, least).union(_gram_pairs(a.join(b, same, "left_semi"), block, least))


def _gram_pairs(texts: DataFrame, block: list[str], least: float) -> DataFrame:
    """Pairs of texts that meet by their rarest grams: see _prefixes. Lengths too far
    apart for the ratio are dropped before Python."""
    tokens = _prefixes(texts, block, least)
    a, b = tokens.alias("a"), tokens.hint("merge").alias("b")
    near = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in block] + [F.col("a.token") == F.col("b.token"), F.col("a.id") < F.col("b.id")])
    near = near.where(F.least("a.n", "b.n") * 2 >= F.lit(least) * (F.col("a.n") + F.col("b.n")) - 1e-9)
    pairs = near.select(*(F.col(f"a.{c}").alias(c) for c in block), F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    texts = texts.select(*block, "id", "t")
    for side in ("a", "b"):  # an id may stand in several blocks
        own = texts.toDF(*(f"_{c}" for c in block), f"_{side}", f"t{side}").hint("merge")
        pairs = pairs.join(own, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in block] + [F.col(side) == F.col(f"_{side}")]).drop(*(f"_{c}" for c in block), f"_{side}")
    return pairs.withColumn("ratio", text_ratio("ta", "tb")).where(F.col("ratio") >= least).select("a", "b", "ratio")


def batch_duplicates(rows: DataFrame, block: list[str], text: str, id: str, least: float = 0.85) -> DataFrame:
    """(id, original_id) of the rows that repeat an earlier one: in the order of ids
    each row of a block that is not yet taken takes all later ones whose text is
    similar by `least`. Rows of equal texts go together: the first of them is taken
    or takes, the others follow it."""
    rows = stored(rows.select(*dict.fromkeys([id, *block, text])), "rows")  # read twice
    texts = stored(distinct_texts(rows, block, text, id), "texts")
    taken = absorbed(text_pairs(texts, block, least).select("a", "b"))
    heads = texts.select(*block, F.col("t").alias(text), F.col("id").alias("head"))
    same = rows.select(id, *block, text).join(heads.hint("merge"), [*block, text])
    own = same.join(taken.withColumnRenamed("id", "head").hint("merge"), "head", "left")
    return own.select(F.col(id).alias("id"), F.coalesce("original_id", F.when(F.col("head") != F.col(id), F.col("head"))).alias("original_id")).where("original_id is not null")


def with_address(pairs: DataFrame, a: str, b: str, ratio: Column | None = None, parts: tuple[Column, Column] | None = None) -> DataFrame:
    """pairs with `address`: the ratio of two written-out addresses (given, if it
    is known, as are their parts), plus .15 for the same number, .05 for the same street type, .1 for
    street names alike by more than .8; at most 1."""
    own = parts or (address_parts(F.col(a)), address_parts(F.col(b)))
    out = pairs.withColumns({"_a": own[0], "_b": own[1], "_ratio": text_ratio(a, b) if ratio is None else ratio})
    out = out.withColumn("_names", text_ratio("_a.street_name", "_b.street_name"))
    same = lambda f, points: F.when(F.col(f"_a.{f}") == F.col(f"_b.{f}"), points).otherwise(0.0)
    bonus = same("number", 0.15) + same("street_type", 0.05) + F.when(F.col("_a.street_name").isNotNull() & F.col("_b.street_name").isNotNull() & (F.col("_names") > 0.8), 0.1).otherwise(0.0)
    address = F.when((F.col(a) == "") | (F.col(b) == ""), 0.0).when(F.col(a) == F.col(b), 1.0).otherwise(F.least(F.lit(1.0), F.col("_ratio") + bonus))
    return out.withColumn("address", address).drop("_a", "_b", "_ratio", "_names")


_SCORED = ["title", "category", "evaluation_value", "first_auction_value", "area_total", "area_privativa"]


def pair_score(pairs: DataFrame, least: float = 0.0) -> DataFrame:
    """pairs with `address` and a_* and b_* columns of listings, and their score (.4
    address, .2 title, .15 category, .15 value, .1 area) and its reasons, where it
    is at least `least`. Titles are compared only where the rest leaves that open."""
    category = F.col("a_category").eqNullSafe(F.col("b_category"))
    some = lambda s, *names: F.coalesce(*(F.nullif(F.col(f"{s}_{n}"), F.lit(0.0)) for n in names))
    areas = [some(s, "area_total", "area_privativa") for s in "ab"]
    value, area = value_similarity(some("a", "evaluation_value", "first_auction_value"), some("b", "evaluation_value", "first_auction_value")), value_similarity(*areas)
    rest = F.col("address") * 0.4 + category.cast("double") * 0.15 + value * 0.15 + area * 0.1
    out = pairs.where(rest + 0.2 >= least - 1e-9).withColumns({f"_{s}t": long_address(F.coalesce(f"{s}_title", F.lit(""))) for s in "ab"})
    out = out.withColumn("_titles", text_ratio("_at", "_bt"))
    title = F.when((F.col("_at") == "") | (F.col("_bt") == ""), 0.0).otherwise(F.col("_titles"))
    reasons = F.array_compact(F.array(
        F.when(F.col("address") > 0.8, "address alike").when(F.col("address") > 0.6, "address near"), F.when(title > 0.8, "title"), F.when(category, "category"), F.when(value > 0.8, "value"),
        F.when(areas[0].isNotNull() & areas[1].isNotNull() & (area > 0.8), "area"),
    ))
    return out.withColumns({"score": F.round(rest + title * 0.2, 6), "reasons": F.array_join(reasons, ",")}).where(F.col("score") >= least).drop("_at", "_bt", "_titles")


def _placed(rows: DataFrame) -> DataFrame:
    full = F.concat_ws(", ", *(F.coalesce(F.col(c), F.lit("")) for c in ("address", "neighborhood", "city", "state")))
    return rows.withColumns({"_city": F.lower("city"), "_state": F.upper("state"), "_full": long_address(full)}).where("_city is not null and _state is not null")


def profiles(rows: DataFrame) -> DataFrame:
    """rows of a known city and state with _city, _state, _full (the written-out
    address) and profile: the lowest id of the rows there that are alike in all that a
    score looks at."""
    own = _placed(rows)
    alike = ["_city", "_state", "_full", *_SCORED]
    heads = own.groupBy(*alike).agg(F.min("id").alias("profile"))
    a, b = own.alias("a"), heads.alias("b")
    return a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in alike]).select("a.*", "b.profile")


#: What a pair has in common, by bits; "near" counts where it is not "alike".
_REASONS = ["address alike", "address near", "title", "category", "value", "area"]
_PAIRS = 1 << 18  # of profiles that are scored at once


def _values(column: pa.Array) -> np.ndarray:
    """Numbers, nan for null; a nan is as unlike any other as an infinite one."""
    out = column.fill_null(0.0).to_numpy(zero_copy_only=False).copy()
    out[np.isnan(out)] = np.inf
    out[column.is_null().to_numpy(zero_copy_only=False)] = np.nan
    return out


def _value_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """value_similarity of arrays that hold no zero."""
    with np.errstate(invalid="ignore"):
        off = np.abs(a - b) / np.maximum(a, b)
        near = (off <= 0.1).astype(np.int8) + (off <= 0.2) + (off <= 0.3) + (off <= 0.5)
    return np.where(np.isnan(a) | np.isnan(b), 0.5, np.array([0.2, 0.4, 0.6, 0.8, 1.0])[near])


def _codes(*columns: pa.Array) -> list[np.ndarray]:
    """Equal numbers for equal values of all columns; null is one."""
    codes = pa.concat_arrays(columns).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


def _address_scores(heads: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of addresses (in the order of their heads) that are similar by `least`, or the same, and their score as with_address has it."""
    texts = heads["_full"].to_pylist()
    i, j, ratio = similar_pairs(texts, least)
    parts = heads["parts"].chunk(0)
    kind, number, name = (_codes(parts.field(f))[0] for f in ("street_type", "number", "street_name"))
    same = lambda code: (code[i] == code[j]) & (code[i] >= 0)
    named = np.flatnonzero((name[i] >= 0) & (name[j] >= 0))
    names, pairs = parts.field("street_name").dictionary_encode().dictionary.to_pylist(), name[i[named]].astype(np.int64) * (len(texts) + 1) + name[j[named]]
    each, back = np.unique(pairs, return_inverse=True)
    alike = np.zeros(len(i), bool)
    alike[named] = (ratios(names, each // (len(texts) + 1), each % (len(texts) + 1)) > 0.8)[back]
    empty, every = np.array([t == "" for t in texts], bool), np.arange(len(texts))
    bonus = np.where(same(number), 0.15, 0.0) + np.where(same(kind), 0.05, 0.0) + np.where(alike, 0.1, 0.0)
    score = np.where(empty[i] | empty[j], 0.0, np.minimum(1.0, ratio + bonus))
    return np.concatenate([i, every]), np.concatenate([j, every]), np.concatenate([score, np.where(empty, 0.0, 1.0)])


def _scored_block(heads: pa.Table, least: float, least_address: float) -> Iterator[pa.RecordBatch]:
    """Of one block's addresses (head, _full, parts, and `of`: their profiles) the pairs of profiles that score `least`, with what pair_score
    counts: a, b, n_a, n_b, score (not rounded) and why (bits of _REASONS)."""
    heads = heads.sort_by("head").combine_chunks()
    of = heads["of"].chunk(0)
    size, profiles = of.value_lengths().to_numpy(), of.flatten()
    start, column = np.cumsum(size, dtype=np.int64) - size, lambda name: profiles.field(name)
    low, high = _codes(column("low"), column("high"))
    title, category, value, area, n = _codes(column("title"))[0].astype(np.int64), _codes(column("category"))[0], _values(column("value")), _values(column("area")), column("n").to_numpy()
    titles, ids, rank = column("title").dictionary_encode().dictionary.to_pylist(), column("profile"), np.empty(len(n), np.int64)
    rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(n))
    h1, h2, address = _address_scores(heads, least_address)
    end = np.cumsum(size[h1].astype(np.int64) * size[h2])
    begin, untitled = np.concatenate([[0], end[:-1]]), np.array([t == "" for t in titles], bool)
    for first in range(0, int(end[-1]), _PAIRS):
        last = min(first + _PAIRS, int(end[-1]))
        x, y = np.searchsorted(end, first, "right"), np.searchsorted(begin, last)
        r = np.repeat(np.arange(x, y), np.minimum(end[x:y], last) - np.maximum(begin[x:y], first))
        a, b = np.divmod(np.arange(first, last) - begin[r], size[h2[r]])
        a, b = start[h1[r]] + a, start[h2[r]] + b
        kept = np.flatnonzero(((low[a] != low[b]) | (high[a] != high[b]) | (low[a] != high[a])) & ((h1[r] != h2[r]) | (rank[a] <= rank[b])))
        r, a, b = r[kept], a[kept], b[kept]
        same, values, areas = category[a] == category[b], _value_similarity(value[a], value[b]), _value_similarity(area[a], area[b])
        rest = address[r] * 0.4 + same * 0.15 + values * 0.15 + areas * 0.1
        kept = np.flatnonzero(rest + 0.2 >= least - 1e-9)
        r, a, b, same, values, areas, rest = (v[kept] for v in (r, a, b, same, values, areas, rest))
        pairs, back = np.unique(title[a] * len(titles) + title[b], return_inverse=True)
        i, j = pairs // len(titles), pairs % len(titles)
        alike = np.where(untitled[i] | untitled[j], 0.0, ratios(titles, i, j))[back]
        score, near = rest + alike * 0.2, address[r]
        why = sum(bit.astype(np.int32) << at for at, bit in enumerate([near > 0.8, (near > 0.6) & (near <= 0.8), alike > 0.8, same, values > 0.8, areas > 0.8]))
        kept = np.flatnonzero(score >= least - 1e-5)  # Spark rounds
        a, b = a[kept], b[kept]
        swapped = rank[a] > rank[b]
        a, b = np.where(swapped, b, a), np.where(swapped, a, b)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(n[a]), pa.array(n[b]), pa.array(score[kept]), pa.array(why[kept])], ["a", "b", "n_a", "n_b", "score", "why"])


def _scores_of_blocks(one: DataFrame, block: list[str], least: float, least_address: float) -> DataFrame:
    """scored_pairs of blocks whose profiles fit one task. Addresses and their
    profiles are dealt out by block, once: neither near addresses nor profiles are joined."""
    kind = one.schema["profile"].dataType
    some = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit(0.0)) for n in names)).cast("double")
    profile = F.struct("profile", "n", "low", "high", long_address(F.coalesce("title", F.lit(""))).alias("title"), "category", some("evaluation_value", "first_auction_value").alias("value"), some("area_total", "area_privativa").alias("area"))
    tasks = max(32, 8 * one.sparkSession.sparkContext.defaultParallelism)  # much work in few bytes
    heads = one.repartition(tasks, *block).groupBy(*block, "_full").agg(F.min("profile").alias("head"), F.collect_list(profile).alias("of")).withColumn("parts", address_parts(F.col("_full")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scored_block(pa.Table.from_batches(batches), least, least_address)

    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b")), T.StructField("score", T.DoubleType()), T.StructField("why", T.IntegerType())])
    reasons = F.array(*(F.lit(",".join(r for i, r in enumerate(_REASONS) if bits >> i & 1)) for bits in range(1 << len(_REASONS))))
    found = heads.groupBy(*block).applyInArrow(compare, schema).withColumn("score", F.round("score", 6)).where(F.col("score") >= least)
    return found.select("a", "b", "n_a", "n_b", "score", F.get(reasons, F.col("why")).alias("reasons"))


def scored_pairs(rows: DataFrame, least: float = 0.75, least_address: float = 0.85, most: int = 2048, most_profiles: int = 32_768) -> DataFrame:
    """Profiles a <= b (see `profiles`) in one city and state that different
    auctioneers have, whose score is at least `least`: a, b, n_a and n_b (their
    listings), score, reasons. a = b: listings of one profile by several auctioneers.
    So equal listings, however many stand at one address, are one row. Compared are
    profiles whose addresses have a ratio of at least `least_address`; addresses are
    compared once for each two that differ. A city and state of at most `most`
    addresses and `most_profiles` profiles goes through one task; larger ones are joined."""
    block, seller = ["_city", "_state"], F.coalesce(F.col("auctioneer_id").cast("string"), F.lit(""))
    one = stored(_placed(rows).groupBy(*block, "_full", *_SCORED).agg(F.min("id").alias("profile"), F.count(F.lit(1)).alias("n"), F.min(seller).alias("low"), F.max(seller).alias("high")), "profiles")
    sizes = one.groupBy(*block).agg(F.count_distinct("_full").alias("texts"), F.count(F.lit(1)).alias("profiles"))
    large = stored(sizes.where((F.col("texts") > most) | (F.col("profiles") > most_profiles)).select(*block), "large")
    if large.isEmpty():
        return _scores_of_blocks(one, block, least, least_address)
    return _scores_of_blocks(one.join(large, block, "left_anti"), block, least, least_address).union(_scores_by_joins(one.join(large, block, "left_semi"), block, least, least_address, most))


def _scores_by_joins(one: DataFrame, block: list[str], least: float, least_address: float, most: int) -> DataFrame:
    """scored_pairs of blocks of any size. The tables of addresses grow with the data and take
    little room as files, so by these they would be broadcast: they are merged."""
    heads = stored(one.groupBy(*block, "_full").agg(F.min("profile").alias("head")).withColumn("parts", address_parts(F.col("_full"))), "heads")
    members = one.join(heads.drop("parts").hint("merge"), [*block, "_full"]).select("head", "profile", "n", "low", "high", *_SCORED)
    near = text_pairs(heads.select(*block, F.col("_full").alias("t"), F.col("head").alias("id")), block, least_address, most)
    named = lambda i: heads.select(F.col("head").alias(f"h{i}"), F.col("_full").alias(f"t{i}"), F.col("parts").alias(f"p{i}")).hint("merge")
    near = with_address(near.toDF("h1", "h2", "ratio").join(named(1), "h1").join(named(2), "h2"), "t1", "t2", F.col("ratio"), (F.col("p1"), F.col("p2"))).select("h1", "h2", "address")
    near = near.union(heads.select("head", "head", F.when(F.col("_full") == "", 0.0).otherwise(1.0)))  # the same address is near itself
    side = lambda s, h: members.select(F.col("head").alias(h), *(F.col(c).alias(f"{s}_{c}") for c in ["profile", "n", "low", "high", *_SCORED])).hint("merge")
    several = (F.col("a_low") != F.col("b_low")) | (F.col("a_high") != F.col("b_high")) | (F.col("a_low") != F.col("a_high"))
    met = near.join(side("a", "h1"), "h1").join(side("b", "h2"), "h2").where(several & ((F.col("h1") != F.col("h2")) | (F.col("a_profile") <= F.col("b_profile"))))
    swapped = F.col("a_profile") > F.col("b_profile")
    return pair_score(met, least).select(
        F.least("a_profile", "b_profile").alias("a"), F.greatest("a_profile", "b_profile").alias("b"), F.when(swapped, F.col("b_n")).otherwise(F.col("a_n")).alias("n_a"),
        F.when(swapped, F.col("a_n")).otherwise(F.col("b_n")).alias("n_b"), "score", "reasons",
    )


def losers(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Of each pair the row with fewer points (id, points); the second of a tie. Distinct ids with their best partner."""
    p = points.select("id", "points")
    full = pairs.join(p.toDF("a", "pa"), "a").join(p.toDF("b", "pb"), "b")
    lost = F.when(F.col("pa") < F.col("pb"), F.col("a")).otherwise(F.col("b"))
    kept = F.when(F.col("pa") < F.col("pb"), F.col("b")).otherwise(F.col("a"))
    return full.select(lost.alias("id"), kept.alias("original_id")).groupBy("id").agg(F.min("original_id").alias("original_id"))


def mark_duplicates(rows: DataFrame, lost: DataFrame) -> DataFrame:
    out = rows.drop("original_id").join(lost, "id", "left")
    return out.withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)) | F.col("original_id").isNotNull())
