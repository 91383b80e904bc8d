"""Lines that recur across documents, found through a tree of line templates,
with DataFrame functions only.

A line's way down the tree is its number of words, then its first `depth`
words; words that hold a digit are a wildcard from the start. A leaf holds any
number of templates. Lines agree if they have the same word in at least
`similarity` of their places. Lines that agree differ in few places, so if the
places after the first words are cut into one run more than that, they have a run
in common; lines of a leaf that share no run with any other agree with none and
need not be compared, however many a leaf holds. Of the others: of a sample of the leaf's lines, those with more
texts in agreement than every sampled line they agree with are templates, and
each line goes to the template that it agrees with most. Lines that have none
are sampled again, more of them each round, until too few texts are left in the
leaf for a template. A template, or a single masked line, met in at least
`least` different texts (`least_long` for lines of `long` words or more) is
boilerplate: its lines in the first document (lowest key) stay, so that no
wording is lost from the corpus, and all others are dropped.

Work is spread by (key of a line) with counts made before rows are moved; lines
are split into words only in leaves that hold more than one. Texts move once,
whole, to meet the places of their dropped lines.

Defined results: a null text is kept as it is; an empty text, and lines without
a word, are never dropped; exact repeats of a row are one document, and all of
them lose the same lines; rows with the same key and different texts are
different documents; a document with a null key is first only where no key is
known; of a line's templates that it agrees with equally, the one of the highest
hash takes it; texts of any number of lines are read whole; an empty table gives
an empty result; other columns pass through, but for one named n_dropped_lines,
which is replaced.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, let, written


#: A word with a digit in it, read once from its beginning (as a Java pattern, between single spaces).
FIELD = r"(?<![^\x20])[^\x200-9]*+[0-9][^\x20]*+"


def masked(line: Column) -> Column:
    """A trimmed line with one space between words; one with a digit in it is a variable field."""
    spaced = F.when(line.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(line, SPACE_RUN, " ")).otherwise(line)
    return F.when(line.rlike("[0-9]"), F.regexp_replace(spaced, FIELD, "<*>")).otherwise(spaced)


def n_words(line: Column) -> Column:
    """Of a masked line: words are not split to be counted."""
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each line with a word: key, text_hash, place and the masked line."""
    exploded = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_hash"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("place", "line"))
    trimmed = exploded.withColumn("line", F.btrim("line", F.lit(SPACES))).where("line <> ''")
    return trimmed.select("key", "text_hash", "place", masked(F.col("line")).alias("line"))


def may_agree(lines: DataFrame, similarity: float, depth: int) -> DataFrame:
    """Of lines (leaf, h1, h2, words as hashes) those that share a run of places with another of their leaf."""
    n = F.size("words")
    runs = n - F.ceil(n * F.lit(similarity) - 1e-9).cast("int") + 1
    start = lambda j: F.floor(j * (n - depth) / runs).cast("int")
    run = F.explode(F.transform(F.sequence(F.lit(0), runs - 1), lambda j: F.xxhash64("leaf", j, F.slice("words", depth + 1 + start(j), start(j + 1) - start(j)))))
    each = lines.select("h1", "h2", run.alias("run"))
    shared = each.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("run")
    some = each.join(shared, "run", "left_semi").select("h1", "h2").distinct()
    return lines.join(some, ["h1", "h2"], "left_semi")


def _templates(open_lines: DataFrame, similarity: float, salt: int = 16, sample: int = 32) -> DataFrame:
    """h1, h2 and their template's t1, t2, for the lines (leaf, h1, h2, words as
    hashes, texts, need) that have one. A leaf's lines meet its sample in `salt` parts."""
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long")))
    done = []
    while True:
        in_part, in_leaf = (Window.partitionBy(*by).orderBy("h1", "h2") for by in (("leaf", "part"), ("leaf",)))
        parts = open_lines.select("leaf", "h1", "h2", "words", F.pmod(F.xxhash64("h2"), F.lit(salt)).alias("part"))
        lowest = parts.withColumn("rank", F.row_number().over(in_part)).where(F.col("rank") <= sample)  # of parts of a leaf, then of the leaf
        lowest = lowest.withColumn("rank", F.row_number().over(in_leaf)).where(F.col("rank") <= sample)
        centers = lowest.select("leaf", F.col("h1").alias("t1"), F.col("h2").alias("t2"), F.col("words").alias("center"), salts.alias("salt"))
        lines = open_lines.withColumn("salt", F.pmod(F.xxhash64("h1", "h2"), F.lit(salt)))
        share = F.size(F.filter(F.zip_with("words", "center", lambda x, y: x == y), lambda same: same)) / F.size("words")
        met = lines.join(centers, ["leaf", "salt"]).select("leaf", "h1", "h2", "texts", "t1", "t2", share.alias("share")).where(F.col("share") >= F.lit(similarity))
        met = written(met, "met")
        weight = met.groupBy("t1", "t2").agg(F.sum("texts").alias("weight"))
        both = met.join(weight, ["t1", "t2"]).join(weight.toDF("h1", "h2", "own"), ["h1", "h2"])  # both are of the sample
        beaten = both.where(F.struct("weight", "t1", "t2") > F.struct("own", "h1", "h2")).select(F.col("h1").alias("t1"), F.col("h2").alias("t2")).distinct()
        best = F.max(F.struct("share", "t1", "t2")).alias("best")
        found = written(met.join(beaten, ["t1", "t2"], "left_anti").groupBy("h1", "h2").agg(best).select("h1", "h2", "best.t1", "best.t2"), "found")
        done.append(found)
        rest = open_lines.join(found, ["h1", "h2"], "left_anti")
        worth = rest.groupBy("leaf").agg(F.count(F.lit(1)).alias("lines"), F.sum("texts").alias("all"), F.min("need").alias("least"))
        worth = worth.where((F.col("lines") > 1) & (F.col("all") >= F.col("least"))).select("leaf")
        open_lines = written(rest.join(worth, "leaf", "left_semi").select(*open_lines.columns), "open")
        if open_lines.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)
        sample *= 2


def recurring(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 6, depth: int = 3, similarity: float = 0.7, shortest: int = 5, least_long: int = 3, long: int = 16) -> tuple[DataFrame, DataFrame]:
    """(lines, templates): lines as hashes (h1, h2); the hashes whose template
    recurs, with its number of texts and first key. Lines of fewer than
    `shortest` words are not generalised beyond their masked fields."""
    size = n_words(F.col("line"))
    leaf = F.when(size >= max(shortest, depth + 2), F.xxhash64(size, F.substring_index("line", " ", depth)))
    need = F.when(size >= long, F.lit(min(least, least_long))).otherwise(F.lit(least))
    h1, h2 = F.xxhash64("line").alias("h1"), F.hash("line").alias("h2")
    lines = line_table(docs, key, text).select("key", "text_hash", "place", h1, h2, leaf.alias("leaf"), need.alias("need"))
    lines = written(lines, "lines")
    # One row for each masked line and text: a line that fills a third of a table is counted where it stands.
    pairs = written(lines.groupBy("h1", "h2", "text_hash").agg(F.min("key").alias("key"), F.min("leaf").alias("leaf"), F.min("need").alias("need")), "pairs")
    exact = written(pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("texts"), F.min("key").alias("first"), F.min("leaf").alias("leaf"), F.min("need").alias("need")), "exact")
    crowded = exact.where("leaf is not null").groupBy("leaf").agg(F.count(F.lit(1)).alias("lines"), F.sum("texts").alias("texts"), F.min("need").alias("need"))
    crowded = written(crowded.where((F.col("lines") > 1) & (F.col("texts") >= F.col("need"))).select("leaf"), "leaves")
    worded = (
        line_table(docs, key, text).select("line", leaf.alias("leaf")).join(crowded, "leaf", "left_semi")
        .select(h1, h2, F.transform(F.split("line", " "), lambda w: F.xxhash64(w)).alias("words")).groupBy("h1", "h2").agg(F.first("words").alias("words"))
    )
    candidates = written(exact.join(worded, ["h1", "h2"]).select("leaf", "h1", "h2", "words", "texts", "need"), "candidates")
    of_template = _templates(written(may_agree(candidates, similarity, depth), "open"), similarity)
    whole = (
        pairs.join(of_template, ["h1", "h2"]).groupBy("t1", "t2", "text_hash").agg(F.min("key").alias("key"), F.min("need").alias("need"))
        .groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("texts"), F.min("key").alias("first"), F.min("need").alias("need")).where(F.col("texts") >= F.col("need"))
    )
    of_leaf = written(of_template.join(whole, ["t1", "t2"]).select("h1", "h2", "texts", "first", F.lit(True).alias("general")), "general")
    of_line = exact.where(F.col("texts") >= F.col("need")).join(of_leaf, ["h1", "h2"], "left_anti").select("h1", "h2", "texts", "first", F.lit(False).alias("general"))
    return lines.select("key", "text_hash", "place", "h1", "h2"), of_leaf.unionByName(of_line)


def dropped_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", salt: int = 16, **limits) -> DataFrame:
    """key, text_hash and the places of the lines to drop, for texts that have any.
    A recurring line meets its template in `salt` parts, so that no part holds a
    hot line whole."""
    lines, found = recurring(docs, key, text, **limits)
    lines = lines.withColumn("salt", F.pmod(F.xxhash64("text_hash", "place"), F.lit(salt)))
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
    hit = lines.join(found, ["h1", "h2", "salt"])
    return hit.where(~F.col("key").eqNullSafe(F.col("first"))).groupBy("key", "text_hash").agg(F.collect_set("place").alias("places"))  # lines of one text


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """docs' columns with the text without its recurring lines, and n_dropped_lines."""
    own = [c for c in docs.columns if c != "n_dropped_lines"]
    packed = docs.select(F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("_hash"), F.struct(*own).alias("_own"))
    gone = dropped_lines(docs, key, text, **limits).select(F.col("key").alias("_k"), F.col("text_hash").alias("_h"), "places")
    out = packed.join(gone, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")), "left")
    def without(lines: Column) -> Column:
        """Set difference of places, so the work follows the number of lines."""
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "places")
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    kept = let(F.split(F.col(f"_own.{text}"), "\n", -1), without)
    columns = [
        F.when(F.col("places").isNull(), F.col("_own")[c]).otherwise(kept).alias(c) if c == text else F.col("_own")[c].alias(c) for c in own
    ]
    return out.select(*columns, F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped_lines"))
