"""Quality rules with thresholds that follow each language and source.

Every text is measured with SQL functions alone. The measures of a group are
gathered in a quantile sketch of logarithmic cells (counts of ceil(log_g(x)),
so a quantile is exact to a factor of g): cells of parts add up to the cells of
the whole, in any order, hence the same thresholds on any cluster. Fences are
the quartiles plus `reach` times a width that the sketch gives. For word length
that is the distance of the quartiles, or the sampling error of a mean over the
group's median number of words if copies make that smaller. For measures that
most texts have none of it is the median of the values above zero, but not more
than `reach` occurrences in the group's median text: where all values above zero
lie far from it, they are the outliers and don't widen their own fence. One
occurrence alone never rejects a text. The fences of a group with n texts count
n times and those of its language `least` times; likewise a language and all.

Defined results: a null text has no words and fails the base rules; a null
language or source is a group of its own; repeated rows count each time; a text
on a fence is kept; texts of any length are measured whole; keys may have any
type; an empty table gives an empty result; other columns, whatever their names,
pass through `quality_filter`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, SPACES, let, text_or_empty, written

#: Relative width of the sketch's cells.
GAMMA = 1.02
#: Whole-number measures of a text (per mille of the words or lines, or hundredths of a character),
#: and how much one occurrence of a counted one holds: two 3-word windows are six words.
MEASURES = {"symbols": 1, "repeats": 6, "dup_lines": 1, "word_length": None}
#: Both fences bind for these; for others only the upper one.
TWO_SIDED = {"word_length"}


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN)))


def _repeated(w: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more.

    A window's 33-bit hash and its position make one long; sorted, equal
    hashes are neighbours. Windows that share a hash are then compared as
    words, so the count is exact. w: a bound lambda argument."""
    bits = 31  # of the position: all that an array can have
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    coded = lambda h: F.transform(h, lambda x, i: F.shiftleft(x, bits).bitwiseOR(i.cast("long")))

    def positions(s: Column) -> Column:
        same = lambda a, b: F.shiftright(a, bits).eqNullSafe(F.shiftright(b, bits))
        near = F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | same(x, F.get(s, i - 1)))
        return F.transform(near, lambda x: x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int"))

    def covered(near: Column) -> Column:
        full = F.sort_array(F.transform(near, lambda i: F.struct(w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.alias("i"))))

        def exact(t: Column) -> Column:
            equal = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
            kept = F.filter(t, lambda x, i: F.when(i > 0, equal(x, F.get(t, i - 1))).otherwise(False) | equal(x, F.get(t, i + 1)))
            return F.size(F.array_distinct(F.flatten(F.transform(kept, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(near) == 0, F.lit(0)).otherwise(let(full, exact))

    counted = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
        let(let(F.sort_array(coded(h)), positions), covered)
    )
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes, counted))


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or `keep` of them) and n_words, word_chars, n_symbols,
    n_lines, n_dup_lines, n_repeat_words (long) and base_failed of each text."""

    def measures(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
        return F.struct(
            let(_words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).cast("long").alias("r"), F.length(F.array_join(w, "")).cast("long").alias("c"))).alias("words"),
            let(lines, lambda a: F.struct(F.size(a).cast("long").alias("n"), F.size(F.array_distinct(a)).cast("long").alias("d"))).alias("lines"),
            F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("symbols"),
        )

    out = docs.select(*(docs.columns if keep is None else keep), let(text_or_empty(text), measures).alias("_measured"))
    m = F.col("_measured")
    return out.withColumns({
        "n_words": m["words"]["n"], "word_chars": m["words"]["c"], "n_symbols": m["symbols"], "n_lines": m["lines"]["n"],
        "n_dup_lines": m["lines"]["n"] - m["lines"]["d"], "n_repeat_words": m["words"]["r"],
        "base_failed": (m["words"]["n"] < 50) | (100 * m["words"]["r"] > 50 * m["words"]["n"]),
    }).drop("_measured")


def _per(part: str, whole: str, scale: int) -> Column:
    return F.expr(f"(case when {whole} > 0 then {scale} * {part} div {whole} else 0 end)")


#: Part, whole and scale of each measure.
MEASURED = {
    "symbols": ("n_symbols", "n_words", 1000),
    "repeats": ("n_repeat_words", "n_words", 1000),
    "dup_lines": ("n_dup_lines", "n_lines", 1000),
    "word_length": ("word_chars", "n_words", 100),
}


def sketches(rows: DataFrame, groups: list[str]) -> DataFrame:
    """The sketch of each measure, and of the sizes that it is a share of, over
    the rows that passed the base rules: group columns, measure, cell, n. Cell 0
    holds zeros, cell 1 ones."""
    sizes = {whole: F.col(whole) for _, whole, _ in MEASURED.values()}
    pairs = F.array(*(F.struct(F.lit(k).alias("measure"), x.cast("long").alias("x")) for k, x in ({k: _per(*v) for k, v in MEASURED.items()} | sizes).items()))
    long = rows.where(~F.col("base_failed")).select(*groups, F.explode(pairs).alias("m")).select(*groups, "m.*")
    cell = F.when(F.col("x") <= 0, F.lit(0)).otherwise(F.ceil(F.log(F.col("x").cast("double")) / F.lit(math.log(GAMMA))) + 1)
    return long.groupBy(*groups, "measure", cell.cast("long").alias("cell")).agg(F.count(F.lit(1)).alias("n"))



def fences(sketch: DataFrame, groups: list[str], reach: float = 3.0) -> DataFrame:
    """The number of texts of each group, and low_/high_ of each measure. A
    quantile is the middle of the cell in which the sorted values reach it."""
    whole = sketch.groupBy(*groups, "measure").agg(
        F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("cell", "n"))).alias("cells")
    )  # a few hundred cells at most, whatever the group's size: values are per mille, and sizes have 35 a doubling
    above = F.filter("cells", lambda c: c["cell"] > 0)

    def quantile(share: float, cells: Column = F.col("cells")) -> Column:
        def reached(total: Column) -> Column:
            return F.aggregate(
                cells,
                F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).cast("long").alias("cell")),
                lambda s, c: F.struct(
                    (s["seen"] + c["n"]).alias("seen"),
                    F.when((s["cell"] < 0) & ((s["seen"] + c["n"]) >= F.lit(share) * total), c["cell"]).otherwise(s["cell"]).alias("cell"),
                ),
                lambda s: s["cell"],
            )

        at = let(F.aggregate(cells, F.lit(0).cast("long"), lambda t, c: t + c["n"]), reached)
        return F.when(at <= 0, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), (at - 1).cast("double")) * F.lit(2.0 / (1.0 + GAMMA)))

    levels = F.struct(F.col("total"), quantile(0.25).alias("q1"), quantile(0.5).alias("q2"), quantile(0.75).alias("q3"), quantile(0.5, above).alias("above"))
    q = whole.select(*groups, "measure", levels.alias("q"))
    names = [*MEASURES, *{size for _, size, _ in MEASURED.values()}]
    q = q.groupBy(*groups).agg(*(F.max(F.when(F.col("measure") == k, F.col("q"))).alias(k) for k in names))
    q = q.where(F.col("n_words").isNotNull())  # without groups, an aggregate of no rows is a row
    out = [F.col("n_words.total").alias("texts")]
    for k, unit in MEASURES.items():
        _, size, scale = MEASURED[k]
        own, n = F.col(f"{k}.q3") - F.col(f"{k}.q1"), F.greatest(F.col(f"{size}.q2"), F.lit(1.0))
        if unit is None:  # lengths of words vary about as their mean's root
            least = scale * F.sqrt(F.col(f"{k}.q2") / scale / n)
        else:
            least = F.least(F.col(f"{k}.above"), F.lit(reach * scale * unit) / n)
        width = F.lit(reach) * F.greatest(own, least)
        out.append((F.col(f"{k}.q3") + width).alias(f"high_{k}"))
        if k in TWO_SIDED:
            out.append((F.col(f"{k}.q1") - width).alias(f"low_{k}"))
    return q.select(*groups, *out)


def judged(rows: DataFrame, language: str = "lang", source: str = "source", reach: float = 3.0, least: int = 100) -> DataFrame:
    """rows (from `measured`) with `kept`: the base rules and the fences of the
    row's group. A join of fences is by group; Catalyst broadcasts it only when
    its measured size allows."""
    fine = sketches(rows, [language, source])
    fine = written(fine, "sketch")  # groups * a few hundred cells
    coarse = fine.groupBy(language, "measure", "cell").agg(F.sum("n").alias("n"))
    all_rows = coarse.groupBy("measure", "cell").agg(F.sum("n").alias("n"))
    names = [f"high_{k}" for k in MEASURES] + [f"low_{k}" for k in MEASURES if k in TWO_SIDED]
    by_source = fences(fine, [language, source], reach).select(
        F.col(language).alias("_l1"), F.col(source).alias("_s1"), F.struct("texts", *names).alias("_f1"))
    by_language = fences(coarse, [language], reach).select(F.col(language).alias("_l2"), F.struct("texts", *names).alias("_f2"))
    by_all = fences(all_rows, [], reach).select(F.struct(*names).alias("_f3"))  # one row
    out = (
        rows.join(by_source, F.col(language).eqNullSafe(F.col("_l1")) & F.col(source).eqNullSafe(F.col("_s1")), "left")
        .join(by_language, F.col(language).eqNullSafe(F.col("_l2")), "left")
        .join(F.broadcast(by_all), F.lit(True), "left")
    )

    def fence(name: str) -> Column:
        """Of the group, drawn towards its language's, which is drawn towards that of
        all; upper ones by their logarithms, so that a few odd texts of a small group
        don't open its fence to themselves."""
        upper = name.startswith("high_")
        scaled = lambda x: F.log1p(x) if upper else x
        x = scaled(F.col(f"_f3.{name}"))
        for part in ("_f2", "_f1"):
            n = F.col(f"{part}.texts")
            x = F.coalesce((n * scaled(F.col(f"{part}.{name}")) + least * x) / (n + least), x)
        return F.expm1(x) if upper else x

    bad = F.lit(False)
    for k, unit in MEASURES.items():
        x, several = _per(*MEASURED[k]), F.lit(True) if unit is None else F.col(MEASURED[k][0]) > unit
        bad = bad | F.coalesce(several & (x > fence(f"high_{k}")), F.lit(False))
        if k in TWO_SIDED:
            bad = bad | F.coalesce(x < fence(f"low_{k}"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~bad).drop("_l1", "_s1", "_f1", "_l2", "_f2", "_f3")


def quality_report(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", source: str = "source") -> DataFrame:
    """Key, measures, base_failed and kept of every row; texts are read once."""
    rows = written(measured(docs, text, [key, language, source]), "quality")
    return judged(rows, language=language, source=source)


def quality_filter(docs: DataFrame, text: str = "text", language: str = "lang", source: str = "source") -> DataFrame:
    """The rows that are kept, with docs' own columns. Texts are measured once,
    into a written table: sketches read its small columns alone, and a filter on
    measures that are not yet written would repeat them for each part of it."""
    own = docs.columns
    renamed = docs.select(F.struct(*own).alias("_own"), F.col(text).alias("_text"), F.col(language).alias("_language"), F.col(source).alias("_source"))
    rows = written(measured(renamed, "_text", ["_own", "_language", "_source"]), "quality")
    return judged(rows, language="_language", source="_source").where("kept").select("_own.*")
