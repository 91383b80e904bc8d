"""Line templates against all pairs, and leaves of many unlike lines."""

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "leaf long, h1 long, h2 int, words array<long>, texts long, need int"


def share(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True)) / len(a)


def make(seed, n, size, leaves=2):
    r = random.Random(seed)
    forms = {leaf: [[r.randrange(10**6) for _ in range(size)] for _ in range(6)] for leaf in range(leaves)}
    lines = []
    for i in range(n):
        leaf = r.randrange(leaves)
        words = list(r.choice(forms[leaf]))
        for at in r.sample(range(3, size), r.randrange(0, size - 3)):
            words[at] = r.randrange(10**6)
        lines.append((leaf, i * 7919 % n, i, [leaf] * 3 + words[3:], r.randrange(1, 4), 3))
    return lines


@pytest.mark.parametrize("size", [5, 8, 16, 33])
def test_lines_that_agree_share_a_run(spark, size):
    from gavelspark.llm.line_dedup import may_agree

    lines = make(size, 150, size)
    kept = {r.h2 for r in may_agree(spark.createDataFrame(lines, SCHEMA), 0.7, 3).collect()}
    needed = {a[2] for a in lines for b in lines if a is not b and a[0] == b[0] and share(a[3], b[3]) >= 0.7}
    assert needed <= kept and needed and (size < 16 or len(kept) < len(lines))


def test_lines_go_to_templates_they_agree_with(spark):
    from gavelspark.llm.line_dedup import _templates

    lines = make(1, 120, 14)
    by = {(a[1], a[2]): a for a in lines}
    found = {(r.h1, r.h2): (r.t1, r.t2) for r in _templates(spark.createDataFrame(lines, SCHEMA), 0.7).collect()}
    templates = set(found.values())
    for line, template in found.items():
        a, t = by[line], by[template]
        assert a[0] == t[0] and share(a[3], t[3]) >= 0.7
    # A line without a template agrees with too few others that have none.
    alone = [a for k, a in by.items() if k not in found]
    for a in alone:
        others = [b for b in alone if b[0] == a[0]]
        assert len(others) == 1 or sum(b[4] for b in others) < 3
    assert 2 < len(templates) < len(lines)


def test_a_leaf_of_unlike_lines_is_not_compared(spark):
    from gavelspark.llm.line_dedup import dedup_lines, may_agree

    lines = spark.range(40_000).select(F.lit(1).cast("long").alias("leaf"), F.xxhash64("id").alias("h1"), F.hash("id").alias("h2"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when(i < 3, i.cast("long")).otherwise(F.xxhash64("id", i))).alias("words"), F.lit(1).cast("long").alias("texts"), F.lit(3).alias("need"))
    assert may_agree(lines, 0.7, 3).count() == 0
    words = F.array_join(F.transform(F.sequence(F.lit(3), F.lit(15)), lambda i: F.translate(F.hex(F.xxhash64("id", i)), "0123456789", "ghijklmnop")), " ")
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("this is a "), words).alias("text"))
    assert dedup_lines(docs).where("n_dropped_lines > 0").count() == 0
