"""Ranked search against scoring every document, and its block cuts against all cuts."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, item_id string, score string, shard string"


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    bags = [(key, Counter(terms(text))) for key, text in docs]
    bags = [(key, bag) for key, bag in bags if bag]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(set)
    for item, text in items:
        asked[item].update(terms(text))
    out = []
    for item, own in asked.items():
        scores = []
        for key, bag in bags:
            m = 100 - 50 + (50 * sum(bag.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in own if t in bag)
            if s > 0:
                scores.append((-s, key is None, key, s))
        out += [(item, i + 1, key, s) for i, (_, _, key, s) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def make():
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefgé日") for _ in range(r.randint(1, 5))) for _ in range(150)]
    weights = [1 / (i + 1) for i in range(150)]
    prose = lambda n: " ".join(r.choices(vocabulary, weights, k=n))
    docs = [(i, prose(r.randint(1, 120))) for i in range(600)]
    docs += [(1000 + i * 7 % 400, "hot Copy of one, text!") for i in range(400)] + [(5, docs[5][1])] * 3
    docs += [(None, docs[7][1]), (None, None), (8, ""), (9, "\n --- \x00"), (10, "x" * 300_000 + " hot"), (11, "common " * 40_000)]
    items = [(i, prose(r.randint(1, 30))) for i in range(25)] + [(25, "HOT copy"), (26, None), (27, "..."), (28, "never-met-word"), (25, "common"), (29, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("shape", [{}, {"shard_docs": 50}, {"shard_terms": 400, "most_terms": 60}])
def test_same_as_scoring_all(spark, shape):
    from gavelspark.llm.ranked_search import build_index, search_index

    docs, items = make()
    df = spark.createDataFrame([(k, t, "clash", "clash", "clash") for k, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    index = build_index(df, **{k: v for k, v in shape.items() if k != "most_terms"})
    assert index.count() > 3 or "shard_docs" not in shape
    for k in (50, 3):
        found = search_index(index, asked, k, **{k: v for k, v in shape.items() if k == "most_terms"})
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(docs, items, k)


def test_text_keys_and_empty_sides(spark):
    from gavelspark.llm.ranked_search import rank_documents

    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", None)], "doc_id string, text string")
    items = spark.createDataFrame([("q", "two")], "item_id string, text string")
    more = docs.unionByName(spark.createDataFrame([(f"d{i}", "three") for i in range(5)], docs.schema))
    assert [(r.item_id, r.rank, r.doc_id) for r in rank_documents(more, items).orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b")]
    assert rank_documents(docs.limit(0), items).count() == 0
    assert rank_documents(docs, items.limit(0)).count() == 0


def least_cut(values, overhead):
    from gavelspark.llm.ranked_search import LADDER

    price = overhead * sum(values) // len(values)
    best = [0]
    for i in range(1, len(values) + 1):
        best.append(min(best[i - n] + n * max(values[i - n : i]) + price for n in LADDER.tolist() if n <= i))
    return best[-1], price


def test_blocks_have_the_least_error():
    from gavelspark.llm.ranked_search import choose_blocks

    r = np.random.default_rng(2)
    lists = [r.integers(1, 1_000_000, n) for n in (1, 2, 5, 40, 255, 256, 97)] + [np.repeat([10, 900_000], 100), np.full(130, 7)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    for abreast in (2, 2048):
        cuts, blocks = choose_blocks(np.concatenate(lists), first, 4, abreast)
        at = 0
        for i, values in enumerate(lists):
            own = [*cuts[at : at + blocks[i]].tolist(), int(first[i + 1])]
            assert own[0] == first[i]
            at += blocks[i]
            cost, price = least_cut(values.tolist(), 4)
            assert sum((b - a) * values[a - first[i] : b - first[i]].max() + price for a, b in zip(own, own[1:], strict=False)) == cost
    long = r.integers(1, 1000, 5000)
    cuts, blocks = choose_blocks(long, np.array([0, 5000]))
    assert cuts[0] == 0 and cuts[-1] == 5000 and blocks[0] == len(cuts) - 1 and (np.diff(cuts) > 0).all()


def test_blocks_are_skipped():
    """A list of low scores with a few high ones: only blocks that can matter are read."""
    from gavelspark.llm.ranked_search import Items, Postings

    docs, n = np.arange(4000), 4000
    lengths = np.where(docs % 400 < 4, 1, 2000)
    items = Items([0], np.array([0]), np.array([9], np.uint64), 100_000, int(lengths.sum()))
    items.weigh({9: 40_000})
    row = {"n_distinct": 1, "n_docs": n, "terms": np.array([9], "<u8").tobytes(), "ends": np.array([n], "<u2").tobytes(), "docs": docs.astype("<u2").tobytes(), "times": np.ones(n, "<u1").tobytes(), "lengths": lengths.astype("<u2").tobytes()}
    p = Postings(row, items, 10, 16)
    read = []
    gather = p.docs
    p.docs = type("Counted", (), {"__getitem__": lambda self, at: read.append(len(at)) or gather[at]})()
    best, scores = p.search(0)
    assert best.tolist() == [d for d in range(n) if d % 400 < 4][:10] and len(set(scores.tolist())) == 1
    assert sum(read) < n / 20
