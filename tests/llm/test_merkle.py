"""The Merkle manifest against a brute-force tree, over keys with ties and nulls."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree string"
UPPER = {i: i + 32 for i in range(65, 91)}


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(key, text, lang, source, n):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (key, source, lang, n, text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def proof(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = i // 8 * 8
        out.append((i - run, nodes[run : i] + nodes[i + 1 : run + 8]))
        i //= 8
    return out


def brute(rows):
    trees = defaultdict(list)
    for key, text, lang, source, n, *_ in rows:
        hit = key is not None and zlib.crc32(str(key).encode()) % 3 == 0 and text is not None
        own = leaf(key, text, lang, source, n)
        trees[lang].append((key is not None, key, own, leaf(key, text.translate(UPPER), lang, source, n) if hit else own))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {}
    for name in names:
        trees[name].sort()
        levels[name] = levels_of([x[2] for x in trees[name]])
    top = levels_of([levels[n][-1][0] for n in names])
    out = []
    for t, name in enumerate(names):
        for i, (_, key, own, now) in enumerate(trees[name]):
            steps = proof(levels[name], i) + proof(top, t)
            folded = now
            for slot, others in steps:
                folded = h("".join(others[:slot] + [folded] + others[slot:]))
            out.append((key, own, levels[name][-1][0], top[-1][0], h("".join(x for _, s in steps for x in s)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def same(spark, rows, **how):
    from gavelspark.llm.merkle import manifest

    got = manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), **how)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def make(n, langs, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice(["Some Text %d", "plain %d", "ÀÉ É %d"]) % i, r.choice(langs), r.choice(["s", None]), r.choice([None, i]), "clash", "clash") for i in range(n)]
    return rows + [(None, "No Key", langs[0], None, None, "", "")] + [(3, None, langs[0], None, None, "", "")] * 3 + [(4, "", langs[-1], "", 0, "", "")]


def test_every_proof_as_by_hand(spark):
    same(spark, make(700, ["en", "en", "en", "de", None, ""]))


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_sizes_around_a_run(spark, n):
    same(spark, [(i, "Ab", "x", None, i, "", "") for i in range(n)] + [(0, "Ab", "y", None, 0, "", "")])


def test_many_trees_long_texts_and_a_hot_key(spark):
    rows = [(i, "T", f"l{i}", None, None, "", "") for i in range(80)]
    same(spark, rows + [(7, "Hot", "en", "s", 1, "", "")] * 40 + [(9, "Wörd " * 300_000, "en", "s", 1, "", "")])


@pytest.mark.parametrize("band", [1, 2, 3])
def test_bands_of_levels(spark, band):
    same(spark, make(600, ["en", "de"], 3), band=band)


def test_empty(spark):
    from gavelspark.llm.merkle import manifest

    assert manifest(spark.createDataFrame([], SCHEMA)).count() == 0
