"""Token files: coding of any ids, and the whole round trip against brute force."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

SCHEMA = "doc_id long, text string, ids string, start string"


def blocks_of(sizes, block):
    return np.array([min(block, n - j * block) for n in sizes for j in range(-(-n // block))], dtype=np.int64)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1), st.just(2**60), st.just(7)), max_size=700), max_size=5), st.sampled_from([4, 64, 256]))
def test_any_ids_come_back(documents, block):
    from gavelspark.llm.token_output import decode, encode

    sizes = [len(d) for d in documents]
    ids = np.array([i for d in documents for i in d], dtype=np.uint64)
    words, of_block, of_doc, escapes, escapes_of = encode(ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), block)
    parts = np.array([-(-n // block) for n in sizes], dtype=np.int64)
    back = decode(words, of_block, blocks_of(sizes, block), escapes, np.repeat(np.cumsum(escapes_of) - escapes_of, parts))
    assert back.tolist() == ids.tolist() and of_doc.sum() == len(words) == of_block.sum()


def test_words_hold_as_many_ids_as_fit():
    from gavelspark.llm.token_output import encode

    def words(ids):
        return encode(np.array(ids, dtype=np.uint64), np.array([0, len(ids)]))[0].tolist()

    assert words([1, 0] * 30) == [(2 << 60) | sum(1 << (2 * i) for i in range(30))]
    assert words([5] * 200) == [(1 << 60) | (200 << 48) | 5]
    assert words([40_000, 1, 50_256]) == [(13 << 60) | 40_000 | (1 << 20) | (50_256 << 40)]
    assert words([2**63]) == [0]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


TEXTS = [None, "", " \n", "One two's THREE", "don't <|endoftext|> 123 £5½", "日本語 text ΣΑΣ", "İstanbul Ⱥ é", "a\x1cb\x85c\xa0d", "x" * 70_000 + " end", "'' 's'll \"'s", "word " * 60_000]


def brute(rows, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    t.encode_special_tokens = True
    out = {}
    for key, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out.setdefault(key, []).append((len(ids), zlib.crc32(ids.tobytes())))
    return {k: sorted(v) for k, v in out.items()}


def test_round_trip(spark, tokenizer):
    from gavelspark.llm.token_output import token_digest

    rows = [(i * 7 % 31, t) for i, t in enumerate(TEXTS * 3)] + [(5, f"hot {i}") for i in range(40)] + [(5, "copy")] * 5 + [(None, "no key"), (None, None)]
    df = spark.createDataFrame([(k, t, "clash", "clash") for k, t in rows], SCHEMA).repartition(5)
    got = token_digest(df, tokenizer).collect()
    mine = {}
    for r in got:
        mine.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in mine.items()} == brute(rows, tokenizer)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    keys = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert keys == sorted(keys)
    assert token_digest(df.limit(0), tokenizer).count() == 0


def test_text_keys_and_whole_ids(spark, tokenizer, tmp_path):
    from tokenizers import Tokenizer

    from gavelspark.llm.token_output import read_tokens, write_tokens

    df = spark.createDataFrame([("b", "two words"), ("a", "ÀÉ ümlaut"), ("c", None)], "doc_id string, text string")
    manifest = write_tokens(df, tokenizer, folder=str(tmp_path))
    back = read_tokens(manifest, "string").orderBy("start").collect()
    t = Tokenizer.from_file(tokenizer)
    assert [(r.key, np.frombuffer(r.ids, "<u4").tolist()) for r in back] == [(k, [*t.encode(x, add_special_tokens=False).ids, 1]) for k, x in (("a", "ÀÉ ümlaut"), ("b", "two words"), ("c", ""))]
    assert manifest.agg({"n_docs": "sum"}).first()[0] == 3 and len(list(tmp_path.glob("*/*.tok"))) == manifest.count()
