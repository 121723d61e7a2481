"""Encoding by a table of distinct words, and decoding, against the tokenizers library."""

import hashlib

import numpy as np
import pytest

pytest.importorskip("defectloom.llm")

from pyspark.sql import functions as F

from defectloom.llm import bpe, word_table
from defectloom.llm.queries import op12_bpe_codec

DOCS = "doc_id long, text string, words string, ids string, word string"
TEXTS = [
    None, "", "one two three", "one two three", "  a b\n\nc  d ", "a\tb   c", "it's <|endoftext|> here", "a  <|endoftext|><|endoftext|>  b!<|endoftext|>?", "<|endoftext|>", "<|endoftext", "日本語 テキスト。\n1,000.5 £", "\0x \0y", "!!!", "palabra larga " * 6000,
    "x" * 5000, "!" * 20_000, " " * 3000, "é́ ñ º 🙂", "I'm you'll they've 'S 'd'ré's", "½²³ ٣ x²", "ࡰࢉ \U00010d40\U0001e4d0a ​ 　  x y", "\r\n \r\n\x0b\x0c \x1c\x85z", "�﻿", "1a2b3c ' '' a' 'b",
]


def rows():
    return [(i if i != 5 else None, t, "clash", "clash", None) for i, t in enumerate(TEXTS)] + [(2, "one two three", "", "", ""), (None, None, "", "", "")] + [(1000 + i, "copied text with rareword" + ("s" if i == 3 else ""), "", "", "") for i in range(40)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


def test_words_of_every_character(spark, library):
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rng = np.random.default_rng(4)
    order = rng.permutation(len(points))
    letters = ["a", "1", " ", "!", "é", "\n", "'s", "  ", "<|endoftext|>"]
    texts = ["".join(points[i] + letters[int(k)] for i, k in zip(order[at : at + 5000], rng.integers(0, len(letters), 5000))) for at in range(0, len(points), 5000)]
    pattern = word_table.word_pattern(spark, bpe.default_tokenizer())
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", word_table.words_of(F.col("t"), pattern).alias("w")).collect()
    for r in got:
        parts = texts[r["i"]].split("<|endoftext|>")
        expect = []
        for k, p in enumerate(parts):
            expect += ["<|endoftext|>"] * (k > 0) + [p[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(p)]
        assert r["w"] == expect


@pytest.mark.parametrize(("frequent", "hot_share"), [(1 << 20, 0.001), (40, 0.2), (25, 0.0), (0, 0.0)])
def test_ids_equal_the_library(docs, library, frequent, hot_share):
    rows_ = word_table.encode(docs, frequent=frequent, hot_share=hot_share, salts=3, decoded=True).collect()
    assert all(r["text"] == library.decode(r["ids"], skip_special_tokens=False) for r in rows_)
    got = sorted(((r["doc_id"], r["ids"]) for r in rows_), key=repr)
    assert got == sorted(((d, library.encode(t or "", add_special_tokens=False).ids) for d, t, *_ in rows()), key=repr)


def test_every_word_is_encoded_once(docs, spark):
    path = bpe.default_tokenizer()
    words = word_table.distinct_words(docs, "text", word_table.word_pattern(spark, path))
    table = word_table.encoded_words(words, path).collect()
    assert len({r["word"] for r in table}) == len(table) == words.count()
    often, rare = word_table.frequent_words(word_table.encoded_words(words, path), 30, 1 << 20)
    many, few = often.collect(), rare.collect()
    assert len(many) <= 30 and len(many) + len(few) == len(table) and min(r["n"] for r in many) >= max(r["n"] for r in few if len(r["word"].encode()) <= 64)
    assert word_table.frequent_words(word_table.encoded_words(words, path), 1 << 20, 10)[0].count() == 0


def test_words_of_one_hash_are_told_apart(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(word_table.Frequent, "hash", staticmethod(lambda words: np.array([len(w) % 2 for w in words.to_pylist()], dtype=np.uint64)))
    held = ["a", "bb", "c", "dd", "eee"]
    t = word_table.Frequent(pa.array(held), pa.array([bytes([i, 0, 0, 0]) * (i + 1) for i in range(5)]))
    asked = ["eee", "x", "dd", "a", "yy", "bb"]
    found = t.numbers(pa.array(asked))
    assert [t.words[int(i)].as_py() if i >= 0 else None for i in found] == ["eee", None, "dd", "a", None, "bb"]


def test_decoding(spark, library):
    rng = np.random.default_rng(8)
    lists = [[], None, [50256], [0, None, 5], [-1, 50257, 1 << 30, 7], *[rng.integers(0, 50257, int(rng.integers(1, 40))).tolist() for _ in range(50)]]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>").repartition(3)
    got = {r["doc_id"]: r["text"] for r in word_table.decode(df).collect()}
    for i, x in enumerate(lists):
        known = [y for y in x or [] if y is not None and 0 <= y < 50257]
        assert got[i] == library.decode(known, skip_special_tokens=False)


def test_edges(docs, spark):
    assert word_table.encode(docs.limit(0)).count() == 0
    nothing = spark.createDataFrame([(None, None), (1, ""), ("x1", " ")], "doc_id string, text string")
    assert sorted((r["doc_id"], r["ids"]) for r in word_table.encode(nothing).where("doc_id is not null").collect()) == [(1, [])]
    assert word_table.encode(nothing).count() == 3


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    expect = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        expect[r["doc_id"]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op12_bpe_codec(spark, sf).collect()}
    assert got == expect
