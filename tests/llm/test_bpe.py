"""Distinct-word BPE against the tokenizers library on whole texts."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm.bpe import Words, encode_decode, read_vocabulary, units_of
from tidemark.llm.token_files import read_tokens, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "\n\n  \n", "a", "it's they'll I'D", "tab\tand  two  spaces ", "é" * 50, "日本語 テキスト", " nb em　wide ", "1234 ½ ² Ⅷ",
    "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", "<|endoftext", "nul \0\0 \1 \0\1 end", "​﻿́ é", "😀👍🏽 \U0001f1e9\U0001f1ea",
    "\r\n\x0b\x0c\x1c\x85 x", "word " * 3000, "x" * 5000, "###$$$ ...!!!", " '  's 'sS",
]


def texts(seed=5):
    rng = random.Random(seed)
    alphabet = [chr(c) for c in (*range(32, 127), *range(0xA0, 0x250), 0x3042, 0x4E00, 0x1F600, 9, 10, 13, 0x2028, 0x1680, 0x660)]
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(300)]


def library(rows):
    tokenizer = Tokenizer.from_file(PATH)
    out = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    return [(i, ids, tokenizer.decode(ids, skip_special_tokens=False)) for i, ids in out]


def test_equals_library(spark):
    rows = [*enumerate(texts()), (3, "a"), (3, "a"), (None, "no id"), (900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = encode_decode(df, read_vocabulary(spark, PATH)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, list(r.ids), r.decoded) for r in got), key=key) == sorted(library(rows), key=key)


def test_keeps_columns_and_empty_table(spark):
    spec = read_vocabulary(spark, PATH)
    df = spark.createDataFrame([(1, "a b", "x", 5)], "key long, body string, ids string, block long")
    (row,) = encode_decode(df, spec, "key", "body", keep=("block",)).collect()
    assert (row.key, row.block, row.decoded) == (1, 5, "a b")
    assert encode_decode(df.limit(0), spec, "key", "body").collect() == []


def test_distinct_words_are_encoded_like_texts(spark):
    words = Words(read_vocabulary(spark, PATH))
    tokenizer = Tokenizer.from_file(PATH)
    rows = [*texts(6), "plain words, only. Here", " a", "a ", "a\nb c"]
    units, place, first = units_of(pa.array([*rows, None]))
    for t, a, b in zip([*rows, ""], first[:-1], first[1:]):
        ids = [i for k in place[a:b] for w in words.split(units[k]) for i in words.encode(w)]
        assert ids == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("shard_bytes", [1 << 24, 400])
def test_token_files_round_trip(spark, shard_bytes):
    rows = [(i * 7 - 40, t) for i, t in enumerate(texts(8))] + [(10**15, "far"), (10**15 + 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    store = write_tokens(df, read_vocabulary(spark, PATH), shard_bytes=shard_bytes)
    got = {r.doc_id: (r.start, list(r.ids)) for r in read_tokens(store, df.select("doc_id"), with_ids=True).collect()}
    at, want = 0, {}
    for i, ids, _ in sorted(library(rows)):
        want[i] = (at, [*ids, 0])
        at += len(ids) + 1
    assert got == want
    missing = spark.createDataFrame([(i,) for i in (10**15 + 2, -1, None)], "doc_id long")
    assert [r.start for r in read_tokens(store, missing).collect()] == []


def test_token_files_of_empty_and_repeated_rows(spark):
    spec = read_vocabulary(spark, PATH)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert read_tokens(write_tokens(empty, spec), empty.select("doc_id")).collect() == []
    rows = spark.createDataFrame([(5, "b"), (5, "a"), (5, "a"), (None, "n"), (6, "c")], "doc_id long, text string")
    got = read_tokens(write_tokens(rows, spec), spark.createDataFrame([(5,), (6,), (None,)], "doc_id long")).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.start, r.n_tokens) for r in got) == [(False, 5, 2, 2), (False, 5, 4, 2), (False, 5, 6, 2), (False, 6, 8, 2), (True, None, 0, 2)]
