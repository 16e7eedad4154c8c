import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadic.llm import bpe, tokens

TEXTS = [None, "", " ", "   ", "a", "hello world", "it's  DONE\n\n  next\tline", "x" * 5000, "ACGT" * 3000 + " end", "naïve Ωmega 東京。 ok", "a​b c d", "\U0001f600\U0001f600 emoji", "trailing blanks   ", "\n \n x", "1234567890" * 40, "don't 'quote' \x1c y", "퟿<|endoftext|>"]


@pytest.fixture(scope="module")
def coder():
    with open(bpe.DEFAULT_RANKS, "rb") as f:
        return bpe.ByteBpe(f.read(), cache_words=50)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(bpe.DEFAULT_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_texts(coder, reference):
    assert [np.frombuffer(ids, np.int32).tolist() for _, ids in coder.encode_each(TEXTS)] == [reference.encode_ordinary(t or "") for t in TEXTS]


def test_random_texts(coder, reference):
    r = random.Random(4)
    alphabet = "aAzZ09  \n\t'.,-_é  Ω東\U0001f600\x1c\x85"
    for _ in range(300):
        t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 300)))
        assert coder.encode(t) == reference.encode_ordinary(t), repr(t)


def test_round_trip(coder, reference):
    for t in TEXTS:
        assert reference.decode(coder.encode(t)) == (t or "")


def test_all_widths_agree_with_the_heap(coder):
    r = random.Random(5)
    words = ["".join(r.choice("abcdeinrst") for _ in range(n)).encode() for n in range(1, 129)]
    assert coder._merge_rows(words) == [coder._merge_long(w) for w in words]


def test_columns(spark, reference):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)
    got = sorted((r.doc_id, r.ids) for r in tokens.encode(df, "doc_id", "text").collect())
    assert got == sorted((i, reference.encode_ordinary(t or "")) for i, t, _, _ in rows)
    counts = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, "doc_id", "text").collect()}
    assert counts == {i: len(reference.encode_ordinary(t or "")) for i, t, _, _ in rows}
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


def test_decoding_gives_texts_back(spark):
    texts = [t for t in TEXTS if t is None or "\ud800" not in t]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = tokens.encode(df, "doc_id", "text").withColumn("ids", F.when(F.col("doc_id") != 1, F.col("ids")))
    got = {r.doc_id: r.text for r in tokens.decode(ids, "doc_id", "ids").collect()}
    assert got == {i: None if i == 1 else t or "" for i, t in enumerate(texts)}
    assert tokens.decode(ids.limit(0), "doc_id", "ids").count() == 0
