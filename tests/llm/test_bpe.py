import hashlib
import os
import random

import pytest
from tokenizers import Tokenizer

from voltlane.llm.bpe import VOCABULARY, codec, decode_ids, digests, encode_texts, op6_bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reference():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(VOCABULARY)


def expected(reference, text):
    ids = reference.encode(text or "", add_special_tokens=False).ids
    text = reference.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_documents_match_the_library(spark, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op6_bpe(spark, SF).collect()}
    assert got == {i: expected(reference, t) for i, t in texts.items()}


def test_odd_and_long_texts(spark, reference):
    texts = [None, "", "  ", "a" * 200_000, "x <|endoftext|> y", "ab1 " * 40_000, "日本" * 50_000 + "。" + "x y" * 30_000, "a" * 200_000, "\n" * 70_000 + "<|endoftext|>" + "é" * 90_000]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, _key string")
    got = {r.doc_id: (r.n_tokens_, r.ids_sha256, r.decoded_sha256) for r in digests(df).collect()}
    assert got == {i: expected(reference, t) for i, t in enumerate(texts)}
    assert digests(df.limit(0)).count() == 0


def test_every_character_encodes_as_in_the_library(reference):
    own = codec(VOCABULARY)
    texts = ["a" + c + " 1" + c + c + " b" + c for c in map(chr, [*range(1, 0xD800, 7), *range(0xE000, 0x110000, 97)])]
    for text, encoding in zip(texts, reference.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert own.encode(text).tolist() == encoding.ids


def test_tree_joins_give_the_whole_encoding(reference):
    rng, own = random.Random(5), codec(VOCABULARY)
    for _ in range(1500):
        letters = rng.choice(["ab", "a", "thein", "éñab", "<>|#'s", "  \t", "123", "aA", "日本語"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 300)))
        if rng.random() < 0.3:
            text = text[:50] + "<|endoftext|>" + text[50:]
        if rng.random() < 0.5:
            text = text[:100] + " " + text[100:]
        parts = list(own.segments(text, rng.choice([3, 7, 20, 64])))
        assert "".join(p for _, p in parts) == text
        assert own.join_all([(f, own.encode(p).tolist()) for f, p in parts]) == reference.encode(text, add_special_tokens=False).ids


def test_ids_are_returned(spark):
    out, ids = encode_texts(spark.createDataFrame([("hello world",)], "text string"))
    assert out.first()[ids] == codec(VOCABULARY).encode("hello world").tolist()
    back, name = decode_ids(out.unionByName(spark.createDataFrame([("x", None)], f"text string, {ids} array<int>")))
    assert sorted((r.text, r[name]) for r in back.collect()) == [("hello world", "hello world"), ("x", "")]
