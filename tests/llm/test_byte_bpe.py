import base64
import hashlib

import public_tokenizers
import tiktoken
from hypothesis import example, given, settings
from hypothesis import strategies as st

from voltlane.llm import byte_bpe

with open(byte_bpe.RANKS, "rb") as _f:
    LIBRARY = tiktoken.Encoding(
        "library", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks={base64.b64decode(t): int(r) for t, r in map(bytes.split, _f)},
    )
# U+0558 became a letter after the library's version of Unicode; U+001C is white space to Python only.
PIECES = st.sampled_from(["a", "Z", "don't", "we'll", "'", "''", "'s", "é", "ß", "字", "語", "٣", "7", "½", " ", "  ", "\n", "\t", " ", "　", "\u001c", "՘", "!", "...", "🦉", "<|endoftext|>", "́", "\0"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=60).map("".join), st.integers(1, 12))
@example("a՘b" * 5, 1)
@example("   x", 1)
def test_parts_encode_as_the_library(text, size):
    got = byte_bpe.parts(text, size)
    assert "".join(got) == text
    c = byte_bpe.codec(byte_bpe.RANKS)
    ids = c.encode(text, size).tolist()
    assert ids == LIBRARY.encode_ordinary(text)
    assert c.decode(ids) == text.encode()


def test_long_runs():
    c = byte_bpe.codec(byte_bpe.RANKS)
    for text in ("x" * 200_000, " " * 100_000 + "y", "字" * 50_000 + "。" * 10, "ab 12" * 30_000, "'" * 70_000 + "s"):
        assert c.encode(text).tolist() == LIBRARY.encode_ordinary(text)
    # the library's pattern engine gives up on these
    for text in (" " * 2_000_000, "q" + "\n" * 2_000_000 + "z"):
        assert c.decode(c.encode(text).tolist()) == text.encode()


def _digest(text):
    ids = LIBRARY.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_digests_of_whole_texts(spark):
    texts = [None, "", "Hello  world", "Hello  world", "wort " * 500, "wort " * 500, "字" * 900, "a1b2!" * 300, "<|endoftext|>", "՘x" * 400]
    df = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, token_ids string, Decoded int")
    got = {r.doc_id: r for r in byte_bpe.digests(df, size=64).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == _digest(t)
        assert got[i].token_ids == "x" and got[i].Decoded == i


def test_encode_then_decode(spark):
    df = spark.createDataFrame([(1, "é字 x" * 50), (2, None)], "doc_id long, text string")
    encoded, ids, raw = byte_bpe.encode_and_decode(df, size=32)
    again, name = byte_bpe.decode_ids(encoded.drop(raw), ids)
    assert {r.doc_id: bytes(r[name]) for r in again.collect()} == {1: ("é字 x" * 50).encode(), 2: b""}
    nothing, name = byte_bpe.decode_ids(spark.createDataFrame([(1, None)], "k int, token_ids array<int>"))
    assert bytes(nothing.first()[name]) == b""


def test_empty_table(spark):
    assert byte_bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = byte_bpe.op12_byte_bpe(spark, sf).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == {k: _digest(t) for k, t in texts.items()}
    assert len(got) == len(texts)
