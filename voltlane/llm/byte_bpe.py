"""Operator 12: byte-level BPE encoding by a local rank file with the tiktoken library, and decoding to raw bytes.

The library splits a text by a pattern and merges the bytes of every match by rank. Short texts are encoded as they
are. A long text is cut at safe boundaries first, the parts are encoded as rows of their own on any executor, and
their ids are put together in order. A boundary is safe if every text around it has a match that ends there, so the
parts' ids simply follow each other:

* another character than white space before white space (matches hold white space at their start only, or nothing else),
* a letter, number or other character before one of another kind (matches hold one kind), but for an apostrophe
  before a letter or number, which may begin a contraction,
* the last of several white-space characters that stand before another character (it belongs to what follows).

What counts as letter, number and white space is asked of the library's own pattern engine, as other engines know
another version of Unicode. A part of white space alone is one match, and is merged without the pattern, on which the
engine gives up at about a million characters. Parts without a safe boundary inside stay whole, at any length.

Null counts as empty text and gives no ids. Ids that are null decode to no bytes. Strings of special tokens are
ordinary text. Repeated rows are encoded each (long texts once for all copies, joined back by content). Extra columns
pass through; result columns take names that clash with none.
"""

from __future__ import annotations

import base64
import functools
import itertools

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlane.llm.common import col, fresh, register, slices, table, with_fields

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Characters of a part; longer texts are cut.
PART = 32_768
_ONE_BYTE = {bytes([b]): b for b in range(256)}


def _members(kind: str) -> str:
    """Every character that the library's engine takes for `kind`, as the inside of a character class."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    finder = tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks=_ONE_BYTE, special_tokens={})
    codes = np.frombuffer(bytes(finder.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    first = np.flatnonzero(np.diff(codes, prepend=-2) != 1)
    last = np.append(first[1:], len(codes)) - 1
    return "".join(f"\\U{codes[a]:08x}-\\U{codes[b]:08x}" for a, b in zip(first, last, strict=True))


@functools.lru_cache(maxsize=1)
def _boundaries() -> tuple[regex.Pattern, regex.Pattern]:
    """Finds safe boundaries: the first from a place on, and the last before one."""
    letter, number, white = map(_members, (r"\p{L}", r"\p{N}", r"\s"))
    safe = "|".join((
        f"(?<=[^{white}])(?=[{white}])",
        f"(?<=[{white}])(?=[{white}][^{white}])",
        f"(?<=[{letter}])(?=[^{letter}{white}])",
        f"(?<=[{number}])(?=[^{number}{white}])",
        f"(?<=[^{letter}{number}{white}'])(?=[{letter}{number}])",
    ))
    return regex.compile(safe), regex.compile("(?r)" + safe)


def parts(text: str, size: int) -> list[str]:
    """`text` cut at safe boundaries into parts of at most `size` characters where boundaries allow."""
    forward, backward = _boundaries()
    out, at = [], 0
    while len(text) - at > size:
        cut = backward.search(text, at + 1, at + size + 2)
        if cut is None or not at < cut.start() <= at + size:
            cut = forward.search(text, at + 1)
            if cut is None:
                break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._tokens = {rank: token for token, rank in ranks.items()}

    def encode_part(self, part: str) -> np.ndarray:
        """Ids of a text, or of a part between safe boundaries."""
        if len(part) > 1 and part.isspace() and not regex.search(r"\S", part):
            return np.array(self._encoding._encode_single_piece(part.encode()), np.int32)
        return np.array(self._encoding.encode_ordinary(part), np.int32)

    def encode(self, text: str, size: int = PART) -> np.ndarray:
        return np.concatenate([self.encode_part(p) for p in parts(text, size)])

    def decode(self, ids: list[int]) -> bytes:
        tokens = self._tokens
        return b"".join([tokens[i] for i in ids])


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.fromiter(itertools.accumulate(map(len, arrays), initial=0), np.int32, len(arrays) + 1)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *arrays]))


def encode_and_decode(df: DataFrame, text: str = "text", ranks: str = RANKS, size: int = PART) -> tuple[DataFrame, str, str]:
    """`df` with the ids of every whole text, the bytes decoded from them, and the names of those two columns."""
    ids, raw, key, part = fresh(df.columns, "token_ids", "decoded", "_key", "_part")

    def encoded(batches, column: str, kept: list[str]):
        c = codec(ranks)
        for batch in (piece for whole in batches for piece in slices(whole, column)):
            found = [c.encode_part(t) if t else np.zeros(0, np.int32) for t in batch.column(column).to_pylist()]
            decoded = pa.array([c.decode(i.tolist()) for i in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), _lists(found), decoded], names=[*kept, ids, raw])

    def cut(batches):
        for batch in batches:
            for k, t in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                for i, p in enumerate(parts(t, size)):
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([i], pa.int32()), pa.array([p])], names=[key, part, text])

    is_long = F.coalesce(F.length(col(text)) > size, F.lit(False))
    kept = df.columns
    short = df.where(~is_long).mapInArrow(lambda b: encoded(b, text, kept), with_fields(df, kept, **{ids: "array<int>", raw: "binary"}))

    rows = df.where(is_long).withColumn(key, F.sha2(col(text), 256))
    in_parts = rows.select(key, col(text)).dropDuplicates([key]).mapInArrow(cut, f"{key} string, {part} int, `{text}` string")
    done = in_parts.repartition(key, part).mapInArrow(lambda b: encoded(b, text, [key, part]), f"{key} string, {part} int, {ids} array<int>, {raw} binary")
    in_order = F.sort_array(F.collect_list(F.struct(part, ids, raw)))
    whole = done.groupBy(key).agg(in_order.alias(part)).select(
        key, F.flatten(F.col(part)[ids]).alias(ids), F.aggregate(F.col(part)[raw], F.lit(b""), lambda a, b: F.concat(a, b)).alias(raw)
    )
    joined = rows.join(whole, key).select(*[col(c) for c in kept], ids, raw)
    return short.unionByName(joined), ids, raw


def decode_ids(df: DataFrame, ids: str = "token_ids", ranks: str = RANKS) -> tuple[DataFrame, str]:
    """`df` with the raw bytes of every list of ids, and that column's name. The ids go."""
    (raw,) = fresh(df.columns, "decoded")
    kept = [c for c in df.columns if c != ids]

    def decode(batches):
        c = codec(ranks)
        for batch in (piece for whole in batches for piece in slices(whole, ids, 1_000_000)):
            decoded = [c.decode(i.values.tolist()) if i.is_valid else b"" for i in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(decoded, pa.binary())], names=[*kept, raw])

    return df.mapInArrow(decode, with_fields(df, kept, **{raw: "binary"})), raw


def digests(df: DataFrame, text: str = "text", ranks: str = RANKS, size: int = PART) -> DataFrame:
    """Number of tokens, digest of the ids and digest of the decoded bytes of every row; the text goes."""
    out, ids, raw = encode_and_decode(df, text, ranks, size)
    kept = [c for c in df.columns if c != text]
    n, a, b = fresh(kept, "n_tokens", "ids_sha256", "decoded_sha256")
    joined = F.array_join(col(ids).cast("array<string>"), ",")
    return out.select(*[col(c) for c in kept], F.size(ids).cast("bigint").alias(n), F.sha2(joined, 256).alias(a), F.sha2(col(raw), 256).alias(b))


@register("op12_byte_bpe")
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
