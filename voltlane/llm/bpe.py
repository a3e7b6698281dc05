"""Operator 6: BPE encoding and decoding of whole texts, with long unsplit text joined as a tree.

Short texts are encoded where they lie. A long text is cut into segments that are encoded as rows of their own, on any
executor. Cuts fall on borders of the vocabulary's pre-tokens, where encodings simply follow each other. Only a
pre-token that is itself longer than a segment has no such border: it is halved until the halves are short, the halves
are encoded in parallel, and neighbours are joined up the tree. At a join a window of tokens from both sides is
encoded again and grows until its first and last tokens are those of the two sides. Rank-ordered BPE gives a sequence
exactly if it gives every pair of neighbours in it, so the joined sequence is then the encoding of the whole.

Null counts as empty text and gives no tokens; ids that are null decode to the empty text. Special tokens in a text
become their id, as the tokenizers library does by default. Repeated rows are encoded each (long texts: once for all
copies, then joined back by content). Extra columns pass through; result columns take names that clash with none.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from voltlane.llm.common import col, fresh, register, slices, table, tidy, with_fields

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Characters of a segment; longer texts are cut.
SEGMENT = 65_536
_SPLITTER = ByteLevel(add_prefix_space=False)


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library (byte-level BPE, ids in merge order)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for i, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            if ranks.get(bytes(letters[c] for c in a + b)) != 256 + i:
                raise ValueError(f"{path}: ids do not follow the order of the merges")
        special_bytes = {s.encode(): i for s, i in self.special.items()}
        ranks = {token: i for token, i in ranks.items() if token not in special_bytes}
        self._encoding = tiktoken.Encoding("byte_level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.tokens: list[bytes] = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for token, i in (ranks | special_bytes).items():
            self.tokens[i] = token
        self._split = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None

    def encode(self, text: str) -> np.ndarray:
        return self._encoding.encode_to_numpy(text, allowed_special="all")

    def encode_ordinary(self, text: str) -> np.ndarray:
        """Special tokens in the text count as ordinary text."""
        return self._encoding.encode_to_numpy(text, disallowed_special=())

    def encode_piece(self, piece: bytes) -> list[int]:
        return self._encoding._encode_single_piece(piece)

    def decode(self, ids: list[int]) -> str:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids]).decode("utf-8", "replace")

    def segments(self, text: str, size: int) -> Iterator[tuple[bool, str]]:
        """Parts of a text and whether each continues the pre-token of the part before."""
        for part in self._split.split(text) if self._split else [text]:
            if part in self.special:
                yield False, part
                continue
            at = 0
            while len(part) - at > size:
                cut = _space_cut(part, at, size) or _border(part, at, size)
                if cut - at <= size:
                    yield False, part[at:cut]
                else:
                    for i, half in enumerate(_halves(part[at:cut], size)):
                        yield i > 0, half
                at = cut
            if at < len(part):
                yield False, part[at:]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of a pre-token from the encodings of its two halves."""
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            window = self.encode_piece(b"".join(self.tokens[i] for i in a + b))
            if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
                return left[: -len(a)] + window + right[len(b) :]
            k *= 2

    def join_all(self, parts: list[tuple[bool, list[int]]]) -> list[int]:
        """Encoding of a text from those of its segments in order; runs of continued segments are joined as a tree."""
        out: list[int] = []
        run: list[list[int]] = []
        for continued, ids in [*parts, (False, [])]:
            if not continued:
                while len(run) > 1:
                    run = [self.join(*run[i : i + 2]) if i + 1 < len(run) else run[i] for i in range(0, len(run), 2)]
                out += run[0] if run else []
                run = []
            run.append(ids)
        return out


def _space_cut(text: str, at: int, size: int) -> int:
    """Last place in reach where a space follows another character than white space: no pre-token crosses it. 0: none."""
    end = at + size + 1
    while (p := text.rfind(" ", at + 1, end)) > 0:
        if not text[p - 1].isspace():
            return p
        end = p
    return 0


def _border(text: str, at: int, size: int) -> int:
    """Last border of a pre-token in reach, or the end of the first pre-token where that lies beyond.

    Borders come from the library's own splitter; those within two characters of the end of what it saw may move.
    """
    reach = 2 * size + 2
    while True:
        seen = text[at : at + reach]
        ends = [end for _, (_, end) in _SPLITTER.pre_tokenize_str(seen)]
        if len(seen) < reach:
            settled = ends
        else:
            settled = [e for e in ends if e <= reach - 2]
        if settled and (settled[0] > size or settled[-1] > size or len(seen) < reach):
            near = [e for e in settled if e <= size]
            return at + (near[-1] if near else settled[0])
        reach *= 2


def _halves(piece: str, size: int) -> list[str]:
    if len(piece) <= size:
        return [piece]
    middle = len(piece) // 2
    return _halves(piece[:middle], size) + _halves(piece[middle:], size)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def id_lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays).astype(np.int32) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_and_decode(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, segment: int = SEGMENT) -> tuple[DataFrame, str, str]:
    """`df` with the token ids of every whole text as an array column, the text decoded from them, and those columns' names.

    Ids are decoded where they are made, so they pass to Python and back once only.
    """
    ids, decoded, key, part, continued = fresh(df.columns, "token_ids", "decoded", "_key", "_part", "_continued")
    schema = with_fields(df, df.columns, **{ids: "array<int>", decoded: "string"})

    def short(batches):
        c = codec(vocabulary)
        for batch in (piece for whole in batches for piece in slices(whole, text)):
            encoded = [c.encode(t) if t else np.zeros(0, np.uint32) for t in batch.column(text).to_pylist()]
            texts = pa.array([c.decode(i.tolist()) for i in encoded], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, id_lists(encoded), texts], names=[*batch.schema.names, ids, decoded])

    def cut(batches):
        c = codec(vocabulary)
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                flags, parts = zip(*c.segments(t, segment), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array(flags), pa.array(parts)],
                    names=[key, part, continued, text],
                )

    def leaf(batches):
        c = codec(vocabulary)
        for batch in (piece for whole in batches for piece in slices(whole, 3)):
            encoded = [c.encode(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], id_lists(encoded)], names=[key, part, continued, ids])

    def tree(pdf):
        import pandas as pd

        pdf = pdf.sort_values(part)
        c = codec(vocabulary)
        joined = c.join_all([(f, list(map(int, i))) for f, i in zip(pdf[continued], pdf[ids], strict=True)])
        return pd.DataFrame({key: [pdf[key].iloc[0]], ids: [joined], decoded: [c.decode(joined)]})

    long_text = F.coalesce(F.length(col(text)) > segment, F.lit(False))
    rows = df.where(long_text).withColumn(key, F.sha2(col(text), 256))
    leaves = (
        rows.select(key, col(text)).dropDuplicates([key])
        .mapInArrow(cut, f"{key} string, {part} int, {continued} boolean, `{text}` string")
        .repartition(F.col(key), F.col(part))
        .mapInArrow(leaf, f"{key} string, {part} int, {continued} boolean, {ids} array<int>")
    )
    whole = leaves.groupBy(key).applyInPandas(tree, f"{key} string, {ids} array<int>, {decoded} string")
    names = [col(c) for c in df.columns]
    joined = rows.join(whole, key).select(*names, col(ids), col(decoded))
    return df.where(~long_text).mapInArrow(tidy(short), schema).unionByName(joined), ids, decoded


def encode_texts(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, segment: int = SEGMENT) -> tuple[DataFrame, str]:
    """`df` with the token ids of every whole text as an array column, and that column's name."""
    out, ids, decoded = encode_and_decode(df, text, vocabulary, segment)
    return out.drop(decoded), ids


def decode_ids(df: DataFrame, ids: str = "token_ids", vocabulary: str = VOCABULARY) -> tuple[DataFrame, str]:
    """`df` with the decoded text of every id list, and that column's name. The id column goes."""
    (decoded,) = fresh(df.columns, "decoded")
    keep = [c for c in df.columns if c != ids]
    schema = with_fields(df, keep, **{decoded: "string"})

    def decode(batches):
        c = codec(vocabulary)
        for batch in (piece for whole in batches for piece in slices(whole, ids, 1_000_000)):
            texts = [c.decode(i.values.tolist()) if i.is_valid else "" for i in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(texts, pa.string())], names=[*keep, decoded])

    return df.mapInArrow(decode, schema), decoded


def digests(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded text for every row; the text goes."""
    out, ids, decoded = encode_and_decode(df, text, vocabulary)
    keep = [c for c in df.columns if c != text]
    n, a, b = fresh(keep, "n_tokens", "ids_sha256", "decoded_sha256")
    return out.select(
        *[col(c) for c in keep], F.size(col(ids)).cast("bigint").alias(n),
        F.sha2(F.array_join(col(ids).cast("array<string>"), ","), 256).alias(a), F.sha2(col(decoded), 256).alias(b),
    )


@register("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
