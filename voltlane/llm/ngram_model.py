"""Operator 8: scores of an interpolated modified Kneser-Ney bigram model, counted by Spark and mapped into memory.

Training makes two passes over the texts. The first counts words; their 64-bit hashes, sorted, are the vocabulary, and
the place of a word in it is its id. The second counts pairs of ids. Every task adds up what it has read before the
shuffle; pairs are dealt by ranges of the first id, those of a frequent first word by the second id, so no task gets
all pairs of one word. Vocabulary, pairs and numbers of followers lie as sorted arrays in a folder that all executors
share. Workers map these files into memory and look up whole chunks of text at once, so memory stays bounded whatever
the size of the model. Where the shared folder is not a mounted file system, a worker fetches a file when it first
needs it.

Words are runs of characters other than space and 0x09-0x0D, A-Z lower-cased; every text ends with one end token and
begins in a start context. The model interpolates pairs with continuation counts, and those with equal chances for all
known words and one unknown. Null texts count as empty: one end token. Rows without a training document get the
chances of an empty model. Repeated rows are counted each. Extra columns of the scored table pass through; results
take names that clash with none.
"""

from __future__ import annotations

import functools
import os
import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlane.llm.common import Stages, col, fresh, register, remainder, table, with_fields
from voltlane.llm.words import Chunk, chunks

#: Hash of the end token; words get it by chance only.
END = np.uint64(0xE0D0E0D0E0D0E0D1)
#: Bytes of training text for each part of the vocabulary and of the pairs; tokens that a task adds up at once.
PART_BYTES, HELD_TOKENS = 32_000_000, 3_000_000
CHUNK = 4_000_000


def save(folder: str, name: str, array: np.ndarray) -> None:
    """One array file; a repeated task replaces it by the same content."""
    target, root = fs.FileSystem.from_uri(folder)
    target.create_dir(root, recursive=True)
    part = f"{root}/{name}.{os.getpid()}.{os.urandom(4).hex()}"
    with target.open_output_stream(part) as out:
        np.save(out, array)
    target.move(part, f"{root}/{name}.npy")


@functools.lru_cache(maxsize=4096)
def load(folder: str, name: str) -> np.ndarray:
    source, root = fs.FileSystem.from_uri(folder)
    path = f"{root}/{name}.npy"
    if not isinstance(source, fs.LocalFileSystem):
        local = f"{tempfile.mkdtemp(prefix='model-')}/{name}.npy"
        fs.copy_files(path, local, source_filesystem=source, destination_filesystem=fs.LocalFileSystem())
        path = local
    found = np.load(path, mmap_mode="r")
    return found if len(found) else np.array(found)


class Model(NamedTuple):
    folder: str
    word_parts: int
    """Parts of the vocabulary, a power of two: the top bits of a hash."""
    bases: tuple[int, ...]
    """Number of words before each part, and of all."""
    tokens: int
    pair_parts: int
    hot: tuple[tuple[int, int, int, int], ...]
    """First words whose pairs lie in several parts, in order, with their followers seen once, twice, more often."""
    discounts: tuple[float, float, float]
    low_discounts: tuple[float, float, float]
    pair_types: int
    low_rest: float
    """What the continuation counts leave to the equal chances."""
    starts: int

    @property
    def words(self) -> int:
        return self.bases[-1]


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - parts.bit_length() + 1)).astype(np.int64) if parts > 1 else np.zeros(len(hashes), np.int64)


def with_ends(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a chunk, ends included, and where each text begins."""
    begins = np.concatenate([[0], np.cumsum(chunk.per_text + 1)])
    out = np.full(begins[-1], END, dtype=np.uint64)
    inside = np.ones(begins[-1], dtype=bool)
    inside[begins[1:] - 1] = False
    out[inside] = chunk.hashes
    return out, begins


def look_up(model_folder: str, parts: int, bases: tuple[int, ...], hashes: np.ndarray) -> np.ndarray:
    """Ids of sorted distinct hashes; -1: not in the vocabulary."""
    out = np.full(len(hashes), -1, dtype=np.int64)
    cuts = np.searchsorted(part_of(hashes, parts), np.arange(parts + 1))
    for p in range(parts):
        wanted = hashes[cuts[p] : cuts[p + 1]]
        have = load(model_folder, f"word-{p}")
        if len(wanted) and len(have):
            at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
            out[cuts[p] : cuts[p + 1]] = np.where(have[at] == wanted, at + bases[p], -1)
    return out


def gather(folder: str, name: str, bases: tuple[int, ...], ids: np.ndarray) -> np.ndarray:
    """Values of one word array for ascending ids."""
    out = np.zeros(len(ids), dtype=np.int64)
    cuts = np.searchsorted(ids, bases)
    for p in range(len(bases) - 1):
        if cuts[p] < cuts[p + 1]:
            out[cuts[p] : cuts[p + 1]] = load(folder, f"{name}-{p}")[ids[cuts[p] : cuts[p + 1]] - bases[p]]
    return out


def pair_part(first: np.ndarray, second: np.ndarray, words: int, parts: int, hot: np.ndarray) -> np.ndarray:
    """Part of a pair: the range of its first id, or of its second where the first is hot. The start context has the id `words`."""
    of_first = first * parts // (words + 1)
    return np.where(np.isin(first, hot), second * parts // (words + 1), of_first) if len(hot) else of_first


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def small(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(int(counts.max())) if len(counts) else np.uint8)


def packed(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p for p, _, _ in rows], pa.int32()), pa.array([k.tobytes() for _, k, _ in rows], pa.binary()),
         pa.array([c.tobytes() for _, _, c in rows], pa.binary()), pa.array([c.dtype.str for _, _, c in rows], pa.string())],
        names=["part", "keys", "counts", "kind"],
    )


PACKED = "part int, keys binary, counts binary, kind string"


def split(keys: np.ndarray, counts: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(parts, kind="stable")
    keys, counts, parts = keys[order], counts[order], parts[order]
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1), len(parts)]
    return packed([(int(parts[a]), keys[a:b], small(counts[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a])


def by_part(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, keys, counts as 64 bits) of all rows of a partition that is sorted by part."""
    now, keys, counts = None, [], []
    for batch in batches:
        for p, k, c, kind in zip(*[batch.column(i) for i in range(4)], strict=True):
            p = p.as_py()
            if p != now and keys:
                yield now, np.concatenate(keys), np.concatenate(counts)
                keys, counts = [], []
            now = p
            keys.append(np.frombuffer(k.as_buffer(), dtype=np.uint64))
            counts.append(np.frombuffer(c.as_buffer(), dtype=np.dtype(kind.as_py())).astype(np.uint64))
    if keys:
        yield now, np.concatenate(keys), np.concatenate(counts)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of types seen once to four times; a half where those are missing."""
    if not all(n[:2]):
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    raw = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 0.5)
    return tuple(min(max(d, 0.01), k + 1.0) for k, d in enumerate(raw))  # type: ignore[return-value]


def train(documents: DataFrame, text: str = "text", stages: Stages | None = None) -> Model:
    """A model of all rows of `documents`, its arrays in a new shared folder."""
    spark = documents.sparkSession
    stages = stages or Stages(spark, "ngrams")
    folder = stages.folder("arrays")
    texts = documents.select(col(text).alias("text"))
    about = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    size, starts = (about[0] or 0) + about[1], about[1]
    parts = 1 << max(3, (size // PART_BYTES).bit_length())
    pair_parts = max(8, -(-size // PART_BYTES))

    def count_words(batches):
        held, n = [], 0
        for batch in batches:
            for chunk in chunks(batch.column(0), lower=True, limit=CHUNK):
                held.append(with_ends(chunk)[0])
                n += len(held[-1])
                if n >= HELD_TOKENS:
                    keys, counts = np.unique(np.concatenate(held), return_counts=True)
                    yield split(keys, counts, part_of(keys, parts))
                    held, n = [], 0
        if held:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            yield split(keys, counts, part_of(keys, parts))

    def write_words(batches):
        for p, keys, counts in by_part(batches):
            keys, counts = summed(keys, counts)
            save(folder, f"word-{p}", keys)
            save(folder, f"count-{p}", small(counts))
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], names=["part", "words", "tokens"])

    dealt = texts.mapInArrow(count_words, PACKED).repartitionById(parts, col("part")).sortWithinPartitions("part")
    written = {r.part: r for r in stages(dealt.mapInArrow(write_words, "part int, words bigint, tokens bigint"), "words").collect()}  # a row for each part
    for p in set(range(parts)) - set(written):
        save(folder, f"word-{p}", np.zeros(0, np.uint64))
        save(folder, f"count-{p}", np.zeros(0, np.uint8))
    bases = (0, *np.cumsum([written[p].words if p in written else 0 for p in range(parts)]).tolist())
    words, tokens = bases[-1], sum(r.tokens for r in written.values())

    def find_hot(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                at = np.flatnonzero(load(folder, f"count-{p}")[:].astype(np.float64) > tokens / (2 * pair_parts)) + bases[p]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64())], names=["id"])

    each_part = spark.range(0, parts, 1, parts)
    # Fewer than 2 * pair_parts words can be so frequent.
    hot_ids = np.array(sorted([r.id for r in each_part.mapInArrow(find_hot, "id bigint").collect()] + [words]), dtype=np.int64)

    def count_pairs(batches):
        held, n = [], 0

        def out():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            return split(keys, counts, pair_part(first, second, words, pair_parts, hot_ids))

        for batch in batches:
            for chunk in chunks(batch.column(0), lower=True, limit=CHUNK):
                hashes, begins = with_ends(chunk)
                distinct, inverse = np.unique(hashes, return_inverse=True)
                ids = look_up(folder, parts, bases, distinct)[inverse]
                held.append(pair_keys(ids, begins, words))
                n += len(ids)
                if n >= HELD_TOKENS:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    def write_pairs(batches):
        for p, keys, counts in by_part(batches):
            keys, counts = summed(keys, counts)
            save(folder, f"pair-{p}", keys)
            save(folder, f"times-{p}", small(counts))
            first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
            # Followers of each first word seen once, twice, more often: dense over the words of this part, hot ones apart.
            is_hot = np.isin(first, hot_ids)
            low = -(-p * (words + 1) // pair_parts)
            width = -(-(p + 1) * (words + 1) // pair_parts) - low
            times = np.minimum(counts, 3).astype(np.int64)
            dense = [np.bincount(first[~is_hot & (times == k)] - low, minlength=width) for k in (1, 2, 3)]
            save(folder, f"followers-{p}", small(np.stack(dense, axis=1).ravel()))
            apart = [(int(h), *(int(((first == h) & (times == k)).sum()) for k in (1, 2, 3))) for h in np.unique(first[is_hot])]
            seconds, types = np.unique(second, return_counts=True)
            home = np.searchsorted(np.array(bases), seconds, side="right") - 1
            batch = split(seconds.astype(np.uint64), types, home)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array([0] * n, pa.int64()) for _ in range(6))], names=[*batch.schema.names, "pairs", "n1", "n2", "n3", "n4", "hot"],
            )
            rows = [(len(keys), *(int((counts == k).sum()) for k in (1, 2, 3, 4)), -1), *((0, a, b, c, 0, h) for h, a, b, c in apart)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1] * len(rows), pa.int32()), *(pa.array([b""] * len(rows), pa.binary()) for _ in range(2)), pa.array(["|u1"] * len(rows)),
                 *(pa.array(list(v), pa.int64()) for v in zip(*rows, strict=True))], names=[*batch.schema.names, "pairs", "n1", "n2", "n3", "n4", "hot"],
            )

    dealt = texts.mapInArrow(count_pairs, PACKED).repartitionById(pair_parts, col("part")).sortWithinPartitions("part")
    facts = stages(dealt.mapInArrow(write_pairs, f"{PACKED}, pairs bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint, hot bigint"), "pairs")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "n1", "n2", "n3", "n4")]
    total = facts.where("part < 0 and hot < 0").agg(*sums, F.count("*").alias("n")).first()
    hot = {r.hot: (r.n1, r.n2, r.n3) for r in facts.where("part < 0 and hot >= 0").groupBy("hot").agg(*sums[1:4]).collect()}

    def write_types(batches):
        for p, keys, counts in by_part(batches):
            dense = np.zeros(bases[p + 1] - bases[p], dtype=np.uint64)
            keys, counts = summed(keys, counts)
            dense[keys.astype(np.int64) - bases[p]] = counts
            save(folder, f"types-{p}", small(dense))
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([int((dense == k).sum())], pa.int64()) for k in (1, 2, 3, 4)), pa.array([int((dense > 2).sum())], pa.int64())], names=["part", "n1", "n2", "n3", "n4", "more"])

    dealt = facts.where("part >= 0").select("part", "keys", "counts", "kind").repartitionById(parts, col("part")).sortWithinPartitions("part")
    low = stages(dealt.mapInArrow(write_types, "part int, n1 bigint, n2 bigint, n3 bigint, n4 bigint, more bigint"), "types").collect()  # a row for each part
    d_low = discounts([sum(r[f"n{k}"] for r in low) for k in (1, 2, 3, 4)])
    rest = (d_low[0] * sum(r.n1 for r in low) + d_low[1] * sum(r.n2 for r in low) + d_low[2] * sum(r.more for r in low)) / total.pairs if total.pairs else 1.0
    for p in range(pair_parts):
        if total.n < pair_parts and not exists(folder, f"pair-{p}"):
            width = -(-(p + 1) * (words + 1) // pair_parts) + (p * (words + 1) // -pair_parts)
            save(folder, f"pair-{p}", np.zeros(0, np.uint64))
            save(folder, f"times-{p}", np.zeros(0, np.uint8))
            save(folder, f"followers-{p}", np.zeros(3 * width, np.uint8))
    return Model(
        folder, parts, bases, tokens, pair_parts, tuple((int(h), *hot.get(int(h), (0, 0, 0))) for h in hot_ids),
        discounts([total[f"n{k}"] for k in (1, 2, 3, 4)]), d_low, total.pairs, rest, starts,
    )


def exists(folder: str, name: str) -> bool:
    source, root = fs.FileSystem.from_uri(folder)
    return source.get_file_info(f"{root}/{name}.npy").type == fs.FileType.File


def pair_keys(ids: np.ndarray, begins: np.ndarray, start: int) -> np.ndarray:
    before = np.empty(len(ids), dtype=np.int64)
    before[1:] = ids[:-1]
    before[begins[:-1]] = start
    return (before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64)


def chances(model: Model, hashes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 chance of every token, and its count in training."""
    distinct, inverse = np.unique(hashes, return_inverse=True)
    word = look_up(model.folder, model.word_parts, model.bases, distinct)
    known = word >= 0
    counts, low = np.zeros(len(word), np.int64), np.full(len(word), model.low_rest / (model.words + 1))
    counts[known] = gather(model.folder, "count", model.bases, word[known])
    if model.pair_types:
        types = gather(model.folder, "types", model.bases, word[known])
        low[known] += np.maximum(types - np.array((0.0, *model.low_discounts))[np.minimum(types, 3)], 0) / model.pair_types
    # Each distinct word, and the start, as a context: its count and what its followers leave to the lower order.
    hot = {h: n for h, *n in model.hot}
    context_ids = np.append(word, model.words)
    total = np.append(counts, model.starts).astype(np.float64)
    share = np.ones(len(context_ids))
    ids, at = np.unique(context_ids[context_ids >= 0], return_inverse=True)
    followers = np.zeros((len(ids), 3))
    edges = [-(-p * (model.words + 1) // model.pair_parts) for p in range(model.pair_parts + 1)]
    cuts = np.searchsorted(ids, edges)
    for p in range(model.pair_parts):
        if cuts[p] < cuts[p + 1]:
            rows = ids[cuts[p] : cuts[p + 1]] - edges[p]
            stored = load(model.folder, f"followers-{p}")
            followers[cuts[p] : cuts[p + 1]] = stored[(3 * rows[:, None] + np.arange(3))]
    for i in np.flatnonzero(np.isin(ids, list(hot))):
        followers[i] = hot[int(ids[i])]
    seen = context_ids >= 0
    share[seen] = np.where(total[seen] > 0, (followers @ np.array(model.discounts))[at] / np.maximum(total[seen], 1), 1.0)

    before = np.empty(len(inverse), dtype=np.int64)
    before[1:] = inverse[:-1]
    before[begins[:-1]] = len(word)
    chance = share[before] * low[inverse]
    first, second = context_ids[before], word[inverse]
    both = np.flatnonzero((first >= 0) & (second >= 0))
    if len(both) and model.pair_types:
        first, second = first[both], second[both]
        keys = (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        part = pair_part(first, second, model.words, model.pair_parts, np.array(list(hot), dtype=np.int64))
        order = np.lexsort((keys, part))
        keys, part, both = keys[order], part[order], both[order]
        cuts = np.searchsorted(part, np.arange(model.pair_parts + 1))
        times = np.zeros(len(keys), dtype=np.int64)
        for p in range(model.pair_parts):
            a, b = cuts[p], cuts[p + 1]
            have = load(model.folder, f"pair-{p}")
            if a < b and len(have):
                place = np.minimum(np.searchsorted(have, keys[a:b]), len(have) - 1)
                times[a:b] = np.where(have[place] == keys[a:b], load(model.folder, f"times-{p}")[place], 0)
        gain = times - np.array((0.0, *model.discounts))[np.minimum(times, 3)]
        chance[both] += np.maximum(gain, 0) / np.maximum(total[before[both]], 1)
    return np.log10(np.maximum(chance, 1e-300)), counts[inverse]


def score(df: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """`df` with n_tokens, n_known, base_score and score of every whole text."""
    names = ("n_tokens", "n_known", "base_score", "score")
    result = dict(zip(names, fresh(df.columns, *names), strict=True))
    schema = with_fields(df, df.columns, **{result["n_tokens"]: "bigint", result["n_known"]: "bigint", result["base_score"]: "double", result["score"]: "double"})

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column(text), lower=True, limit=CHUNK):
                hashes, begins = with_ends(chunk)
                logs, counts = chances(model, hashes, begins)
                base = np.log10((counts + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
                sums = [np.add.reduceat(v, begins[:-1]) for v in ((counts > 0).astype(np.int64), base, logs)]
                rows = batch.slice(chunk.first, chunk.rows)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.diff(begins)), *map(pa.array, sums)], names=[*batch.schema.names, *result.values()])

    return df.mapInArrow(run, schema), result


@register("op8_ngram_model")
def op8_ngram_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(remainder(col("doc_id"), 5) != 1))
    scored, _ = score(docs, model)
    return scored.select(
        "doc_id", (remainder(col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
    )
