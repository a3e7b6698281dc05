"""Operator 10: near-duplicate documents by BagMinHash signatures, bands and verified multiset overlap.

A document is the multiset of its runs of five words; two documents are linked where the sum of the smaller counts is
at least 0.8 of the sum of the larger ones. Signatures are BagMinHash: each run of words owns Poisson processes over
the levels of its count, split into [0, 1), [1, 2), [2, 4), [4, 8), ..., so that a count of w costs log w processes;
of the topmost one only points at levels below w count. A point falls on one component of the signature at its time,
and a component keeps its earliest point. Two signatures agree in a component with exactly the weighted similarity.

Equal texts are one class from the start. Bands of the signatures deal the rest into buckets. In a bucket all
signatures are compared and joined where their agreement comes near the threshold, with a safe margin; what they join
are candidate groups, much finer than buckets. In a candidate group, pairs are verified on the whole texts from the
most alike down, a pair that verified links already join being left out. A bucket or group beyond a size is cut into
blocks, each pair of blocks being a task, so nothing unbounded meets in one task; tasks give forests, never all pairs.
Verified links, united by contraction, are the classes, each named by its smallest id.

Null texts are alone. Texts of fewer than five words, empty ones included, are linked with equal texts only. Rows with
one id count as one document. Repeated rows keep their number. An empty table gives an empty table. Extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlane.functions.sizes import broadcast_if_small
from voltlane.llm.common import Stages, col, register, slices, table, tidy
from voltlane.llm.components import connected_components
from voltlane.llm.embedding_dedup import forest
from voltlane.llm.words import chunks, mix, windows

SHINGLE, THRESHOLD = 5, 0.8
#: A pair at the threshold shares none of the bands with a chance of 7e-5.
BANDS, ROWS = 24, 5
PLACES = BANDS * ROWS
#: Pairs whose signatures agree in less are not verified; at the threshold that is four standard deviations down.
NEAR = 0.65
#: Documents, and words, of one block of a bucket or group.
BLOCK, BLOCK_WORDS = 1_000, 2_000_000
#: Bytes of text that are signed, or made multisets, at once; what is computed meanwhile takes some 40 times as much.
SIGN_BYTES = 500_000
#: Rows up to which the list of documents to verify is broadcast; a longer one is joined by shuffle.
SENT_ROWS = 200_000
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9)]


def bag(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, hash) with counts, by owner and hash."""
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    if not len(hashes):
        return hashes, owners, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])]))
    return hashes[first], owners[first], np.diff(np.append(first, len(hashes)))


def signatures(hashes: np.ndarray, owners: np.ndarray, counts: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """Earliest times, (n, places), of the multisets 0 to n - 1; infinite throughout for an empty one."""
    times = np.full(n * places, np.inf)
    weight = np.bincount(owners, weights=counts, minlength=n)
    # A process for each level interval that begins below the count: interval 0 is [0, 1), interval k is [2^(k-1), 2^k).
    item, interval = np.arange(len(hashes)), np.zeros(len(hashes), dtype=np.int64)
    level = 1
    more, k = np.flatnonzero(counts > 1), 1
    while len(more):
        item, interval = np.concatenate([item, more]), np.concatenate([interval, np.full(len(more), k)])
        level *= 2
        more, k = more[counts[more] > level], k + 1
    stream = mix(hashes[item] + interval.astype(np.uint64) * _C[0])
    low = np.where(interval > 0, 2.0 ** (interval - 1), 0.0)
    length = np.where(interval > 0, low, 1.0)
    owner, top = owners[item], counts[item].astype(np.float64)
    until = places / np.maximum(weight, 1) * (np.log(places) + 3)
    todo = weight > 0
    while todo.any():
        live = np.flatnonzero(todo[owner])
        now, step = np.zeros(len(live)), 0
        while len(live):
            draw = mix(stream[live] + np.uint64(step * int(_C[1]) % 2**64))
            now = now - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length[live]
            within = now <= until[owner[live]]
            live, now, draw = live[within], now[within], draw[within]
            place = (mix(draw + _C[2]) % np.uint64(places)).astype(np.int64)
            at = low[live] + length[live] * ((mix(draw + _C[3]) >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            counted = at < top[live]
            np.minimum.at(times, owner[live[counted]] * places + place[counted], now[counted])
            step += 1
        # All places filled before `until`: no later point can matter. Otherwise that document goes further.
        todo &= ~np.isfinite(times.reshape(n, places)).all(axis=1)
        until = until * 2
    return times.reshape(n, places)


def digests(times: np.ndarray) -> np.ndarray:
    """16 bits of every component, to tell points apart."""
    return (mix(times.view(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands of each row of digests."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _C[0], (len(signature), BANDS))
    for r in range(ROWS):
        keys = mix(keys ^ (parts[:, :, r] + np.uint64(1)) * _C[1])
    return keys


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal components of all rows of x with all rows of y, in steps of bounded memory."""
    out = np.empty((len(x), len(y)), dtype=np.float32)
    step = max(1, 16_000_000 // max(1, len(y) * x.shape[1]))
    for a in range(0, len(x), step):
        out[a : a + step] = (x[a : a + step, None, :] == y[None, :, :]).mean(axis=2)
    return out


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets, each as sorted hashes and counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return both / (a[1].sum() + b[1].sum() - both)


def groups(batches, keys: int) -> Iterator[pa.Table]:
    """Whole groups of rows with equal values in the first `keys` columns, from a partition sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        turn = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            turn[1:] |= c[1:] != c[:-1]
        turn[0] = bool(held) and any(held[-1].column(i)[-1] != batch.column(i)[0] for i in range(keys))
        cuts = [0, *np.flatnonzero(turn).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if turn[a] and held:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def candidate_pairs(signature: np.ndarray, side: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, agreement) of pairs of NEAR or more: all pairs of one block, or those between two blocks."""
    if within:
        score = agreement(signature, signature)
        i, j = np.nonzero(np.triu(score >= NEAR, 1))
        return i, j, score[i, j]
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    score = agreement(signature[x], signature[y])
    i, j = np.nonzero(score >= NEAR)
    return x[i], y[j], score[i, j]


def in_blocks(rows: DataFrame, group: str, blocks: str) -> DataFrame:
    """Each row in every pair of blocks of its group that has its own block: columns first, second and side."""
    own = F.pmod(F.xxhash64("id", F.lit(29)), col(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), col(blocks).cast("int") - 1))
    out = rows.withColumn("own", own).withColumn("other", other)
    return out.select(
        group, F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), (col("own") > col("other")).cast("int").alias("side"),
        *[c for c in rows.columns if c not in (group, blocks)],
    )


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, PLACES)


def sign(batches) -> Iterator[pa.RecordBatch]:
    """Rows (id, h, g, text) with the number of words and the signature in place of the text."""
    for batch in batches:
        for chunk in chunks(batch.column("text"), limit=SIGN_BYTES):
            found = bag(*windows(chunk.hashes, chunk.per_text, SHINGLE))
            times = signatures(*found, chunk.rows)
            filled = np.isfinite(times[:, 0])
            rows = batch.slice(chunk.first, chunk.rows)
            signature = [d.tobytes() if f else None for d, f in zip(digests(times), filled, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(chunk.per_text, pa.int64()), pa.array(signature, pa.binary())], names=["id", "h", "g", "words", "signature"])


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, stages: Stages | None = None) -> DataFrame:
    """(key, class_id, kept) of every row; class_id is the smallest key of the row's class, kept whether that is its own."""
    stages = stages or Stages(df.sparkSession, "minhash")
    docs = df.select(col(key).alias("id"), col(text).alias("text"))
    hashed = docs.select("id", F.when(col("text").isNotNull(), F.xxhash64("text")).alias("h"), F.when(col("text").isNotNull(), F.xxhash64(F.lit(7), "text")).alias("g"), "text")

    id_type = df.schema[key].dataType.simpleString()
    signed = stages(hashed.mapInArrow(tidy(sign), f"id {id_type}, h bigint, g bigint, words bigint, signature binary"), "signed")
    # Rows of one text, then rows of one id: the smallest id stands for them.
    classes = signed.where("h is not null").groupBy("h", "g").agg(F.min("id").alias("rep"))
    first = stages(signed.select("id", "h", "g", "words", "signature").join(classes, ["h", "g"]), "classes")
    reps = first.where("id = rep and signature is not null").select("id", "words", "signature")

    def bands(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2_000):
                rows = batch.slice(a, 2_000)
                keys = band_keys(matrix(rows.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), rows.column(0).take(pa.array(np.repeat(np.arange(rows.num_rows), BANDS)))], names=["bucket", "id"])

    banded = reps.select("id", "signature").mapInArrow(bands, f"bucket bigint, id {id_type}")
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(col("n") / BLOCK).alias("blocks"))
    members = banded.join(shared, "bucket").join(reps.select("id", "signature"), "id")

    def compare(batches):
        for group in groups(batches, 3):
            ids = group.column("id").to_numpy()
            within = group.column("first")[0] == group.column("second")[0]
            i, j, _ = candidate_pairs(matrix(group.column("signature")), group.column("side").to_numpy(), within)
            a, b = forest(ids[i], ids[j])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = in_blocks(members.select("bucket", "blocks", "id", "signature"), "bucket", "blocks")
    dealt = dealt.repartition("bucket", "first", "second").sortWithinPartitions("bucket", "first", "second")
    candidates = connected_components(dealt.mapInArrow(compare, f"a {id_type}, b {id_type}"), stages)
    candidates = stages(candidates.join(reps, col("node") == col("id")).select("id", "component", "words", "signature"), "candidates")
    sizes = candidates.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("words") / BLOCK_WORDS)).alias("blocks"))
    listed = candidates.join(sizes, "component").select("id", "component", "blocks", "signature")
    whole = docs.join(broadcast_if_small(listed, SENT_ROWS), "id").select("component", "blocks", "id", "signature", "text")

    def verify(batches):
        for group in groups((piece for batch in batches for piece in slices(batch, "text")), 3):
            ids = group.column("id").to_numpy()
            within = group.column("first")[0] == group.column("second")[0]
            i, j, score = candidate_pairs(matrix(group.column("signature")), group.column("side").to_numpy(), within)
            bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for chunk in chunks(group.column("text"), limit=SIGN_BYTES):
                hashes, owners, counts = bag(*windows(chunk.hashes, chunk.per_text, SHINGLE))
                cuts = np.searchsorted(owners, np.arange(chunk.rows + 1))
                bags.update({chunk.first + r: (hashes[cuts[r] : cuts[r + 1]], counts[cuts[r] : cuts[r + 1]]) for r in range(chunk.rows)})
            a, b = verified(i, j, score, bags, len(ids), threshold)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    dealt = in_blocks(whole, "component", "blocks").repartition("component", "first", "second").sortWithinPartitions("component", "first", "second")
    found = connected_components(dealt.mapInArrow(verify, f"a {id_type}, b {id_type}"), stages).withColumnsRenamed({"node": "rep", "component": "found"})
    # Rows of one id with several texts are one document: their classes are one.
    repeated = first.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("id")
    named = first.select("id", "rep").join(found, "rep", "left").select("id", F.coalesce("found", "rep").alias("class"))
    ties = named.join(repeated, "id").groupBy("id").agg(F.min("class").alias("low"), F.collect_set("class").alias("all"))
    ties = ties.select(F.explode("all").alias("a"), col("low").alias("b"))
    tied = connected_components(ties, stages).withColumnsRenamed({"node": "class", "component": "tied"})
    named = named.join(tied, "class", "left").select("id", F.coalesce("tied", "class").alias("class"))
    out = named.unionByName(signed.where("h is null").select("id", col("id").alias("class")))
    return out.select(col("id").alias(key), col("class").alias("class_id"), (col("id") == col("class")).alias("kept"))


def verified(i: np.ndarray, j: np.ndarray, score: np.ndarray, bags: dict, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a forest of true links among the candidate pairs; a pair is tried unless links found before join it."""
    label, out = np.arange(n), []
    order = np.argsort(-score, kind="stable")
    i, j = i[order], j[order]
    while len(i):
        for a, b in zip(i[:256].tolist(), j[:256].tolist(), strict=True):
            if label[a] != label[b] and overlap(bags[a], bags[b]) >= threshold:
                out.append((a, b))
                label[label == label[b]] = label[a]
        i, j = i[256:], j[256:]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return (np.array([a for a, _ in out], dtype=np.int64), np.array([b for _, b in out], dtype=np.int64))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, stages: Stages | None = None) -> DataFrame:
    """The rows of `df` that stand for their class: one row of each, with the columns of `df`."""
    stages = stages or Stages(df.sparkSession, "keep")
    judged = stages(near_duplicates(df, key, text, threshold, stages), "judged")
    gone = judged.where("not kept").select(col(key).alias("_gone")).distinct()
    often = judged.where("kept").groupBy(key).count().where("count > 1").select(col(key).alias("_often"))
    left = df.join(broadcast_if_small(gone, SENT_ROWS), col(key) == col("_gone"), "left_anti")
    many = broadcast_if_small(stages(often, "often"), SENT_ROWS)
    once = left.join(many, col(key) == col("_often"), "left_anti")
    return once.unionByName(left.join(many, col(key) == col("_often"), "left_semi").dropDuplicates([key]))


@register("op10_minhash_dedup")
def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
