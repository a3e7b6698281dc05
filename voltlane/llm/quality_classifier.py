"""Operator 5: quality classifier by nearest-neighbour voting in a latent semantic space.

A text is a vector of hashed terms: its words, the shapes of its words (runs of lower case, upper case, digits and
signs), words said twice in a row and how varied its words are. Terms are weighed by log frequency and inverse
document frequency and projected on the leading singular vectors of a labelled sample. The sample's vectors and labels
are broadcast; every text is compared with all of them by exact cosines, block by block, and the nearest neighbours
vote with a weight of similarity to a power, times what the share of their class among all labels asks for.

Learning reads at most `MOST_LABELLED` labelled texts of each class, those with the smallest hash of the id: a bounded,
documented sample, which also bounds the broadcast. Scoring reads every whole text. Null, empty and blank texts, and
texts with nothing in common with the sample, get the share of label 1 among the labels. Ties among neighbours go to
the earlier one in the sample's order, which is fixed. Without labels every score is 0.5; with one class it is that
label. Repeated rows get equal scores. Extra columns pass through; the score takes a name that clashes with none.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlane.llm.common import col, fresh, register, remainder, table, with_fields
from voltlane.llm.words import Chunk, chunks, mix, owner, word_hashes

MOST_LABELLED = 4_000
WORD_TERMS, SHAPE_TERMS, VARIETY_TERMS = 1_536, 480, 31
TERMS = WORD_TERMS + SHAPE_TERMS + VARIETY_TERMS + 1
TOPICS = 48
NEIGHBOURS, POWER = 15, 4
BLOCK_ROWS = 512

_CLASS = np.zeros(256, dtype=np.uint8)  # other bytes: parts of letters
_CLASS[33:127] = 3
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("a") : ord("z") + 1] = 0


def term_ids(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of every term of a chunk."""
    texts = owner(chunk.per_text)
    kinds = _CLASS[chunk.data]
    turn = np.ones(len(kinds), dtype=bool)
    turn[1:] = kinds[1:] != kinds[:-1]
    turn[chunk.start] = True
    places = np.flatnonzero(turn)
    shapes = word_hashes(kinds[places], np.searchsorted(places, chunk.start), np.searchsorted(places, chunk.end))
    again = np.flatnonzero((chunk.hashes[1:] == chunk.hashes[:-1]) & (texts[1:] == texts[:-1])) + 1
    # Different words of each text, from its words in the order of a hash.
    own = mix(chunk.hashes + texts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    different = np.bincount(texts[np.unique(own, return_index=True)[1]], minlength=chunk.rows)
    variety = WORD_TERMS + SHAPE_TERMS + (different * (VARIETY_TERMS - 1) // np.maximum(chunk.per_text, 1))
    return np.concatenate([texts, texts, texts[again], texts]), np.concatenate([
        (chunk.hashes % np.uint64(WORD_TERMS)).astype(np.int64), WORD_TERMS + (shapes % np.uint64(SHAPE_TERMS)).astype(np.int64),
        np.full(len(again), TERMS - 1, np.int64), variety[texts],
    ])


def weights(chunk: Chunk) -> Iterator[np.ndarray]:
    """Log frequencies of the terms, a dense block of at most BLOCK_ROWS texts at a time."""
    texts, terms = term_ids(chunk)
    order = np.argsort(texts, kind="stable")
    texts, terms = texts[order], terms[order]
    for a in range(0, chunk.rows, BLOCK_ROWS):
        rows = min(BLOCK_ROWS, chunk.rows - a)
        lo, hi = np.searchsorted(texts, [a, a + rows])
        counts = np.bincount((texts[lo:hi] - a) * TERMS + terms[lo:hi], minlength=rows * TERMS)
        yield np.log1p(counts.astype(np.float32)).reshape(rows, TERMS)


class Classifier(NamedTuple):
    share: float
    """Share of label 1 among all labels."""
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    class_weight: np.ndarray

    def score(self, block: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(block), self.share)
        latent = block @ self.projection
        norms = np.linalg.norm(latent, axis=1)
        latent /= np.maximum(norms, 1e-12)[:, None]
        cosines = latent @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        order = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        near = np.maximum(np.take_along_axis(cosines, order, axis=1), 0).astype(np.float64) ** POWER * self.class_weight[self.labels[order]]
        total = near.sum(axis=1)
        votes = (near * self.labels[order]).sum(axis=1)
        return np.where((norms > 1e-9) & (total > 0), votes / np.maximum(total, 1e-300), self.share)


def sample_weights(documents: DataFrame, labels: DataFrame, label: str, key: str, text: str) -> DataFrame:
    """(k, y, terms, values) of the labelled sample; the bounded list of labels is broadcast, texts stay where they are read."""
    known = labels.where(col(label).isin(0, 1)).select(col(key).alias("k"), col(label).cast("int").alias("y"))
    order = [F.xxhash64("k", F.lit(3)), col("k")]
    few = known.where("y = 1").orderBy(*order).limit(MOST_LABELLED).unionByName(known.where("y = 0").orderBy(*order).limit(MOST_LABELLED))
    chosen = documents.select(col(key).alias("k"), col(text).alias("text")).join(F.broadcast(few), "k").select("k", "y", "text")

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                at = chunk.first
                for block in weights(chunk):
                    found = [np.flatnonzero(row) for row in block]
                    rows = batch.slice(at, len(block))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("k").cast(pa.string()), rows.column("y"), pa.array([f.astype(np.int16).tobytes() for f in found], pa.binary()),
                         pa.array([row[f].tobytes() for row, f in zip(block, found, strict=True)], pa.binary())], names=["k", "y", "terms", "values"],
                    )
                    at += len(block)

    return chosen.mapInArrow(run, "k string, y int, terms binary, values binary")


def learn(documents: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> Classifier:
    share = labels.where(col(label).isin(0, 1)).agg(F.avg(label)).first()[0]
    empty = np.zeros((0, TOPICS), np.float32)
    nothing = Classifier(0.5 if share is None else float(share), np.zeros((TERMS, TOPICS), np.float32), empty, np.zeros(0, np.int64), np.ones(2))
    rows = sorted(sample_weights(documents, labels, label, key, text).collect(), key=lambda r: (r.k, bytes(r.terms), bytes(r.values)))  # at most 2 * MOST_LABELLED
    if not rows or share in (0.0, 1.0):
        return nothing
    x = np.zeros((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.terms, np.int16)] = np.frombuffer(r.values, np.float32)
    y = np.array([r.y for r in rows])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 0.1
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-9)[:, None]
    _, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    projection = axes[:, ::-1][:, :TOPICS].astype(np.float32)
    latent = x @ projection
    latent /= np.maximum(np.linalg.norm(latent, axis=1), 1e-9)[:, None]
    counts = np.bincount(y, minlength=2)
    return Classifier(float(share), idf[:, None] * projection, latent, y, np.array([1 - share, share]) / np.maximum(counts / len(y), 1e-9))


def classify(df: DataFrame, classifier: Classifier, text: str = "text") -> tuple[DataFrame, str]:
    """`df` with the score of every whole text, and that column's name."""
    (name,) = fresh(df.columns, "score")
    sent = df.sparkSession.sparkContext.broadcast(classifier)  # bounded by MOST_LABELLED, TERMS and TOPICS

    def run(batches):
        for batch in batches:
            for chunk in chunks(batch.column(text)):
                scores = np.concatenate([sent.value.score(block) for block in weights(chunk)])
                rows = batch.slice(chunk.first, chunk.rows)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(scores.astype(np.float64))], names=[*batch.schema.names, name])

    return df.mapInArrow(run, with_fields(df, df.columns, **{name: "double"})), name


@register("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = table(spark, sf_dir, "labels").where(remainder(col("doc_id"), 5) != 0)
    scored, name = classify(docs, learn(docs, known))
    return scored.select("doc_id", (remainder(col("doc_id"), 5) == 0).alias("held_out"), name, F.when(col(name) >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))
