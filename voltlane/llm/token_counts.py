"""Operator 9: token counts of documents in flat token files that have no index.

A token file holds the ids of document after document, each followed by the end-of-document id, as little-endian
integers. Files are cut into blocks of equal size; each task reads blocks and finds the separators of a block with one
vector comparison. A prefix scan over the blocks of a file then gives every block the number of separators before it
and the place of the last one, so documents that cross any number of blocks get their whole length.

Texts that are null or empty have no tokens and still end with a separator. An end-of-document string inside a text
is ordinary text, so the separator id stands for nothing else. Tokens behind the last separator of a file are reported
as a document that is not complete. Repeated rows are documents of their own; an empty table makes no files and no
rows. Extra columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltlane.llm.bpe import VOCABULARY, codec
from voltlane.llm.common import Stages, col, register, slices, table

END = "<|endoftext|>"
#: Tokens of a block.
BLOCK = 1 << 20
#: Blocks of one piece of the prefix scan.
SCAN = 1024


def _dtype(width: int) -> np.dtype:
    return np.dtype({2: "<u2", 4: "<u4"}[width])


def write_token_files(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, width: int = 2) -> DataFrame:
    """Writes a token file per partition of `df` and returns rows (file, ordinal, key) to be written at once.

    A repeated task writes another file; only files named in the rows of the attempt that Spark kept are ever read.
    """

    def write(batches):
        c = codec(vocabulary)
        end = c.special[END]
        if end >= 1 << (8 * width):
            raise ValueError("ids of the vocabulary do not fit the width of the file")
        task = TaskContext.get()
        target, root = fs.FileSystem.from_uri(folder)
        name = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        out, ordinal = None, 0
        for batch in (piece for whole in batches for piece in slices(whole, 1)):
            keys = batch.column(0)
            ids = []
            for t in batch.column(1).to_pylist():
                if t:
                    ids.append(c.encode_ordinary(t))
                ids.append(np.array([end], np.uint32))
            if out is None:
                target.create_dir(root, recursive=True)
                out = target.open_output_stream(name)
            if ids:
                out.write(np.concatenate(ids).astype(_dtype(width)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(keys), pa.string()), pa.array(np.arange(ordinal, ordinal + len(keys))), keys], names=["file", "ordinal", "key"],
            )
            ordinal += len(keys)
        if out is not None:
            out.close()

    kind = df.schema[key].dataType.simpleString()
    return df.select(col(key), col(text)).mapInArrow(write, f"file string, ordinal bigint, key {kind}")


def scan_token_files(files: DataFrame, folder: str, end_id: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Rows (file, ordinal, start, n_tokens, complete) of every document in the files named by the column `file`."""

    def sizes(batches):
        source, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([i.size // width for i in source.get_file_info(names)], pa.int64())], names=["file", "total"],
            )

    def separators(batches):
        source, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, total, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with source.open_input_file(name) as f:
                    ids = np.frombuffer(f.read_at(block * width, b * block * width), dtype=_dtype(width))
                found = np.flatnonzero(ids == end_id).astype(np.int64) + b * block
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([total], pa.int64()), pa.array([b], pa.int64()), pa.array([found.tolist()], pa.list_(pa.int64()))],
                    names=["file", "total", "block", "ends"],
                )

    last = F.floor((F.greatest(col("total"), F.lit(1)) - 1) / block)
    blocks = files.select("file").distinct().mapInArrow(sizes, "file string, total bigint")
    blocks = blocks.select("file", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block")).repartition("file", "block")
    found = blocks.mapInArrow(separators, "file string, total bigint, block bigint, ends array<bigint>")
    # Prefix scan: inside pieces of SCAN blocks, then over the pieces of a file.
    found = found.withColumns({"piece": F.floor(col("block") / SCAN), "n": F.size("ends"), "last": F.try_element_at("ends", F.lit(-1))})
    inside = Window.partitionBy("file", "piece").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumns({"n_in": F.coalesce(F.sum("n").over(inside), F.lit(0)), "last_in": F.max("last").over(inside)})
    over = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = found.groupBy("file", "piece").agg(F.sum("n").alias("pn"), F.max("last").alias("pl"))
    pieces = pieces.select("file", "piece", F.coalesce(F.sum("pn").over(over), F.lit(0)).alias("n_over"), F.max("pl").over(over).alias("last_over"))
    joined = found.join(pieces, ["file", "piece"]).select(
        "file", "total", "block", "ends", (col("n_in") + col("n_over")).alias("before"),
        F.coalesce("last_in", "last_over", F.lit(-1).cast("bigint")).alias("previous"),
    )
    ends = joined.select("file", "total", "ends", "before", "previous", F.posexplode("ends").alias("i", "end"))
    start = F.when(col("i") == 0, col("previous")).otherwise(F.get("ends", col("i") - 1)) + 1
    whole = ends.select("file", (col("before") + col("i")).alias("ordinal"), start.alias("start"), (col("end") - start).alias("n_tokens"), F.lit(True).alias("complete"))
    tail_start = F.coalesce(F.try_element_at("ends", F.lit(-1)), col("previous")) + 1
    tail = joined.where(((col("block") + 1) * block >= col("total")) & (tail_start < col("total"))).select(
        "file", (col("before") + F.size("ends")).alias("ordinal"), tail_start.alias("start"), (col("total") - tail_start).alias("n_tokens"), F.lit(False).alias("complete"),
    )
    return whole.unionByName(tail)


def document_token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, stages: Stages | None = None) -> DataFrame:
    """(key, n_tokens) of every row: token files are written, scanned, and documents told apart by their order in a file."""
    stages = stages or Stages(df.sparkSession, "tokens")
    folder = stages.folder("files")
    manifest = stages(write_token_files(df, folder, key, text, vocabulary), "manifest")
    found = scan_token_files(manifest, folder, codec(vocabulary).special[END])
    return manifest.join(found, ["file", "ordinal"]).select(col("key").alias(key), col("n_tokens"))


@register("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
