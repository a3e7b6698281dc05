"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Queries and their SQL by name, filled by `register`.
QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """Column names that clash with none of `columns`, whatever their case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """The top-level column of that name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo `divisor`."""
    return F.crc32(key.cast("string").cast("binary")) % divisor


#: Rows that pass to Python at once where whole texts do; a batch, its copies in Python and its buffers in the JVM grow with it.
BATCH_ROWS = 2_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """From now on the session hands at most `rows` rows to Python at once; a lower setting of the caller stays."""
    now = int(spark.conf.get(_BATCH_SETTING))
    if now <= 0 or now > rows:
        spark.conf.set(_BATCH_SETTING, str(rows))


def tidy(make: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`make`, for mapInArrow, giving unused memory back at the end: a worker waits for its next task with all that it holds."""

    def run(batches):
        yield from make(batches)
        pa.default_memory_pool().release_unused()

    return run


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """A new folder that driver and executors all see: in spark.checkpoint.dir, if that is set.

    Where it is unset, a temporary folder serves a session whose executors run in the driver; a cluster is refused.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"{prefix}-")


class Stages:
    """Written tables that cut lineage; a lost executor rereads them and recomputes nothing before them."""

    def __init__(self, spark: SparkSession, prefix: str):
        self.spark, self.root, self.n = spark, shared_folder(spark, prefix), 0

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        if "://" not in path and not path.startswith("file:"):
            os.makedirs(path, exist_ok=True)
        return path


def with_fields(df: DataFrame, keep: Iterable[str], **fields: str) -> T.StructType:
    """Schema of the columns `keep` of `df` and of further fields, given as name=type."""
    kept = [f for f in df.schema.fields if f.name in set(keep)]
    return T.StructType(kept + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields.items()])


def slices(batch: pa.RecordBatch, column: int | str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of `batch` in pieces whose values of a string or list column hold about `limit` bytes or items."""
    values = batch.column(column)
    ends = np.cumsum(pc.fill_null((pc.binary_length if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else pc.list_value_length)(values), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + limit, side="right"))
        last = max(last, first + 1)
        yield batch.slice(first, last - first)
        first = last
