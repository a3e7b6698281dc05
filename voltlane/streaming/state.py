"""Keyed state for streams: the first row told of a key, given back whenever the key is asked for.

State is kept by Spark's state store (RocksDB on the executors, checkpointed by the query), so a trigger costs what it
touches: its own keys, whatever has been stored before.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstTold(StatefulProcessor):
    """Keeps the earliest row of the first trigger that told of a key, for a limited time.

    ``announce``: emit that row when it is taken in (and keep only the fact that it was), else emit it when asked.
    """

    def __init__(self, announce: bool, keep_ms: int):
        self.announce, self.keep_ms = announce, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "value string", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        asked, first = False, None
        for r in rows:
            if r.value is None:
                asked = True
            elif first is None or (r.at, r.value) < first:
                first = (r.at, r.value)
        known = self.known.get()[0] if self.known.exists() else None
        if known is None and first is not None:
            known = first[1]
            self.known.update(("" if self.announce else known,))
            if self.announce:
                yield Row(kind=key[0], value=known)
        if asked and known is not None and not self.announce:
            yield Row(kind=key[0], value=known)

    def close(self) -> None:
        pass


class Windows(StatefulProcessor):
    """Keeps the earliest start and the latest stop told of a key, and emits both whenever it is told anything."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("window", "start bigint, stop bigint", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        start, stop = self.known.get() if self.known.exists() else (None, None)
        for r in rows:
            start = min((x for x in (start, r.start) if x is not None), default=None)
            stop = max((x for x in (stop, r.stop) if x is not None), default=None)
        self.known.update((start, stop))
        yield Row(vehicle_uid=key[0], session_id=key[1], start=start, stop=stop)

    def close(self) -> None:
        pass


def asks(rows: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Asks of every row for one key of each kind, ``keys`` naming its column; the rows are read once for all kinds."""
    none = lambda as_type: F.lit(None).cast(as_type)
    asked = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id")) for kind, key in keys.items()]))
    return rows.select(asked.alias("a")).select("a.kind", "a.id", none("bigint").alias("at"), none("string").alias("value"))


def tells(rows: DataFrame, kind: str, key: str, order: Column) -> DataFrame:
    """``rows`` in the form that the state keeps; of rows that arrive together the smallest ``order`` counts."""
    text = F.to_json(F.struct(*rows.columns), JSON)
    return rows.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), order.cast("bigint").alias("at"), text.alias("value"))


def first_told(rows: DataFrame, announce: bool = False, keep_days: float | None = None) -> DataFrame:
    """(kind, value) of asks and tells (see above), by key. State of a key ends ``keep_days`` after it was told, if given.

    State that is kept for ever is an ordinary aggregate of the stream: what a task holds of a key is combined before the
    shuffle, and no row passes through Python. Keys that are only told are given back too, unless ``announce`` is set. Only a
    lifetime needs the processor, and a call of it for each key. Run the stream in :func:`output_mode`.
    """
    if keep_days is not None:
        return rows.groupBy("kind", "id").transformWithState(
            FirstTold(announce, int(keep_days * 86_400_000)), "kind string, value string", "Append", "ProcessingTime"
        )
    # one instant a trigger, kept in the log of the query for its repetition; a key that is given back was met in this trigger
    rows = rows.withColumn("now", F.current_timestamp())
    told = F.when(F.col("value").isNotNull(), F.struct(F.col("now").alias("seen"), "at", "value"))
    known = rows.groupBy("kind", "id").agg(F.min(told).alias("first"), F.max("now").alias("now"))
    wanted = F.col("first.seen") == F.col("now") if announce else F.col("first").isNotNull()
    return known.where(wanted).select("kind", F.col("first.value").alias("value"))


def output_mode(keep_days: float | None) -> str:
    """Output mode of a stream with :func:`first_told` in it."""
    return "update" if keep_days is None else "append"


MARKS = ["vehicle_uid", "session_id", "start", "stop"]


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One mark a session and batch of rows, so that a session with very many events is not one task's work."""
    for batch in batches:
        marks = pa.Table.from_batches([batch]).group_by(MARKS[:2], use_threads=False).aggregate([("start", "min"), ("stop", "max")])
        yield from marks.select([*MARKS[:2], "start_min", "stop_max"]).rename_columns(MARKS).to_batches()


def windows_told(marks: DataFrame, keep_days: float | None = None) -> DataFrame:
    """The window so far of every session that ``marks`` (columns ``MARKS``, microseconds or null) tells of.

    State of a session ends ``keep_days`` after the last mark, if given.
    """
    keep = None if keep_days is None else int(keep_days * 86_400_000)
    schema = "vehicle_uid string, session_id string, start bigint, stop bigint"
    return marks.select(*MARKS).mapInArrow(_combined, schema).groupBy(*MARKS[:2]).transformWithState(
        Windows(keep), schema, "Append", "None" if keep is None else "ProcessingTime"
    )


def rows_of(found: DataFrame, kind: str, schema: str) -> DataFrame:
    """The rows of one kind as they were told."""
    return found.where(F.col("kind") == kind).select(F.from_json("value", schema, JSON).alias("v")).select("v.*")


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside use the state store that keyed state needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)
