"""Readers for uploads, the signal registry and capture run packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas


def _empty_arrays(df: DataFrame) -> DataFrame:
    """Absent lists of an envelope are empty lists."""
    for name in ("records", "session_events", "diagnostics"):
        kind = df.schema[name].dataType.simpleString()
        df = df.withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))
    return df


def _read_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Objects of JSON files, each a single one or a list, and what could not be read: (file, content)."""
    raw = spark.read.schema(f"{schema}, _corrupt string").options(multiLine=True, columnNameOfCorruptRecord="_corrupt", recursiveFileLookup=True).json(path)
    raw = raw.withColumn("_file", F.col("_metadata.file_path"))
    # Spark refuses to scan for damaged records alone, so the condition (always true of them) reads a field of the file too
    read_too = F.concat_ws("", F.col(raw.columns[0]).cast("string")) >= ""
    damaged = raw.where(F.col("_corrupt").isNotNull() & read_too).select(F.col("_file").alias("file"), F.regexp_replace("_corrupt", r"^\s+|\s+$", "").alias("content"))
    return raw.where(F.col("_corrupt").isNull()).drop("_corrupt"), damaged


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Upload envelopes, one JSON object or list of objects per file (or a folder of them).

    ``arrival_id`` tells uploads apart; it is set at the scan, where it does not depend on
    any shuffle. Damaged files are left out; see :func:`read_batches_and_damage`.
    """
    return read_batches_and_damage(spark, path)[0]


def read_batches_and_damage(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Upload envelopes, and the files that hold none: (file, content)."""
    raw, damaged = _read_json(spark, path, schemas.BATCH)
    return _empty_arrays(raw.withColumn("arrival_id", _arrival_id()).drop("_file")), damaged


def _arrival_id():
    return F.concat(F.col("_metadata.file_path"), F.lit("#"), F.monotonically_increasing_id().cast("string"))


def stream_batches(spark: SparkSession, path: str, keep: bool = True) -> DataFrame:
    """The same as a stream of arriving JSON-lines files, with user and receipt columns.

    Single uploads get their ``arrival_id`` in the micro-batch (see ``streaming.ingest``).
    Without ``keep`` files are deleted once the micro-batch that read them is committed.
    """
    fields = f"{schemas.BATCH}, user_id string, received_at timestamp"
    raw = spark.readStream.schema(fields).option("cleanSource", "off" if keep else "delete").json(path)
    return _empty_arrays(raw.withColumn("source_file", F.col("_metadata.file_path")))


def parse_batches(df: DataFrame, text: str = "payload") -> DataFrame:
    """Envelopes from a JSON text column; other columns are kept.

    The parsed struct passes through a generator: later filters then read the parsed
    columns instead of having the parse copied into each of their conditions.
    """
    parsed = df.withColumn("_b", F.explode(F.array(F.from_json(F.col(text), schemas.BATCH))))
    return _empty_arrays(parsed.select(*[c for c in df.columns if c != text], "_b.*"))


def registry(spark: SparkSession) -> DataFrame:
    """The locked 0.2 signal registry as a dimension."""
    return spark.createDataFrame(
        C.SIGNAL_REGISTRY,
        "signal_key string, category string, value_type string, canonical_unit string, freshness_ttl_seconds bigint",
    )


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A registry file (one object with a ``signals`` list) as a dimension, and damaged files."""
    raw, damaged = _read_json(spark, path, schemas.REGISTRY_FILE)
    return raw.select("schema_version", F.explode("signals").alias("s")).select("schema_version", "s.*"), damaged


def kpi_catalog(spark: SparkSession) -> DataFrame:
    """The locked KPI catalog: family, key, unit, direction, formula, signals."""
    return spark.createDataFrame(
        C.KPI_CATALOG,
        "ranking_type string, kpi_key string, kpi_unit string, direction string, formula string, "
        "required_signals array<string>, optional_signals array<string>",
    )


def read_run_packs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Capture run packs as one row per command exchange, and damaged files."""
    packs, damaged = _read_json(spark, path, schemas.RUN_PACK)
    return explode_run_packs(packs), damaged


def explode_run_packs(packs: DataFrame) -> DataFrame:
    return (
        packs.withColumnRenamed("id", "pack_id")
        .select("pack_id", "session_id", "vehicle_uid", "user_id", F.posexplode("command_exchanges").alias("exchange_index", "x"))
        .select("pack_id", "session_id", "vehicle_uid", "user_id", "exchange_index", "x.*")
    )
