"""Writes: accepted readings, KPI and ranking snapshots, raw archive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scalars import to_real
from .snapshots import Snapshots, Split


def check_kpi_rows(rows: DataFrame, family: str) -> DataFrame:
    """Rows of one family; a row of another family, a key outside the locked catalog or a negative count fails the job."""
    locked = [e[1] for e in C.KPI_CATALOG if e[0] == family]
    if not locked:
        raise ValueError(f"no KPI family is named {family}")
    foreign = F.concat(F.lit(f"row of another family among those of {family}: "), F.coalesce("ranking_type", F.lit("null")))
    unknown = F.concat(F.lit(f"the catalog of {family} has no key "), F.coalesce("kpi_key", F.lit("null")))
    negative = F.concat(F.lit("sample count below zero for key "), "kpi_key")
    checked = (
        F.when(~F.col("ranking_type").eqNullSafe(family), F.raise_error(foreign).cast("bigint"))
        .when(~F.coalesce(F.col("kpi_key").isin(locked), F.lit(False)), F.raise_error(unknown).cast("bigint"))
        .when(F.col("sample_count") < 0, F.raise_error(negative).cast("bigint"))
        .otherwise(F.col("sample_count"))
    )
    return rows.withColumn("sample_count", checked)


def replace_kpis(rows: DataFrame, family: str, store: Snapshots) -> int:
    """Replace all snapshots of one family, whatever timeframes the new rows cover; readers see the old or the new ones."""
    return store.publish({"kpis": {family: check_kpi_rows(rows, family)}})


def replace_rankings(rows: DataFrame, store: Snapshots, families: Sequence[str] = (), timeframes: Sequence[str] = ()) -> int:
    """Replace the parts of ``families`` x ``timeframes`` and those that occur in ``rows``; others stay.

    A family and timeframe without rows ends up empty, whatever it held.
    """
    return store.publish({"rankings": ranking_parts(rows, families, timeframes)})


def ranking_parts(rows: DataFrame, families: Sequence[str], timeframes: Sequence[str]) -> Split:
    return Split(rows, ("ranking_type", "timeframe"), [f"{family}-{timeframe}" for family in families for timeframe in timeframes])


def read_kpis(store: Snapshots, version: int | None = None) -> DataFrame | None:
    return store.read("kpis", version=version)


def read_rankings(store: Snapshots, version: int | None = None) -> DataFrame | None:
    return store.read("rankings", version=version)


def write_observations(rows: DataFrame, path: str, mode: str = "append", real_storage: bool = False) -> None:
    """Append accepted readings partitioned by day; the source is always OBD.

    Rows of a day are brought together before the write, a large day in several files, so
    the number of files follows the volume and not tasks x days.
    """
    out = rows.withColumn("source", F.lit("OBD")).withColumn("observed_date", F.to_date("observed_at"))
    if real_storage:
        out = out.withColumn("value_number", to_real(F.col("value_number"))).withColumn(
            "confidence", to_real(F.col("confidence"))
        )
    out.hint("rebalance", "observed_date").write.mode(mode).partitionBy("observed_date").parquet(path)


def write_raw_archive(batches: DataFrame, path: str, shards: int = 256) -> None:
    """Raw uploads by receipt day and a hash shard of the user, for long retention and replay."""
    (
        batches.withColumn("received_date", F.to_date("received_at"))
        .withColumn("user_shard", F.pmod(F.xxhash64("user_id"), F.lit(shards)).cast("int"))
        .hint("rebalance", "received_date", "user_shard")
        .write.mode("append")
        .partitionBy("received_date", "user_shard")
        .parquet(path)
    )
