"""Latest snapshots, family scores and cohort rankings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scalars import cohort_key, family_confidence, family_score, temperature_score, to_real
from ..functions.sizes import shuffled
from .ordering import distributed_rank

KPI_KEY = ["vehicle_uid", "ranking_type", "timeframe", "temperature_bin", "kpi_key"]


def vehicle_catalog(vehicle: DataFrame) -> DataFrame:
    """Vehicles with "unknown" for missing labels, and their cohort key."""
    named = [F.coalesce(c, F.lit("unknown")).alias(c) for c in ("make", "model", "trim")]
    return vehicle.select(
        "vehicle_uid", *named, "model_year",
        cohort_key(F.col("make"), F.col("model"), F.col("trim"), F.col("model_year")).alias("cohort_key"),
    )


def latest_kpis(kpi: DataFrame, extra_keys=()) -> DataFrame:
    """Rows carrying the newest ``computed_at`` of their key; rows tied at that instant all stay.

    The newest instant is a partial aggregate joined back, so repeated snapshots of one
    key are never gathered in one task.
    """
    keys = [*KPI_KEY, *extra_keys]
    newest = kpi.groupBy(*keys).agg(F.max("computed_at").alias("computed_at"))
    if extra_keys:  # those columns may be null on both sides
        cond = [F.col(f"k.{c}").eqNullSafe(F.col(f"n.{c}")) for c in [*keys, "computed_at"]]
        return kpi.alias("k").join(newest.alias("n"), cond, "left_semi")
    return kpi.join(newest, [*keys, "computed_at"], "left_semi")


def score_vehicles(kpi: DataFrame, vehicle: DataFrame) -> DataFrame:
    """Score and weakest confidence per (vehicle, family, timeframe); temperature excluded.

    Vehicles are joined by shuffle: a written catalog compresses so well that Spark would broadcast millions of them.
    """
    rows = latest_kpis(kpi.where((F.col("ranking_type") != C.TEMPERATURE) & (F.col("temperature_bin") == "all")))
    keys = sorted({e[1] for e in C.KPI_CATALOG if e[0] != C.TEMPERATURE})
    wide = rows.groupBy("vehicle_uid", "ranking_type", "timeframe").agg(
        *[F.max(F.when(F.col("kpi_key") == k, F.col("kpi_value"))).alias(k) for k in keys],
        family_confidence(F.col("confidence_level")).alias("confidence_level"),
    )
    return wide.join(shuffled(vehicle_catalog(vehicle)), "vehicle_uid").select(
        "ranking_type", "timeframe", F.lit("all").alias("temperature_bin"), "cohort_key", "vehicle_uid",
        family_score(F.col("ranking_type"), F.col).alias("score"), "confidence_level",
    )


def temperature_seeds(vehicle: DataFrame, kpi: DataFrame) -> DataFrame:
    """Vehicles with both retentions (bin "cold"), their score and confidence per timeframe."""
    cold = kpi.where((F.col("ranking_type") == C.TEMPERATURE) & (F.col("temperature_bin") == "cold"))
    pick = lambda key: F.max(F.when(F.col("kpi_key") == key, F.col("kpi_value")))
    wide = cold.groupBy("vehicle_uid", "timeframe").agg(
        pick("cold_weather_range_retention").alias("range_retention"),
        pick("range_temperature_sensitivity_index").alias("sensitivity"),
        pick("cold_weather_charge_speed_retention").alias("charge_retention"),
    )
    return (
        vehicle_catalog(vehicle)
        .join(shuffled(wide), "vehicle_uid", "left")
        .where(F.col("range_retention").isNotNull() & F.col("charge_retention").isNotNull())
        .select(
            "vehicle_uid", "timeframe", "cohort_key", "range_retention", "sensitivity", "charge_retention",
            temperature_score(F.col("range_retention"), F.col("charge_retention"), F.col("sensitivity")).alias("score"),
            F.when(F.col("sensitivity").isNotNull(), "stable").otherwise("medium").alias("confidence_level"),
        )
    )


def rank_cohorts(scored: DataFrame, as_of: datetime, gate: int = C.COHORT_GATE, real_storage: bool = False) -> DataFrame:
    """Ranking rows: position by score within (family, timeframe, cohort), size and size gate."""
    ranked = distributed_rank(scored, ["ranking_type", "timeframe", "cohort_key"], "score", "vehicle_uid")
    return stamp_ranking(ranked, as_of, gate, real_storage)


def rank_temperature(seeds: DataFrame, as_of: datetime, gate: int = C.COHORT_GATE, real_storage: bool = False) -> DataFrame:
    """The same for the temperature family, written for the bins "all" and "cold"."""
    ranked = distributed_rank(
        seeds.withColumn("ranking_type", F.lit(C.TEMPERATURE)),
        ["ranking_type", "timeframe", "cohort_key"], "score", "vehicle_uid",
    ).withColumn("temperature_bin", F.explode(F.array(F.lit("all"), F.lit("cold"))))
    return stamp_ranking(ranked, as_of, gate, real_storage)


def stamp_ranking(ranked: DataFrame, as_of: datetime, gate: int, real_storage: bool) -> DataFrame:
    moment = as_of.isoformat(sep=" ")
    natural = F.concat_ws("|", "ranking_type", "timeframe", "temperature_bin", "cohort_key", "vehicle_uid", F.lit(moment))
    score = to_real(F.col("score")) if real_storage else F.col("score")
    return ranked.select(
        F.sha2(natural, 256).alias("ranking_snapshot_id"),
        "ranking_type", "timeframe", "temperature_bin", "cohort_key", F.col("cohort_size").cast("bigint").alias("cohort_size"),
        (F.col("cohort_size") >= gate).alias("sample_gate_passed"), "vehicle_uid", "rank_position",
        score.alias("score"), "confidence_level", F.lit(moment).cast("timestamp_ntz").alias("computed_at"),
    )
