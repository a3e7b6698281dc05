"""Data-quality counts over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def _outside(c: str, allowed) -> Column:
    return F.col(c).isNotNull() & ~F.col(c).isin(list(allowed))


def _below(c: str, least) -> Column:
    return F.col(c) < least


def observation_rules() -> dict[str, Column]:
    return {
        "observation_source": ~F.col("source").isin("OBD", "SMARTCAR"),
        "observation_status": ~F.col("status").isin(list(C.STATUSES)),
        "observation_confidence": ~F.col("confidence").between(0.0, 1.0),
        "observation_freshness": _below("freshness_ttl_seconds", 0),
        "observation_temperature_bin": _outside("temperature_bin", C.TEMPERATURE_BINS),
    }


def session_rules() -> dict[str, Column]:
    return {
        "session_status": ~F.col("status").isin("partial", "complete", "invalid"),
        "session_charger_type": ~F.col("charger_type").isin("ac", "dc", "unknown"),
        "session_soc_start": ~F.col("soc_start_pct").between(0.0, 100.0),
        "session_soc_end": ~F.col("soc_end_pct").between(0.0, 100.0),
        "session_temperature_bin": _outside("temperature_bin", C.TEMPERATURE_BINS),
        "session_sample_count": _below("sample_count", 0),
        "session_end_before_start": F.col("ended_at") < F.col("started_at"),
    }


def kpi_rules() -> dict[str, Column]:
    bins = ("all", *C.TEMPERATURE_BINS)
    base, comp = F.col("baseline_temperature_bin"), F.col("compare_temperature_bin")
    return {
        "kpi_ranking_type": ~F.col("ranking_type").isin(list(C.FAMILIES)),
        "kpi_timeframe": ~F.col("timeframe").isin(list(C.TIMEFRAME_DAYS)),
        "kpi_direction": ~F.col("direction").isin(list(C.DIRECTIONS)),
        "kpi_confidence": ~F.col("confidence_level").isin(list(C.CONFIDENCE_LEVELS)),
        "kpi_sample_count": _below("sample_count", 0),
        "kpi_temperature_bin": ~F.col("temperature_bin").isin(*bins),
        "kpi_baseline_bin": _outside("baseline_temperature_bin", C.TEMPERATURE_BINS),
        "kpi_compare_bin": _outside("compare_temperature_bin", C.TEMPERATURE_BINS),
        "kpi_bins_paired": base.isNull() != comp.isNull(),
        "kpi_bins_distinct": base == comp,
    }


def ranking_rules() -> dict[str, Column]:
    return {
        "ranking_ranking_type": ~F.col("ranking_type").isin(list(C.FAMILIES)),
        "ranking_timeframe": ~F.col("timeframe").isin(list(C.TIMEFRAME_DAYS)),
        "ranking_temperature_bin": ~F.col("temperature_bin").isin("all", *C.TEMPERATURE_BINS),
        "ranking_cohort_size": _below("cohort_size", 0),
        "ranking_position": F.col("rank_position") <= 0,
        "ranking_confidence": ~F.col("confidence_level").isin(list(C.CONFIDENCE_LEVELS)),
    }


def count_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) from one scan with one conditional count per rule."""
    counts = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules.items()])
    return counts.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
        ).alias("v")
    ).select("v.*")


def check_violations(obs: DataFrame, sess: DataFrame, kpi: DataFrame, rank: DataFrame) -> DataFrame:
    return (
        count_violations(obs, observation_rules())
        .unionByName(count_violations(sess, session_rules()))
        .unionByName(count_violations(kpi, kpi_rules()))
        .unionByName(count_violations(rank, ranking_rules()))
    )


KPI_UNIQUE = ["vehicle_uid", "ranking_type", "timeframe", "temperature_bin", "kpi_key", "computed_at"]
RANKING_UNIQUE = ["ranking_type", "timeframe", "temperature_bin", "cohort_key", "vehicle_uid", "computed_at"]


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def check_unique(kpi: DataFrame, rank: DataFrame) -> DataFrame:
    """Number of violated natural keys per table."""
    total = lambda df, name: df.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("violations"))
    return total(duplicate_keys(kpi, KPI_UNIQUE), "kpi_unique").unionByName(
        total(duplicate_keys(rank, RANKING_UNIQUE), "ranking_unique")
    )
