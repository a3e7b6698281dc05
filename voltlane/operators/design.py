"""Operators that the product documents describe beyond the running code."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scalars import clamp, confidence, instant, year_band
from ..session import table_stage
from .ordering import exact_median
from .rankings import vehicle_catalog
from .skew import join_counted


def cohort_fallback(vehicle: DataFrame, minimum: int = C.COHORT_GATE, preferred: int = C.COHORT_PREFERRED) -> DataFrame:
    """Most specific cohort of each vehicle that has at least ``minimum`` vehicles.

    Levels: model with trim and years, model with years, model, powertrain class. The
    least specific level is taken when none is large enough.
    """
    known = [F.coalesce(c, F.lit("unknown")) for c in ("powertrain_class", "make", "model", "trim")]
    power, make, model, trim = known
    years = year_band(F.col("model_year"))
    keys = {
        1: F.concat_ws("|", power, make, model, trim, years),
        2: F.concat_ws("|", power, make, model, years),
        3: F.concat_ws("|", power, make, model),
        4: power,
    }
    names = [f"_k{i}" for i in keys]
    rows = vehicle.select("vehicle_uid", *[k.alias(f"_k{i}") for i, k in keys.items()])
    cohorts = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n1"))
    for i in (2, 3, 4):  # sums over cohorts, not over vehicles
        larger = cohorts.groupBy(f"_k{i}").agg(F.sum("_n1").alias(f"_n{i}"))
        cohorts = cohorts.join(larger, f"_k{i}")
    level = lambda i: F.struct(
        F.lit(i).cast("bigint").alias("level"), F.col(f"_k{i}").alias("cohort_key"), F.col(f"_n{i}").alias("cohort_size")
    )
    chosen = F.coalesce(*[F.when(F.col(f"_n{i}") >= minimum, level(i)) for i in keys], level(4))
    facts = cohorts.select("_k1", "_n1", chosen.alias("c"))
    return join_counted(rows.select("vehicle_uid", "_k1"), facts, ["_k1"], "_n1").select(
        "vehicle_uid", "c.*", (F.col("c.cohort_size") < preferred).alias("low_confidence")
    )


def source_precedence(obs: DataFrame, stage=None) -> DataFrame:
    """Adds ``is_winner``: per (vehicle, signal) by source priority, then newest, then confidence.

    Losing readings are kept. The winner is a partial aggregate joined back by key. A
    reading without vehicle or signal competes with none: ``is_winner`` is null.
    """
    stage = stage or table_stage(obs.sparkSession)
    keyless = F.col("vehicle_uid").isNull() | F.col("signal_key").isNull()
    aside = obs.where(keyless).withColumn("is_winner", F.lit(None).cast("boolean"))
    obs = obs.where(~keyless)
    cloud_first = F.col("signal_key").isin(list(C.SMARTCAR_FIRST_SIGNALS))
    first, second = C.SOURCE_PRIORITY["smartcar_over_obd"]
    preferred = F.when(cloud_first, first).otherwise(second)
    order = F.struct(
        (F.col("source") == preferred).cast("int").alias("p"), F.col("observed_at"),
        F.coalesce("confidence", F.lit(-1.0)).alias("c"), F.col("observation_id"),
    )
    best = stage(obs.groupBy("vehicle_uid", "signal_key").agg(
        F.max(order)["observation_id"].alias("_best"), F.count(F.lit(1)).alias("_n")
    ), "winners")
    return join_counted(obs, best, ["vehicle_uid", "signal_key"], "_n").withColumn(
        "is_winner", F.col("observation_id") == F.col("_best")
    ).drop("_best", "_n").unionByName(aside)


def with_freshness(obs: DataFrame, as_of: datetime) -> DataFrame:
    """Adds ``effective_status``: ok becomes stale once the reading is older than its TTL."""
    limit = F.col("observed_at") + F.make_dt_interval(secs=F.col("freshness_ttl_seconds"))
    expired = (F.col("status") == "ok") & (limit < instant(as_of, obs, "observed_at"))
    return obs.withColumn("effective_status", F.when(expired, "stale").otherwise(F.col("status")))


def cohort_temperature_metrics(kpi: DataFrame, vehicle: DataFrame) -> DataFrame:
    """Median temperature KPI per cohort, timeframe and metric, with vehicle and sample counts."""
    keys = ["cohort_key", "timeframe", "kpi_key"]
    rows = kpi.where((F.col("ranking_type") == C.TEMPERATURE) & (F.col("temperature_bin") == "cold")).join(
        vehicle_catalog(vehicle).select("vehicle_uid", "cohort_key"), "vehicle_uid"
    )
    samples = rows.groupBy(*keys).agg(F.sum("sample_count").alias("compare_sample_count"))
    return (
        exact_median(rows, keys, "kpi_value")
        .join(samples, keys)
        .select(
            *keys, F.col("median").alias("metric_value"), F.col("n").alias("vehicles"), "compare_sample_count",
            confidence(F.col("compare_sample_count")).alias("confidence_level"),
        )
    )


def charge_acceptance(sess: DataFrame, stage=None) -> DataFrame:
    """Charging power against the fleet's usual power for the same SOC band, temperature and charger.

    (vehicle_uid, acceptance_score 0-100, sessions): the median of observed over expected.
    Medians and counted joins read their input several times, so each input is written
    once by ``stage`` (default: :func:`table_stage`).
    """
    stage = stage or table_stage(sess.sparkSession)
    bins = ["soc_band", "temperature_bin", "charger_type"]
    band: Column = F.floor(F.col("soc_start_pct") / 10.0).cast("bigint")
    rows = sess.where(
        (F.col("avg_charge_power_kw") > 0) & F.col("soc_start_pct").isNotNull() & F.col("temperature_bin").isNotNull()
    ).select("vehicle_uid", "session_id", band.alias("soc_band"), "temperature_bin", "charger_type", "avg_charge_power_kw")
    rows = stage(rows, "rows")
    expected = stage(exact_median(rows, bins, "avg_charge_power_kw").withColumnRenamed("median", "expected_kw"), "expected")
    ratios = join_counted(rows, expected, bins, "n").withColumn("ratio", F.col("avg_charge_power_kw") / F.col("expected_kw"))
    return exact_median(stage(ratios.select("vehicle_uid", "ratio"), "ratios"), ["vehicle_uid"], "ratio").select(
        "vehicle_uid", clamp(F.lit(100.0) * F.col("median"), 0, 100).alias("acceptance_score"), F.col("n").alias("sessions")
    )
