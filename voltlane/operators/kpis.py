"""KPI families as wide tables per (vehicle, timeframe), then as long KPI rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..config import TemperatureGates
from ..functions.scalars import (
    Timeframe,
    clamp,
    confidence,
    instant,
    is_finite,
    matching_timeframes,
    range_score,
    to_real,
)
from ..session import Stage
from .ordering import exact_median
from .series import (
    delta_accepted,
    earliest_of,
    km_per_soc_of,
    series_points,
    slope,
    temperature_bucket_of,
    whole_seconds,
)

VT = ["vehicle_uid", "timeframe"]


# ---- wide building blocks ---------------------------------------------------------------
def drive_medians(filled: DataFrame, tf: list[Timeframe], kwh: float = C.USABLE_BATTERY_KWH, stage: Stage | None = None) -> DataFrame:
    """Exact medians and counts of every drive series, one row per (vehicle, timeframe)."""
    return medians_of(series_points(filled, tf, kwh), stage)


def medians_of(points: DataFrame, stage: Stage | None = None) -> DataFrame:
    medians = exact_median(points, ["vehicle_uid", "series"], "value", labels="timeframes", stage=stage)
    picks = []
    for s in ("km", "wh", "urban", "highway", "cold", "mild"):
        mine = F.col("series") == s
        picks.append(F.max(F.when(mine, F.col("median"))).alias(f"{s}_median"))
        picks.append(F.coalesce(F.max(F.when(mine, F.col("n"))), F.lit(0)).alias(f"{s}_n"))
    return medians.groupBy(*VT).agg(*picks)


def drive_facts(filled: DataFrame, tf: list[Timeframe]) -> DataFrame:
    """Everything else the drive KPIs need, in one aggregation per vehicle.

    Latest SOC, integrated energy, distance per temperature group and regression slope;
    one output row per (vehicle, timeframe).
    """
    return facts_of(drive_fact_rows(filled), tf)


def drive_fact_rows(filled: DataFrame) -> DataFrame:
    """What a step adds to the facts: temperature point and held power, each with the instant its timeframes must reach."""
    km = F.col("odo") - F.col("prev_odo")
    soc = F.col("prev_soc") - F.col("soc")
    ratio = F.when(delta_accepted(km, soc), km_per_soc_of(km, soc))
    gap = whole_seconds(F.col("observed_at")) - whole_seconds(F.col("prev_power_at"))
    held = (F.col("power_at") == F.col("observed_at")) & gap.between(1, 300)

    def energy(kw: Column) -> Column:
        return F.when(is_finite(kw) & (kw > 0.0), kw * (F.col("_gap") / 3600.0) * 1000.0)

    return (
        filled.select(
            *[c for c in ("vehicle_uid", "bucket") if c in filled.columns], "soc", "soc_at", "temp", "prev_power",
            km.alias("_km"), ratio.alias("_ratio"),
            F.when(ratio.isNotNull(), earliest_of(*[F.col(f"prev_{c}_at") for c in ("odo", "soc", "temp")])).alias("_t_since"),
            F.when(held, F.col("prev_power_at")).alias("_p_since"),
            F.when(held, gap).alias("_gap"),
        )
        .withColumn("_regen", energy(F.col("prev_power.regen")))
        .withColumn("_traction", energy(F.col("prev_power.traction")))
        .drop("prev_power", "_gap")
    )


def facts_of(rows: DataFrame, tf: list[Timeframe]) -> DataFrame:
    rows = rows.withColumn("_group", temperature_bucket_of(F.col("temp")))
    packs = []
    for t in tf:
        cut = instant(t.cutoff, rows, "soc_at")
        drive, power = F.col("_t_since") >= cut, F.col("_p_since") >= cut
        y, x = F.when(drive, F.col("_ratio")), F.when(drive, F.col("temp"))
        total = lambda hit, c: F.coalesce(F.sum(F.when(hit, c)), F.lit(0.0))
        packs.append(
            F.struct(
                F.lit(t.token).alias("timeframe"), F.lit(t.cutoff.isoformat(sep=" ")).alias("_cut"),
                total(drive & (F.col("_group") == "cold"), F.col("_km")).alias("cold_km"),
                total(drive & (F.col("_group") == "mild"), F.col("_km")).alias("mild_km"),
                F.count(y).alias("temp_points"),
                slope(y, x).alias("slope"),
                total(power, F.col("_regen")).alias("regen_wh"),
                total(power, F.col("_traction")).alias("traction_wh"),
                F.count_if(power & (F.col("_regen").isNotNull() | F.col("_traction").isNotNull())).alias("power_windows"),
            )
        )
    kind = rows.schema["soc_at"].dataType.simpleString()
    return (
        rows.groupBy("vehicle_uid")
        .agg(
            F.array(*packs).alias("_p"),
            F.max_by("soc", "soc_at").alias("_soc"),
            F.max("soc_at").alias("_soc_at"),
        )
        .select("vehicle_uid", "_soc", "_soc_at", F.explode("_p").alias("_p"))
        .select("vehicle_uid", "_soc", "_soc_at", "_p.*")
        .withColumn("latest_soc", F.when(F.col("_soc_at") >= F.col("_cut").cast(kind), F.col("_soc")))
        .drop("_soc", "_soc_at", "_cut")
    )


# ---- range efficiency ---------------------------------------------------------------------
RANGE_KEYS = {
    "ev_net_energy_efficiency": "km_n",
    "ev_estimated_practical_range": "km_n",
    "soc_depletion_rate_per_100km": "km_n",
    "ev_range_efficiency_score": "km_n",
    "ev_urban_efficiency": "urban_n",
    "ev_highway_efficiency": "highway_n",
    "regeneration_recovery_ratio": "regen_n",
}


def range_wide(medians: DataFrame, facts: DataFrame, kwh: float = C.USABLE_BATTERY_KWH) -> DataFrame:
    """Range-efficiency KPIs. No km-per-SOC point means no KPI at all, regeneration included."""
    df = medians.where(F.col("km_median").isNotNull()).join(facts, VT, "left")
    depletion = F.when(F.col("km_median") > 0.0, F.lit(100.0) / F.col("km_median")).otherwise(F.lit(100.0))
    soc = clamp(F.coalesce("latest_soc", F.lit(50.0)), 0, 100)
    total = F.col("regen_wh") + F.col("traction_wh")
    return (
        df.withColumn("soc_depletion_rate_per_100km", depletion)
        .withColumn("ev_estimated_practical_range", F.greatest(soc * F.col("km_median"), F.lit(0.0)))
        .withColumn(
            "ev_net_energy_efficiency",
            F.coalesce("wh_median", F.greatest(F.col("soc_depletion_rate_per_100km") * float(kwh) / 10.0, F.lit(0.0))),
        )
        .withColumn(
            "ev_range_efficiency_score",
            range_score(F.col("ev_net_energy_efficiency"), F.col("ev_estimated_practical_range")),
        )
        .withColumn("ev_urban_efficiency", F.col("urban_median"))
        .withColumn("ev_highway_efficiency", F.col("highway_median"))
        .withColumn(
            "regeneration_recovery_ratio",
            F.when(F.col("regen_wh") > 0.0, clamp(F.lit(100.0) * F.col("regen_wh") / total, 0, 100)),
        )
        .withColumn("regen_n", F.greatest(F.col("power_windows"), F.lit(1)))
    )


# ---- charging --------------------------------------------------------------------------------
CHARGING_KEYS = {
    "temp_adjusted_charge_acceptance_score": "all_n",
    "cold_weather_charge_speed_retention": "retention_n",
    "charging_performance_score": "all_n",
}


def charge_power_buckets(sess: DataFrame, tf: list[Timeframe], stage: Stage | None = None) -> DataFrame:
    """Median average power and session count of all, cold and mild sessions.

    Only sessions with a positive finite power *and* a temperature bin count, also for "all".
    """
    power, bin_ = F.col("avg_charge_power_kw"), F.col("temperature_bin")
    usable = sess.where(is_finite(power) & (power > 0.0) & bin_.isNotNull())
    series = F.array_compact(
        F.array(
            F.lit("all"),
            F.when(bin_.isin(*C.COLD_BINS), F.lit("cold")),
            F.when(bin_ == "mild", F.lit("mild")),
        )
    )
    points = (
        usable.select(
            "vehicle_uid", F.explode(series).alias("series"), power.alias("value"),
            matching_timeframes(F.col("started_at"), sess, "started_at", tf).alias("timeframes"),
        )
        .where(F.size("timeframes") > 0)
    )
    medians = exact_median(points, ["vehicle_uid", "series"], "value", labels="timeframes", stage=stage)
    picks = []
    for s in ("all", "cold", "mild"):
        mine = F.col("series") == s
        picks.append(F.max(F.when(mine, F.col("median"))).alias(f"{s}_kw"))
        picks.append(F.coalesce(F.max(F.when(mine, F.col("n"))), F.lit(0)).alias(f"{s}_n"))
    return medians.groupBy(*VT).agg(*picks)


def charge_retention(gates: TemperatureGates) -> tuple[Column, Column]:
    """(retention, samples) from the columns of :func:`charge_power_buckets`."""
    enough = (F.col("cold_n") >= gates.cold_sessions) & (F.col("mild_n") >= gates.mild_sessions)
    value = F.when(
        enough & (F.col("mild_kw") > 0.0), clamp(F.lit(100.0) * F.col("cold_kw") / F.col("mild_kw"), 0, 200)
    )
    return value, F.least("cold_n", "mild_n")


def charging_wide(buckets: DataFrame, gates: TemperatureGates = TemperatureGates()) -> DataFrame:
    retention, samples = charge_retention(gates)
    mild = F.coalesce("mild_kw", F.greatest(F.col("all_kw"), F.lit(1e-6)))
    acceptance = F.when(mild > 0.0, clamp(F.lit(100.0) * F.col("all_kw") / mild, 0, 120)).otherwise(F.lit(100.0))
    return (
        buckets.withColumn("temp_adjusted_charge_acceptance_score", acceptance)
        .withColumn("cold_weather_charge_speed_retention", retention)
        .withColumn("retention_n", samples)
        .withColumn(
            "charging_performance_score",
            clamp(
                F.coalesce(
                    0.6 * F.col("temp_adjusted_charge_acceptance_score")
                    + 0.4 * F.col("cold_weather_charge_speed_retention"),
                    F.col("temp_adjusted_charge_acceptance_score"),
                ),
                0, 100,
            ),
        )
    )


# ---- temperature impact --------------------------------------------------------------------------
TEMPERATURE_KEYS = {
    "cold_weather_range_retention": "range_n",
    "range_temperature_sensitivity_index": "temp_points",
    "cold_weather_charge_speed_retention": "retention_n",
}


def temperature_wide(
    medians: DataFrame, facts: DataFrame, buckets: DataFrame, gates: TemperatureGates = TemperatureGates()
) -> DataFrame:
    """Drive KPIs behind the distance gate; charge retention independent of it."""
    retention, samples = charge_retention(gates)
    drive = facts.join(medians.select(*VT, "cold_median", "mild_median", "cold_n", "mild_n"), VT)
    passed = (F.col("cold_km") >= gates.cold_km) & (F.col("mild_km") >= gates.mild_km)
    kept = F.when(
        passed & (F.col("mild_median") > 0.0),
        clamp(F.lit(100.0) * F.col("cold_median") / F.col("mild_median"), 0, 200),
    )
    loss = F.when(F.col("slope") < 0.0, -F.col("slope") * 10.0 / F.col("mild_median") * 100.0)
    loss = F.when(F.col("slope").isNotNull(), F.coalesce(loss, F.lit(0.0)))
    drive = (
        drive.withColumn("cold_weather_range_retention", kept)
        .withColumn(
            "range_temperature_sensitivity_index",
            F.when(
                F.col("cold_weather_range_retention").isNotNull()
                & (F.col("temp_points") >= gates.sensitivity_points),
                clamp(loss, 0, 100),
            ),
        )
        .withColumn("range_n", F.least("cold_n", "mild_n"))
        .select(*VT, "cold_weather_range_retention", "range_temperature_sensitivity_index", "range_n", "temp_points")
    )
    charge = buckets.select(
        *VT, retention.alias("cold_weather_charge_speed_retention"), samples.alias("retention_n")
    )
    return drive.join(charge, VT, "full")


# ---- long rows ------------------------------------------------------------------------------------
def catalog_entry(family: str, key: str):
    for entry in C.KPI_CATALOG:
        if entry[0] == family and entry[1] == key:
            return entry
    raise ValueError(f"the catalog of {family} has no key {key}")


def to_kpi_rows(
    wide: DataFrame, family: str, keys: dict[str, str], as_of: datetime, real_storage: bool = False
) -> DataFrame:
    """One row per present KPI, with unit, direction, sample count and confidence.

    ``keys`` maps KPI key (a column of ``wide``) to the column with its sample count.
    Temperature rows are written for the bins "all" and "cold" against mild.
    """
    cells = []
    for key, samples in keys.items():
        _, _, unit, direction, *_ = catalog_entry(family, key)
        value = to_real(F.col(key)) if real_storage else F.col(key).cast("double")
        cell = F.struct(
            F.lit(key).alias("kpi_key"), value.alias("kpi_value"), F.lit(unit).alias("kpi_unit"),
            F.lit(direction).alias("direction"), F.col(samples).cast("bigint").alias("sample_count"),
        )
        cells.append(F.when(F.col(key).isNotNull(), cell))
    rows = wide.select(*VT, F.explode(F.array_compact(F.array(*cells))).alias("k")).select(*VT, "k.*")
    return stamp_kpi_rows(fan_out_bins(rows, family), family, as_of)


def fan_out_bins(rows: DataFrame, family: str) -> DataFrame:
    """Temperature KPIs appear under "all" and "cold"; other families under "all" only."""
    if family == C.TEMPERATURE:
        return (
            rows.withColumn("temperature_bin", F.explode(F.array(F.lit("all"), F.lit("cold"))))
            .withColumn("baseline_temperature_bin", F.lit("mild"))
            .withColumn("compare_temperature_bin", F.lit("cold"))
        )
    none = F.lit(None).cast("string")
    return (
        rows.withColumn("temperature_bin", F.lit("all"))
        .withColumn("baseline_temperature_bin", none)
        .withColumn("compare_temperature_bin", none)
    )


def stamp_kpi_rows(rows: DataFrame, family: str, as_of: datetime) -> DataFrame:
    """Snapshot columns around the values: deterministic id, confidence, instants, job."""
    moment = as_of.isoformat(sep=" ")
    natural = F.concat_ws("|", F.lit(family), "vehicle_uid", "timeframe", "temperature_bin", "kpi_key", F.lit(moment))
    stamp = F.lit(moment).cast("timestamp_ntz")
    return rows.select(
        F.sha2(natural, 256).alias("snapshot_id"),
        "vehicle_uid", F.lit(family).alias("ranking_type"), "timeframe", "kpi_key", "kpi_value",
        "kpi_unit", "direction", confidence(F.col("sample_count")).alias("confidence_level"),
        "sample_count", "temperature_bin", "baseline_temperature_bin", "compare_temperature_bin",
        stamp.alias("computed_at"), F.lit(None).cast("timestamp_ntz").alias("valid_from"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(C.SOURCE_JOB).alias("source_job_id"),
    )


# ---- health and composite ----------------------------------------------------------------------------
def dtc_count(diag: DataFrame, tf: list[Timeframe]) -> DataFrame:
    """Distinct active trouble codes per vehicle and timeframe.

    A code counts from its newest sighting, so one row per (vehicle, code) is enough for
    all timeframes and no distinct set is held per vehicle.
    """
    newest = (
        diag.where((F.col("event_type") == "DTC_ACTIVE") & F.col("code").isNotNull())
        .groupBy("vehicle_uid", "code")
        .agg(F.max("observed_at").alias("observed_at"))
    )
    labelled = newest.withColumn(
        "timeframe", F.explode(matching_timeframes(F.col("observed_at"), diag, "observed_at", tf))
    )
    return labelled.groupBy(*VT).agg(F.count(F.lit(1)).alias("dtc_count"))


def latest_mil(diag: DataFrame, tf: list[Timeframe]) -> DataFrame:
    """Newest malfunction-lamp state per vehicle and timeframe; ties by event id."""
    newest = (
        diag.where(F.col("event_type").isin("MIL_ON", "MIL_OFF"))
        .groupBy("vehicle_uid")
        .agg(F.max(F.struct("observed_at", "event_id", "event_type")).alias("m"))
    )
    labels = matching_timeframes(F.col("m.observed_at"), diag, "observed_at", tf)
    return newest.select("vehicle_uid", F.explode(labels).alias("timeframe"), F.col("m.event_type").alias("mil"))


def health_penalty(vehicle: DataFrame, diag: DataFrame, tf: list[Timeframe]) -> DataFrame:
    """Penalty points (0-10) and sample count for every vehicle and timeframe."""
    frames = F.explode(F.array(*[F.lit(t.token) for t in tf])).alias("timeframe")
    codes = F.coalesce("dtc_count", F.lit(0))
    lamp = F.when(F.col("mil") == "MIL_ON", 6.0).otherwise(0.0)
    return (
        vehicle.select("vehicle_uid", frames)
        .join(dtc_count(diag, tf), VT, "left")
        .join(latest_mil(diag, tf), VT, "left")
        .select(
            *VT,
            F.least(lamp + F.least(codes * 0.5, F.lit(4.0)), F.lit(10.0)).alias("ev_health_modifier_penalty"),
            F.greatest(codes + F.when(F.col("mil").isNotNull(), 1).otherwise(0), F.lit(1)).cast("bigint").alias("health_n"),
        )
    )


def latest_kpi(kpi: DataFrame, family: str, key: str) -> DataFrame:
    """Newest value of one KPI (bin "all") per vehicle and timeframe."""
    return (
        kpi.where(
            (F.col("ranking_type") == family) & (F.col("kpi_key") == key) & (F.col("temperature_bin") == "all")
        )
        .groupBy(*VT)
        .agg(F.max(F.struct("computed_at", "snapshot_id", "kpi_value", "sample_count")).alias("k"))
        .select(*VT, F.col("k.kpi_value").alias("value"), F.col("k.sample_count").alias("samples"))
    )


COMPOSITE_KEYS = {
    "ev_composite_base_score": "samples",
    "ev_health_modifier_penalty": "health_n",
    "ev_composite_score": "samples",
}


def composite_wide(kpi: DataFrame, vehicle: DataFrame, diag: DataFrame, tf: list[Timeframe]) -> DataFrame:
    """Base score from range (0.6) and charging (0.4), or the one present, less the penalty."""
    rng = latest_kpi(kpi, C.RANGE, "ev_range_efficiency_score").toDF(*VT, "range_score", "range_n")
    chg = latest_kpi(kpi, C.CHARGING, "charging_performance_score").toDF(*VT, "charging_score", "charging_n")
    base = clamp(
        F.coalesce(0.6 * F.col("range_score") + 0.4 * F.col("charging_score"), "range_score", "charging_score"), 0, 100
    )
    return (
        rng.join(chg, VT, "full")
        .join(health_penalty(vehicle, diag, tf), VT)
        .withColumn("ev_composite_base_score", base)
        .withColumn(
            "ev_composite_score",
            clamp(F.col("ev_composite_base_score") - F.col("ev_health_modifier_penalty"), 0, 100),
        )
        .withColumn("samples", F.greatest("range_n", "charging_n", "health_n"))
    )


# ---- family entry points --------------------------------------------------------------------------------
def range_kpis(filled, as_of, tf, kwh=C.USABLE_BATTERY_KWH, real_storage=False) -> DataFrame:
    """KPI rows of the range family from carried-forward drive steps."""
    wide = range_wide(drive_medians(filled, tf, kwh), drive_facts(filled, tf), kwh)
    return to_kpi_rows(wide, C.RANGE, RANGE_KEYS, as_of, real_storage)


def charging_kpis(sess, as_of, tf, gates=TemperatureGates(), real_storage=False) -> DataFrame:
    wide = charging_wide(charge_power_buckets(sess, tf), gates)
    return to_kpi_rows(wide, C.CHARGING, CHARGING_KEYS, as_of, real_storage)


def temperature_kpis(filled, sess, as_of, tf, gates=TemperatureGates(), real_storage=False) -> DataFrame:
    wide = temperature_wide(drive_medians(filled, tf), drive_facts(filled, tf), charge_power_buckets(sess, tf), gates)
    return to_kpi_rows(wide, C.TEMPERATURE, TEMPERATURE_KEYS, as_of, real_storage)


def composite_kpis(kpi, vehicle, diag, as_of, tf, real_storage=False) -> DataFrame:
    return to_kpi_rows(composite_wide(kpi, vehicle, diag, tf), C.COMPOSITE, COMPOSITE_KEYS, as_of, real_storage)
