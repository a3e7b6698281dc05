"""Column expressions shared by the operators. All are built-in Spark functions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C


# ---- small numeric helpers -----------------------------------------------------------
def clamp(c: Column, low: float, high: float) -> Column:
    """Null stays null: greatest/least alone would skip it."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def to_real(c: Column) -> Column:
    """Storage rounding of a single-precision column, read back as double."""
    return c.cast("float").cast("double")


def whole_seconds(c: Column) -> Column:
    """Epoch second of an instant, fraction dropped."""
    return F.unix_seconds(c.cast("timestamp"))


def whole_seconds_between(start: Column, end: Column) -> Column:
    """Seconds from ``start`` to ``end``, fraction dropped from the difference."""
    return F.timestamp_diff("SECOND", start, end)


# ---- telemetry labels -----------------------------------------------------------------
def temperature_bin(c: Column) -> Column:
    return (
        F.when(c <= -5.0, "very_cold")
        .when(c <= 5.0, "cold")
        .when(c <= 15.0, "cool")
        .when(c <= 25.0, "mild")
        .when(c.isNotNull(), "hot")
    )


def charger_type(c: Column) -> Column:
    text = F.lower(c)
    return (
        F.when(text.contains("dc") | text.contains("fast"), "dc")
        .when(text.contains("ac") | text.contains("level"), "ac")
        .otherwise("unknown")
    )


def parse_ts(c: Column) -> Column:
    """RFC 3339 text to an instant; anything else, text with blanks around it included, gives null."""
    text = F.upper(c)
    shape = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
    return F.when(text.rlike(shape), F.try_to_timestamp(text))


def map_session_event(c: Column) -> Column:
    """Upload event name to struct(session_type, event_type); unknown names give null."""
    out = None
    for name, (kind, edge) in C.SESSION_EVENTS.items():
        value = F.struct(F.lit(kind).alias("session_type"), F.lit(edge).alias("event_type"))
        out = F.when(c == name, value) if out is None else out.when(c == name, value)
    return out


def session_signal_key(session_type: Column, event_type: Column) -> Column:
    return F.concat_ws(".", F.lit("session"), session_type, event_type)


# ---- timeframes --------------------------------------------------------------------------
class Timeframe(tuple):
    """(token, cutoff): rows at or after ``cutoff`` belong to the timeframe."""

    token = property(lambda self: self[0])
    cutoff = property(lambda self: self[1])


def timeframes(as_of: datetime, tokens=C.LOCKED_TIMEFRAMES) -> list[Timeframe]:
    unknown = [t for t in tokens if t not in C.TIMEFRAME_DAYS]
    if unknown:
        raise ValueError(f"no timeframe is named {unknown[0]}")
    return [Timeframe((t, as_of - timedelta(days=C.TIMEFRAME_DAYS[t]))) for t in tokens]


def timeframe_table(spark: SparkSession, as_of: datetime, tokens=C.LOCKED_TIMEFRAMES) -> DataFrame:
    """The same as a DataFrame (timeframe, cutoff); cutoff carries no zone."""
    rows = [(t.token, t.cutoff) for t in timeframes(as_of, tokens)]
    return spark.createDataFrame(rows, "timeframe string, cutoff timestamp_ntz")


def instant(moment: datetime, df: DataFrame, column: str) -> Column:
    """Literal of the same timestamp type as ``df[column]``, so filters reach the scan."""
    kind = df.schema[column].dataType.simpleString()
    return F.lit(moment.isoformat(sep=" ")).cast(kind)


def matching_timeframes(since: Column, df: DataFrame, column: str, tf: list[Timeframe]) -> Column:
    """Tokens of the timeframes that ``since`` falls into, as an array (null gives an empty one)."""
    hits = [F.when(since >= instant(t.cutoff, df, column), F.lit(t.token)) for t in tf]
    return F.array_compact(F.array(*hits))


# ---- cohorts -----------------------------------------------------------------------------
def year_band(year: Column) -> Column:
    y = year.cast("bigint")
    band = F.concat_ws("-", y.cast("string"), (y + 2).cast("string"))
    return F.when(y.isNull(), F.lit("unknown")).otherwise(band)


def cohort_key(make: Column, model: Column, trim: Column, year: Column) -> Column:
    known = [F.coalesce(c, F.lit("unknown")) for c in (make, model, trim)]
    return F.concat_ws("|", F.lit("bev"), *known, year_band(year))


# ---- energy, confidence, scores -------------------------------------------------------------
def wh_per_km(delta_soc: Column, delta_km: Column, kwh) -> Column:
    battery = F.lit(float(kwh)) if not isinstance(kwh, Column) else kwh
    usable = (
        is_finite(delta_soc) & is_finite(delta_km) & is_finite(battery)
        & (delta_soc > 0) & (delta_km > 0) & (battery > 0)
    )
    value = F.try_divide(delta_soc / 100.0 * battery * 1000.0, delta_km)
    return F.when(usable & is_finite(value) & (value > 0), value)


def confidence(samples: Column) -> Column:
    return F.when(samples >= 60, "stable").when(samples >= 20, "medium").otherwise("preview")


def temperature_score(range_retention: Column, charge_retention: Column, sensitivity: Column) -> Column:
    rng = clamp(F.coalesce(range_retention, F.lit(0.0)), 0, 200)
    chg = clamp(F.coalesce(charge_retention, F.lit(0.0)), 0, 200)
    sens = clamp(F.coalesce(sensitivity, F.lit(50.0)), 0, 100)
    return clamp(0.45 * rng + 0.35 * chg + 0.20 * (100.0 - clamp(sens * 2.0, 0, 100)), 0, 100)


def range_score(wh: Column, km: Column) -> Column:
    """Efficiency (0.65) and range (0.35) components on a 0-100 scale."""
    return clamp(0.65 * clamp(100.0 - wh / 3.0, 0, 100) + 0.35 * clamp(km / 4.0, 0, 100), 0, 100)


def family_score(family: Column, kpi) -> Column:
    """Ranking score of a vehicle from its KPI values; ``kpi(key)`` returns the value column."""
    depletion_part = clamp(100.0 - F.coalesce(kpi("soc_depletion_rate_per_100km"), F.lit(50.0)), 0, 100)
    efficiency_part = F.coalesce(clamp(100.0 - kpi("ev_net_energy_efficiency") / 3.0, 0, 100), depletion_part)
    range_part = clamp(kpi("ev_estimated_practical_range") / 4.0, 0, 100)
    range_value = F.coalesce(
        kpi("ev_range_efficiency_score"),
        clamp(0.65 * efficiency_part + 0.35 * range_part, 0, 100),
        F.lit(0.0),
    )
    acceptance = F.coalesce(kpi("temp_adjusted_charge_acceptance_score"), F.lit(0.0))
    retention = F.coalesce(kpi("cold_weather_charge_speed_retention"), acceptance)
    charging_value = F.coalesce(
        kpi("charging_performance_score"), clamp(0.6 * acceptance + 0.4 * retention, 0, 100)
    )
    composite_value = clamp(F.coalesce(kpi("ev_composite_score"), F.lit(0.0)), 0, 100)
    return (
        F.when(family == C.RANGE, range_value)
        .when(family == C.CHARGING, charging_value)
        .when(family == C.COMPOSITE, composite_value)
        .otherwise(F.lit(0.0))
    )


def family_confidence(levels: Column) -> Column:
    """Aggregate: preview wins over medium, medium over stable; no rows give null."""
    weakest = F.min(F.when(levels == "preview", 0).when(levels == "medium", 1).otherwise(2))
    return F.when(weakest == 0, "preview").when(weakest == 1, "medium").when(weakest == 2, "stable")
