"""Charging sessions: windows, interval join with the readings, metrics, upsert."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scalars import charger_type, instant, is_finite, temperature_bin, to_real, whole_seconds_between
from ..functions.sizes import broadcast_if_small
from ..session import Stage, table_stage
from .series import time_bucket

SESSION_SIGNALS = (C.SOC, C.CHARGE_POWER, C.BATTERY_POWER, C.AMBIENT, C.BATTERY_TEMP, C.CHARGER_TYPE)
BUCKET_SECONDS = 3600


def session_windows(events: DataFrame) -> DataFrame:
    """Earliest start and latest stop per charging session; sessions without a start are dropped."""
    at = F.col("observed_at")
    return (
        events.where(F.col("session_type") == "charging")
        .groupBy("vehicle_uid", "session_id")
        .agg(
            F.min(F.when(F.col("event_type") == "start", at)).alias("started_at"),
            F.max(F.when(F.col("event_type") == "stop", at)).alias("ended_at"),
        )
        .where(F.col("started_at").isNotNull())
    )


#: A block of the next level is 2 ** FAN_OUT_BITS blocks of the one below; the highest holds everything after it.
FAN_OUT_BITS = 2
LEVELS = 14


def covering_blocks(first: Column, last: Column, bits: int = FAN_OUT_BITS, levels: int = LEVELS) -> Column:
    """The fewest aligned blocks that cover slots ``first`` to ``last``, as array<struct<level, block>>.

    From the lowest level up, blocks that do not fill a block of the next level are listed at both ends, and what is
    between them goes on a level higher. So a window of n slots has O(log n) blocks, and a slot lies in one of them only.
    """
    fan = 1 << bits
    block = lambda level, b: F.struct(level.alias("level"), b.alias("block"))
    run = lambda level, a, b: F.when(a <= b, F.transform(F.sequence(a, b), lambda x: block(level, x))).otherwise(none)
    none = F.array().cast("array<struct<level:int,block:bigint>>")

    def step(state: Column, level: Column) -> Column:
        a, b = state["a"], state["b"]
        # whole blocks of the next level between the ends
        up, down = F.floor((a + fan - 1) / fan).cast("bigint"), F.floor((b + 1) / fan).cast("bigint") - 1
        top = level == levels - 1
        inner = (up <= down) & ~top
        ends = F.when(inner, F.concat(run(level, a, up * fan - 1), run(level, (down + 1) * fan, b))).otherwise(run(level, a, b))
        going = F.when(inner, up).otherwise(F.lit(1).cast("bigint")), F.when(inner, down).otherwise(F.lit(0).cast("bigint"))
        return F.struct(going[0].alias("a"), going[1].alias("b"), F.concat(state["out"], ends).alias("out"))

    start = F.struct(first.cast("bigint").alias("a"), last.cast("bigint").alias("b"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, step, lambda state: state["out"])


def observations_in_windows(
    obs: DataFrame, windows: DataFrame, as_of: datetime, bucket_seconds: int = BUCKET_SECONDS, stage: Stage | None = None
) -> DataFrame:
    """Readings of a vehicle inside its session windows, both ends included.

    Matched by vehicle and time, not by session id. An open session reaches to ``as_of``.
    The equality part of the join is (vehicle, level, block of time buckets): a window is listed once for each block
    that covers it, and a reading looks for the blocks it lies in. A vehicle with very many readings is
    so spread over its time buckets, and a session that stays open for years is a few dozen rows. Readings look
    on higher levels only for vehicles with a window there, and only on levels that any window has.
    The blocks are written once by ``stage`` (default: :func:`table_stage`), as they are read several times.
    """
    stage = stage or table_stage(windows.sparkSession)
    close = F.coalesce(F.col("ended_at"), instant(as_of, windows, "started_at"))
    first, last = time_bucket(F.col("started_at"), bucket_seconds), time_bucket(F.col("_close"), bucket_seconds)
    spread = (
        windows.withColumn("_close", close)
        .where(F.col("_close") >= F.col("started_at"))
        .select("vehicle_uid", "session_id", "started_at", "_close", F.explode(covering_blocks(first, last)).alias("_c"))
        .select("vehicle_uid", "session_id", "started_at", "_close", F.col("_c.level").alias("_level"), F.col("_c.block").alias("_slot"))
    )
    spread = stage(spread, f"blocks-{uuid.uuid4().hex}")
    levels = sorted(r[0] for r in spread.select("_level").distinct().collect())
    readings = obs.where(F.col("signal_key").isin(list(SESSION_SIGNALS))).select(
        "vehicle_uid", "observation_id", "signal_key", "value_number", "value_string", "observed_at",
        "ingested_at", time_bucket(F.col("observed_at"), bucket_seconds).alias("_slot"),
    )
    higher = [level for level in levels if level]
    if higher:
        there = spread.where(F.col("_level") > 0).select("vehicle_uid", F.lit(True).alias("_higher")).distinct()
        readings = readings.join(broadcast_if_small(there), "vehicle_uid", "left")
        own = F.when(F.col("_higher"), F.array(*[F.lit(level) for level in [0, *higher]])).otherwise(F.array(F.lit(0)))
        probes = readings.withColumn("_level", F.explode(own)).drop("_higher")
    else:
        probes = readings.withColumn("_level", F.lit(0))
    probes = probes.withColumn("_slot", F.expr(f"shiftright(_slot, {FAN_OUT_BITS} * _level)"))
    return (
        probes.join(spread, ["vehicle_uid", "_level", "_slot"])
        .where(F.col("observed_at").between(F.col("started_at"), F.col("_close")))
        .drop("_level", "_slot", "_close", "started_at")
    )


def session_metrics(windows: DataFrame, matched: DataFrame, real_storage: bool = False) -> DataFrame:
    """Charging-session rows. Every aggregate is combined before the shuffle by session."""
    keep = to_real if real_storage else (lambda c: c)
    key, num = F.col("signal_key"), F.col("value_number")
    when_read = F.struct("observed_at", "ingested_at", "observation_id")
    soc = F.when(key == C.SOC, num)
    soc_at = F.when((key == C.SOC) & num.isNotNull(), when_read)
    power = F.when(key.isin(C.CHARGE_POWER, C.BATTERY_POWER) & is_finite(num), F.abs(num))
    label_at = F.when((key == C.CHARGER_TYPE) & F.col("value_string").isNotNull(), when_read)

    facts = matched.groupBy("vehicle_uid", "session_id").agg(
        F.min_by(soc, soc_at).alias("soc_start_pct"),
        F.max_by(soc, soc_at).alias("soc_end_pct"),
        F.avg(power).alias("avg_charge_power_kw"),
        F.max(power).alias("peak_charge_power_kw"),
        F.count(power).alias("sample_count"),
        F.avg(F.when(key == C.AMBIENT, num)).alias("ambient_temp_avg_c"),
        F.avg(F.when(key == C.BATTERY_TEMP, num)).alias("battery_temp_avg_c"),
        F.max_by("value_string", label_at).alias("_charger"),
    )
    joined = windows.join(facts, ["vehicle_uid", "session_id"], "left")
    hours = F.when(
        F.col("ended_at") > F.col("started_at"),
        whole_seconds_between(F.col("started_at"), F.col("ended_at")) / 3600.0,
    ).otherwise(F.lit(0.0))
    return joined.select(
        F.sha2(F.concat_ws("|", F.lit("charging"), "session_id"), 256).alias("charging_session_id"),
        "vehicle_uid", "session_id", "started_at", "ended_at",
        F.when(F.col("ended_at").isNotNull(), "complete").otherwise("partial").alias("status"),
        charger_type(F.coalesce("_charger", F.lit("unknown"))).alias("charger_type"),
        keep(F.col("soc_start_pct")).alias("soc_start_pct"),
        keep(F.col("soc_end_pct")).alias("soc_end_pct"),
        keep(F.col("soc_end_pct") - F.col("soc_start_pct")).alias("soc_delta_pct"),
        keep(F.col("avg_charge_power_kw") * hours).alias("energy_added_kwh"),
        keep(F.col("avg_charge_power_kw")).alias("avg_charge_power_kw"),
        keep(F.col("peak_charge_power_kw")).alias("peak_charge_power_kw"),
        keep(F.col("ambient_temp_avg_c")).alias("ambient_temp_avg_c"),
        keep(F.col("battery_temp_avg_c")).alias("battery_temp_avg_c"),
        temperature_bin(F.coalesce("ambient_temp_avg_c", "battery_temp_avg_c")).alias("temperature_bin"),
        F.lit(False).alias("temperature_is_estimated"),
        F.coalesce("sample_count", F.lit(0)).cast("bigint").alias("sample_count"),
    )


def charging_sessions(
    obs: DataFrame, events: DataFrame, as_of: datetime, real_storage: bool = False,
    bucket_seconds: int = BUCKET_SECONDS, stage: Stage | None = None,
) -> DataFrame:
    """Windows, readings inside them and metrics, with audit instants.

    Windows are written once by ``stage`` (default: :func:`table_stage`), as they are read several times.
    """
    stage = stage or table_stage(events.sparkSession)
    windows = stage(session_windows(events), f"windows-{uuid.uuid4().hex}")
    return sessions_of_windows(obs, windows, as_of, real_storage, bucket_seconds, stage)


def sessions_of_windows(
    obs: DataFrame, windows: DataFrame, as_of: datetime, real_storage: bool = False, bucket_seconds: int = BUCKET_SECONDS,
    stage: Stage | None = None,
) -> DataFrame:
    """Sessions of windows that are known already; the windows are read several times."""
    rows = session_metrics(windows, observations_in_windows(obs, windows, as_of, bucket_seconds, stage), real_storage)
    now = instant(as_of, windows, "started_at")
    return rows.withColumn("created_at", now).withColumn("updated_at", now)


def upsert_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge on ``session_id``: new values win, id and creation instant of a known row stay.

    The owning vehicle of a known session stays as well. Of several new rows with one
    ``session_id`` the one that started last is taken, ties by vehicle.
    """
    whole = F.struct(F.col("started_at"), F.col("vehicle_uid"), F.struct(*new.columns).alias("row"))
    new = new.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.max(whole).alias("w")).select("w.row.*")
    sticky = ("charging_session_id", "created_at", "vehicle_uid")
    o, n = old.alias("o"), new.alias("n")
    known_new = F.col("n.session_id").isNotNull()

    def pick(c: str) -> Column:
        if c == "session_id" or c in sticky:
            return F.coalesce(f"o.{c}", f"n.{c}").alias(c)
        return F.when(known_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return o.join(n, F.col("o.session_id") == F.col("n.session_id"), "full").select(*[pick(c) for c in old.columns])
