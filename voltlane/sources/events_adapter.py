"""Telemetry tables derived from the generic ``events`` and ``customer`` tables.

Stands in for uploads where only the test tables exist. Every row of ``events`` is used:

    view, signup   odometer and state of charge (running sums of ``value``, weighted by ``k``)
    error          ambient temperature, charging power, diagnostics
    click          vehicle speed, regeneration or traction power, charger type, raw response
    purchase       charging session start (odd) and stop (even)

Running sums are split by time bucket, so a user with very many events is spread out.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scalars import temperature_bin
from ..operators.ordering import running_totals
from ..operators.series import time_bucket

AS_OF = datetime(2024, 2, 3)
RUN_BUCKET_SECONDS = 900
ORIGIN = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base_events(spark: SparkSession, sf_dir: str, time_divisor: int = 1) -> DataFrame:
    """Events with integer cents ``c``, integer ``k`` and the vehicle.

    ``time_divisor`` > 1 compresses elapsed time, so that gaps of hours become minutes.
    """
    e = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", "event_type", "value",
        F.round(F.col("value") * 100).cast("bigint").alias("c"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.concat(F.lit("veh-"), F.col("user_id").cast("string")).alias("vehicle_uid"),
    )
    if time_divisor > 1:
        kind = e.schema["ts"].dataType.simpleString()
        origin = F.unix_micros(F.lit(ORIGIN).cast("timestamp"))
        elapsed = F.unix_micros(F.col("ts").cast("timestamp")) - origin
        squeezed = F.timestamp_micros(origin + F.floor(elapsed / F.lit(time_divisor)).cast("bigint"))
        e = e.withColumn("ts", squeezed.cast(kind))
    return e


def _reading(tag: str, key: Column, number: Column | None = None, text: Column | None = None,
             unit: Column | None = None, bin_: Column | None = None, raw: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(tag).alias("tag"),
        key.alias("signal_key"),
        (number if number is not None else none).cast("double").alias("value_number"),
        (text if text is not None else none).cast("string").alias("value_string"),
        (unit if unit is not None else none).cast("string").alias("unit"),
        (bin_ if bin_ is not None else none).cast("string").alias("temperature_bin"),
        (raw if raw is not None else none).cast("string").alias("raw_payload_ref"),
    )


def _as_observations(rows: DataFrame) -> DataFrame:
    """Exploded readings to the 20 observation columns."""
    k = F.col("k")
    late = F.when(F.col("r.tag") == "odo2", F.expr("INTERVAL 9 MINUTES")).otherwise(F.expr("INTERVAL 5 MINUTES"))
    return rows.select(
        F.concat(F.lit("obs-"), F.col("event_id").cast("string"), F.lit("-"), F.col("r.tag")).alias("observation_id"),
        "vehicle_uid",
        F.concat(F.lit("bat-"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("batch_id"),
        F.lit(None).cast("string").alias("session_id"),
        "r.signal_key", "r.value_number", "r.value_string",
        F.lit(None).cast("boolean").alias("value_bool"), F.lit(None).cast("string").alias("value_json"),
        "r.unit", F.col("ts").alias("observed_at"), (F.col("ts") + late).alias("ingested_at"),
        F.lit("OBD").alias("source"), F.col("r.tag").alias("source_signal"),
        F.when(k % 11 == 0, "stale").when(k % 13 == 0, "error").when(k % 17 == 0, "unavailable").otherwise("ok").alias("status"),
        ((k % 101) / F.lit(100.0)).alias("confidence"),
        F.lit(300).cast("bigint").alias("freshness_ttl_seconds"),
        "r.temperature_bin", F.lit(False).alias("is_temperature_estimated"), "r.raw_payload_ref",
    )


def raw_response(k: Column) -> Column:
    """Speed response of a click with noise chosen by ``k``."""
    hh = F.lpad(F.hex(k.cast("bigint")), 2, "0")
    return (
        F.when(k % 7 == 1, F.concat(F.lit("410D"), hh))
        .when(k % 7 == 2, F.concat(F.lit("SEARCHING... 41 0D "), hh))
        .when(k % 7 == 3, F.lit("NO DATA"))
        .when(k % 7 == 4, F.lit("41 0D"))
        .when(k % 7 == 5, F.concat(F.lit("41 0D 00 41 0D "), hh))
        .when(k % 7 == 6, F.concat(F.lit("410 D"), hh))
        .otherwise(F.concat(F.lit("41 0D "), hh))
    )


def observations(spark: SparkSession, sf_dir: str, time_divisor: int = 1) -> DataFrame:
    e = base_events(spark, sf_dir, time_divisor)
    k = F.col("k")
    ambient = k % 45 - 12

    driving = running_totals(
        e.where(F.col("event_type").isin("view", "signup")),
        ["user_id"], time_bucket(F.col("ts"), RUN_BUCKET_SECONDS), ["ts", "event_id"],
        {"run_c": F.col("c"), "run_s": F.col("c") * (k + 50)},
    )
    odo = (F.lit(1000000) + F.col("run_c")) / F.lit(100.0)
    soc = F.lit(95) - (F.expr("run_s div 1000") % 7000) / F.lit(100.0)
    odo_bin = F.when(k % 3 == 0, temperature_bin(ambient))
    driving_rows = driving.withColumn(
        "r",
        F.explode(
            F.array_compact(
                F.array(
                    _reading("odo", F.lit(C.ODOMETER), odo, unit=F.lit("km"), bin_=odo_bin),
                    _reading("soc", F.lit(C.SOC), soc, unit=F.lit("%")),
                    F.when(k % 19 == 0, _reading("odo2", F.lit(C.ODOMETER), odo + 0.25, unit=F.lit("km"))),
                )
            )
        ),
    )
    error_rows = e.where(F.col("event_type") == "error").withColumn(
        "r",
        F.explode(
            F.array(
                _reading("amb", F.lit(C.AMBIENT), ambient, unit=F.lit("C"), bin_=temperature_bin(ambient)),
                _reading("chg", F.lit(C.CHARGE_POWER), F.col("value"), unit=F.lit("kW")),
            )
        ),
    )
    power_key = F.when(k % 2 == 0, C.REGEN).otherwise(C.TRACTION)
    label = F.when(k % 3 == 0, "dc_fast").when(k % 3 == 1, "ac_level2").otherwise("other")
    click_rows = e.where(F.col("event_type") == "click").withColumn(
        "r",
        F.explode(
            F.array(
                _reading("spd", F.lit(C.SPEED), k, unit=F.lit("km/h"),
                         raw=F.concat(F.lit("cmd=010D resp="), raw_response(k))),
                _reading("pwr", power_key, F.col("value"), unit=F.lit("kW")),
                _reading("typ", F.lit(C.CHARGER_TYPE), text=label),
            )
        ),
    )
    return (
        _as_observations(driving_rows)
        .unionByName(_as_observations(error_rows))
        .unionByName(_as_observations(click_rows))
    )


def session_events(spark: SparkSession, sf_dir: str, time_divisor: int = 1) -> DataFrame:
    """Charging sessions from purchases; drive events from signups."""
    e = base_events(spark, sf_dir, time_divisor)
    bought = running_totals(
        e.where(F.col("event_type") == "purchase"),
        ["user_id"], time_bucket(F.col("ts"), RUN_BUCKET_SECONDS), ["ts", "event_id"], {"nth": F.lit(1)},
    )
    user = F.col("user_id").cast("string")
    charging = bought.select(
        "event_id", "vehicle_uid", "ts",
        F.concat(F.lit("ses-"), user, F.lit("-"), F.expr("(nth + 1) div 2").cast("string")).alias("session_id"),
        F.lit("charging").alias("session_type"),
        F.when(F.col("nth") % 2 == 1, "start").otherwise("stop").alias("event_type"),
    )
    driving = e.where((F.col("event_type") == "signup") & (F.col("k") % 4 < 2)).select(
        "event_id", "vehicle_uid", "ts",
        F.concat(F.lit("drv-"), user).alias("session_id"), F.lit("drive").alias("session_type"),
        F.when(F.col("k") % 4 == 0, "start").otherwise("stop").alias("event_type"),
    )
    return charging.unionByName(driving).select(
        F.concat(F.lit("sev-"), F.col("event_id").cast("string")).alias("session_event_id"),
        "vehicle_uid", "session_id", "session_type", "event_type", F.col("ts").alias("observed_at"),
        (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("ingested_at"), F.lit("OBD").alias("source"),
        F.concat(F.lit("evt="), F.col("event_id").cast("string")).alias("raw_payload_ref"),
    )


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = base_events(spark, sf_dir).where(F.col("event_type") == "error")
    lamp = F.when(F.col("value") > 50, "MIL_ON").otherwise("MIL_OFF")
    event = F.explode(
        F.array(
            F.struct(F.lit("mil-").alias("p"), lamp.alias("t"), F.lit(None).cast("string").alias("code")),
            F.struct(
                F.lit("dtc-").alias("p"), F.lit("DTC_ACTIVE").alias("t"),
                F.concat(F.lit("P0"), F.lpad(F.col("k").cast("string"), 3, "0")).alias("code"),
            ),
        )
    )
    return e.withColumn("d", event).select(
        F.concat("d.p", F.col("event_id").cast("string")).alias("event_id"), "vehicle_uid",
        F.concat(F.lit("bat-"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("batch_id"),
        F.col("d.t").alias("event_type"), F.col("d.code").alias("code"), F.col("ts").alias("observed_at"),
        (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("ingested_at"), F.lit("OBD").alias("source"),
    )


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as vehicles; make from the region, model from the market segment."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = F.col("c_custkey")
    made = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.concat(F.lit("veh-"), key.cast("string")).alias("vehicle_uid"),
            F.lit("unknown").alias("source_account_id"), F.lit(None).cast("string").alias("vin_hash"),
            F.col("r_name").alias("make"),
            F.when(key % 50 != 7, F.col("c_mktsegment")).alias("model"),
            F.lit(None).cast("string").alias("trim"),
            F.when(key % 97 != 0, 2022).cast("bigint").alias("model_year"),
            F.lit("bev").alias("powertrain_class"), made.alias("created_at"), made.alias("updated_at"),
        )
    )


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("user-"), (F.col("c_custkey") % 20).cast("string")).alias("user_id"),
        F.concat(F.lit("veh-"), F.col("c_custkey").cast("string")).alias("vehicle_uid"),
        F.lit("owner").alias("access_role"), made.alias("created_at"), made.alias("updated_at"),
    )
