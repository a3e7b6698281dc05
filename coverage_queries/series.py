"""Driving series."""

from pyspark.sql import functions as F

from voltlane import constants as C
from voltlane.operators import series as S
from voltlane.operators.ordering import exact_median

from .base import ALL_TOKENS, register, rounded

DRIVE = "('distance.odometer', 'ev.soc_pct', 'speed.vehicle', 'environment.ambient_temp_c', 'ev.regen_power_kw', 'ev.traction_power_kw')"


@register("d01_select_signals", f"""
SELECT timeframe, o.vehicle_uid, o.observation_id, o.signal_key, o.observed_at, round(o.value_number, 6) AS value_number
FROM obs o JOIN tf4 t ON o.observed_at >= t.cutoff WHERE signal_key IN {DRIVE}""")
def select_signals(s):
    rows = S.select_signals(s.obs(), S.DRIVE_SIGNALS.values(), s.tf(ALL_TOKENS))
    return rounded(rows.select(
        F.explode("timeframes").alias("timeframe"), "vehicle_uid", "observation_id", "signal_key", "observed_at", "value_number"))


@register("d02_pivot_snapshots", """
SELECT vehicle_uid, observed_at, round(odo, 6) AS odo, round(soc, 6) AS soc, round(speed, 6) AS speed, round(temp, 6) AS temp,
       round(regen, 6) AS regen, round(traction, 6) AS traction FROM snap WHERE timeframe = '180d'""")
def pivot_snapshots(s):
    return rounded(S.pivot_snapshots(s.obs()).drop("bucket"))


@register("d03_carry_forward", """
SELECT vehicle_uid, observed_at, round(odo, 6) AS odo, round(soc, 6) AS soc, round(speed, 6) AS speed, round(temp, 6) AS temp
FROM fill WHERE timeframe = '180d'""")
def carry_forward(s):
    return rounded(s.filled().select("vehicle_uid", "observed_at", "odo", "soc", "speed", "temp"))


def _labelled(df, s, tokens=ALL_TOKENS, since="since"):
    labels = S.matching_timeframes(F.col(since), df, since, s.tf(tokens))
    return df.withColumn("timeframe", F.explode(labels))


@register("d04_complete_deltas", """
SELECT timeframe, vehicle_uid, observed_at, round(delta_km, 6) AS delta_km, round(delta_soc, 6) AS delta_soc
FROM delta4""")
def complete_deltas(s):
    deltas = S.complete_deltas(s.filled(ALL_TOKENS))
    return rounded(_labelled(deltas, s).select("timeframe", "vehicle_uid", "observed_at", "delta_km", "delta_soc"))


@register("d05_gate_deltas", """
SELECT timeframe, vehicle_uid, count(*) AS accepted, round(sum(delta_km), 4) AS km, round(sum(delta_soc), 4) AS soc
FROM gated4 GROUP BY ALL""")
def gate_deltas(s):
    gated = S.gate_deltas(S.complete_deltas(s.filled(ALL_TOKENS)))
    return rounded(_labelled(gated, s).groupBy("timeframe", "vehicle_uid").agg(
        F.count("*").alias("accepted"), F.round(F.sum("delta_km"), 4).alias("km"), F.round(F.sum("delta_soc"), 4).alias("soc")))


@register("d06_km_per_soc", """
SELECT timeframe, vehicle_uid, observed_at, round(km_per_soc, 6) AS km_per_soc FROM gated4""")
def km_per_soc(s):
    rows = S.km_per_soc(S.gate_deltas(S.complete_deltas(s.filled(ALL_TOKENS))))
    return rounded(_labelled(rows, s).select("timeframe", "vehicle_uid", "observed_at", "km_per_soc"))


@register("d07_speed_segment", """
SELECT timeframe, vehicle_uid, observed_at, CASE WHEN speed < 45 THEN 'urban' WHEN speed >= 80 THEN 'highway' END AS segment FROM gated4""")
def speed_segment(s):
    tf = s.tf(ALL_TOKENS)
    rows = S.speed_segment(S.gate_deltas(S.complete_deltas(s.filled(ALL_TOKENS))))
    rows = _labelled(rows, s).withColumn(
        "known", F.array_contains(S.matching_timeframes(F.col("speed_at"), rows, "speed_at", tf), F.col("timeframe")))
    return rows.select("timeframe", "vehicle_uid", "observed_at", F.when(F.col("known"), F.col("segment")).alias("segment"))


@register("d08_latest_soc", """
SELECT timeframe, vehicle_uid, round(latest_soc, 6) AS value, observed_at FROM lsoc4""")
def latest_soc(s):
    return rounded(S.latest_value(s.obs(), C.SOC, s.tf(ALL_TOKENS)))


@register("d09_integrate_power", """
SELECT timeframe, vehicle_uid, round(regen_wh, 4) AS regen_wh, round(traction_wh, 4) AS traction_wh, power_windows FROM powerc""")
def integrate_power(s):
    return rounded(S.integrate_power(s.obs(300), s.tf()), 4)


@register("d10_temperature_points", """
SELECT timeframe, vehicle_uid, observed_at, round(temp, 6) AS temp, round(km_per_soc, 6) AS km_per_soc, round(delta_km, 6) AS delta_km FROM tpoint4""")
def temperature_points(s):
    return rounded(_labelled(S.temperature_points(s.filled(ALL_TOKENS)), s).select(
        "timeframe", "vehicle_uid", "observed_at", "temp", "km_per_soc", "delta_km"))


@register("d11_temperature_buckets", """
SELECT timeframe, vehicle_uid, round(cold_km, 4) AS cold_km, round(mild_km, 4) AS mild_km, cold_points, mild_points, points FROM tbuck4""")
def temperature_buckets(s):
    return rounded(S.temperature_buckets(S.temperature_points(s.filled(ALL_TOKENS)), s.tf(ALL_TOKENS)).drop("slope"), 4)


@register("d12_median_by_user_and_type", """
SELECT user_id, event_type, round(median(value), 6) AS median, count(*) AS n FROM events GROUP BY ALL""")
def median_by_user(s):
    return rounded(exact_median(s.raw("events"), ["user_id", "event_type"], "value"))


@register("d12_median_per_flag", """
SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 6) AS median, count(*) AS n FROM lineitem GROUP BY ALL""")
def median_per_flag(s):
    return rounded(exact_median(s.raw("lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"))


@register("d13_slope", """
SELECT timeframe, vehicle_uid, points, round(slope, 6) AS slope FROM tbuck4""")
def slope(s):
    rows = S.temperature_buckets(S.temperature_points(s.filled(ALL_TOKENS)), s.tf(ALL_TOKENS))
    return rounded(rows.select("timeframe", "vehicle_uid", "points", "slope"))


@register("d14_mean_max", """
SELECT vehicle_uid, signal_key, round(avg(value_number), 6) AS mean_value, round(max(value_number), 6) AS max_value
FROM obs WHERE value_number IS NOT NULL GROUP BY ALL""")
def mean_max(s):
    obs = s.obs().where(F.col("value_number").isNotNull())
    return rounded(obs.groupBy("vehicle_uid", "signal_key").agg(
        S.mean(F.col("value_number")).alias("mean_value"), S.max_value(F.col("value_number")).alias("max_value")))
